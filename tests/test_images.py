"""Decoding, shrinking and sizes of drawings, against pictures encoded here by hand."""

import random
import struct
import zlib

import numpy as np
import pytest

from pagelens.operators import saving
from pagelens.sources import images as I

PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def paeth(a, b, c):
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def rows_of(part, depth, step):
    """Filtered bytes of rows of samples, the five filters in turn."""
    out, before = b"", None
    for y, row in enumerate(part):
        bits = "".join(f"{int(v):0{depth}b}" for v in row.ravel())
        line = bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))
        before = before or bytes(len(line))
        at = lambda line, i: line[i] if i >= 0 else 0
        guess = [lambda i: 0, lambda i: at(line, i - step), lambda i: before[i], lambda i: (at(line, i - step) + before[i]) // 2, lambda i: paeth(at(line, i - step), before[i], at(before, i - step))][y % 5]
        out += bytes([y % 5]) + bytes((v - guess(i)) & 255 for i, v in enumerate(line))
        before = line
    return out


def png(samples, depth, color, interlaced=False, extra=b""):
    h, w, channels = samples.shape
    step = max(1, depth * channels // 8)
    raw = b"".join(rows_of(p, depth, step) for x, y, dx, dy in (PASSES if interlaced else ((0, 0, 1, 1),)) if (p := samples[y::dy, x::dx]).size)
    part = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    packed = zlib.compress(raw)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, int(interlaced))) + extra + part(b"IDAT", packed[:7]) + part(b"IDAT", packed[7:]) + part(b"IEND", b"")


def chunk(tag, data):
    return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("depth,color", [(8, 0), (1, 0), (2, 0), (4, 0), (16, 0), (8, 2), (16, 2), (8, 4), (16, 4), (8, 6), (16, 6), (1, 3), (2, 3), (4, 3), (8, 3)])
def test_png(depth, color, interlaced):
    rng = np.random.default_rng(depth * 10 + color)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    for h, w in ((11, 13), (1, 1), (5, 2)):
        palette = rng.integers(0, 256, (1 << min(depth, 8), 3)).astype(np.uint8)
        samples = rng.integers(0, 1 << depth, (h, w, channels))
        extra = chunk(b"PLTE", palette.tobytes()) + chunk(b"tRNS", b"\x05\x80") if color == 3 else b""
        got = I.decode_png(png(samples, depth, color, interlaced, extra))
        top = samples >> 8 if depth == 16 else samples * 255 // ((1 << depth) - 1)
        if color == 3:
            want = np.dstack([palette[samples[..., 0]], np.array([5, 128, *[255] * 254])[samples[..., 0]]])
        else:
            want = np.dstack([top[..., :3] if color in (2, 6) else np.repeat(top[..., :1], 3, axis=2), top[..., -1:] if color in (4, 6) else np.full((h, w, 1), 255)])
        assert (got == want).all()


def test_clear_color_and_damage():
    samples = np.array([[[1], [2], [1]]])
    assert I.decode_png(png(samples, 8, 0, extra=chunk(b"tRNS", b"\0\1")))[0, :, 3].tolist() == [0, 255, 0]
    whole = png(np.arange(300).reshape(10, 10, 3) % 251, 8, 2)
    for raw in (whole[:-13], whole[: len(whole) // 2], whole[:50] + b"x" + whole[51:], b"\x89PNG\r\n\x1a\n", png(np.full((2, 2, 1), 3), 8, 3, extra=chunk(b"PLTE", b"abc"))):
        with pytest.raises(ValueError):
            I.decode_png(raw)


def gif(index, colors, least, interlaced=False, clear=None, at=(0, 0), canvas=None):
    """Codes grow as the decoder's table does, with a clear code now and then."""
    h, w = index.shape
    lines = np.concatenate([np.arange(a, h, d) for a, d in ((0, 8), (4, 8), (2, 4), (1, 2))]) if interlaced else np.arange(h)
    values, codes, rng = index[lines].ravel().tolist(), [], random.Random(1)
    table, size, word = {}, 0, ()

    def reset():
        nonlocal table, size
        table, size = {(i,): i for i in range(1 << least)}, least + 1

    def emit(code):
        codes.append((code, size))

    reset()
    emit(1 << least)
    n, first = (1 << least) + 2, True
    for v in values:
        if (*word, v) in table:
            word = (*word, v)
            continue
        emit(table[word])
        if n < 4096:
            table[(*word, v)] = n
            n += 1
            size += n - 1 == 1 << size and size < 12
        word = (v,)
        if rng.random() < 0.01 or n >= 4095:
            emit(table[word])
            emit(1 << least)
            reset()
            n, word = (1 << least) + 2, ()
    if word:
        emit(table[word])
    emit((1 << least) + 1)
    bits = "".join(f"{c:0{s}b}"[::-1] for c, s in codes)
    data = bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))
    blocks = b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"
    k = max(1, (len(colors) - 1).bit_length()) - 1
    table_bytes = colors.tobytes().ljust(3 * (2 << k), b"\0")
    width, height = canvas or (w, h)
    control = b"\x21\xf9\x04" + bytes([1, 0, 0, clear, 0]) if clear is not None else b""
    return b"GIF89a" + struct.pack("<HHBBB", width, height, 128 | k, 0, 0) + table_bytes + control + b"\x21\xfe\x02hi\0" + b"\x2c" + struct.pack("<HHHHB", *at, w, h, 64 if interlaced else 0) + bytes([least]) + blocks + b";"


@pytest.mark.parametrize("interlaced", [False, True])
def test_gif(interlaced):
    rng = np.random.default_rng(4)
    for n, shape in ((4, (9, 7)), (256, (70, 90)), (2, (1, 1))):
        colors = rng.integers(0, 256, (n, 3)).astype(np.uint8)
        index = rng.integers(0, n, shape) if n > 4 else np.repeat(rng.integers(0, n, (shape[0], 1)), shape[1], axis=1)
        got = I.decode_gif(gif(index, colors, max(2, (n - 1).bit_length()), interlaced))
        assert (got[..., :3] == colors[index]).all() and (got[..., 3] == 255).all()
    raw = gif(np.array([[0, 1]]), np.array([[9, 9, 9], [7, 7, 7]], np.uint8), 2, clear=1, at=(1, 1), canvas=(4, 3))
    assert I.decode_gif(raw)[1].tolist() == [[0, 0, 0, 0], [9, 9, 9, 255], [7, 7, 7, 0], [0, 0, 0, 0]]
    one = bytes.fromhex("47494638396101000100800000ffffff00000021f90401000000002c00000000010001000002024401003b")
    assert I.decode_gif(one).tolist() == [[[255, 255, 255, 0]]]
    for cut in (one[:-6], one[:20], b"GIF89a"):
        with pytest.raises(ValueError):
            I.decode_gif(cut)


def test_shrinking_takes_means_of_areas():
    x = np.zeros((2, 3, 4), np.uint8)
    x[0] = [[100, 0, 0, 255], [200, 0, 0, 255], [50, 0, 0, 255]]
    x[1] = x[0]
    assert I.shrunk(x, 2, 1).tolist() == [[[133, 0, 0, 255], [100, 0, 0, 255]]]  # (100 + 200 / 2) / 1.5
    x[0, 0, 3] = 0  # what isn't seen lends no color
    assert I.shrunk(x[:1], 1, 1).tolist() == [[[125, 0, 0, 170]]]
    big = np.random.default_rng(0).integers(0, 256, (40, 60, 4)).astype(np.uint8)
    big[..., 3] = 255
    assert (I.shrunk(big, 15, 10) == np.rint(big.reshape(10, 4, 15, 4, 4).mean(axis=(1, 3)))).all() and (I.shrunk(big, 60, 40) == big).all()


@pytest.mark.parametrize("markup,size", [('<svg width="10" height="20px">', (10, 20)), ("<?xml?><!-- x --><svg a='>' viewBox='0 0 30 40'/>", (30, 40)), ('<svg width="50%" height="5" viewBox="0,0,7.5,9">', (7.5, 5)), ("<svg>", None), ('<svg width="0" height="3">', None), ("<SVG width='1' height='1'>", None), ("", None)])
def test_sizes_of_drawings(markup, size):
    assert I.drawing_size(markup.encode()) == size and I.drawing_size(None) is None


def test_thumbnails_of_all_kinds(spark):
    shapes = png(np.arange(600 * 3).reshape(1, 600, 3) % 256, 8, 2)
    files = {"a.png": shapes, "b.png": shapes[:-20], "c.svg": b'<svg viewBox="0 0 10 5"/>', "d.svg": shapes, "e.jpg": b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 500, 600) + b"\x01", "f.gif": b"GIF89a", "g.png": None}
    images = spark.createDataFrame([(i, f"https://h/{u}") for i, u in enumerate(files)], "id bigint, url string")
    fetched = spark.createDataFrame([(f"https://h/{u}", 200, bytearray(b) if b is not None else None) for u, b in files.items()], "url string, status int, content binary")
    got = {r.id: r for r in saving.thumbnails(images, fetched).collect()}
    assert [got[i].failed for i in range(7)] == [False, True, False, True, False, True, True]
    assert (got[0].w, got[0].thumb_w, got[0].thumb_h) == (600, 300, 1) and I.decode_png(got[0].png).shape == (1, 300, 4)
    assert (got[2].w, got[2].thumb_w, got[2].thumb_h) == (None, 300, 150) and (got[4].thumb_w, got[4].thumb_h, got[4].png) == (300, 250, None)
