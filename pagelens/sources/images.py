"""Encoded images: pixel sizes from headers, pixels of PNG and GIF, thumbnails, and the PNG sink.

JPEG, WebP, BMP and HEIF are told by their headers alone: no pixels are made of them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .drawings import draw, drawing_size


def header_size(raw: bytes | None) -> tuple[int, int] | None:
    """Width and height before orientation, of PNG, GIF, JPEG or WebP bytes; None for anything else."""
    raw = raw or b""
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", raw[16:24])
        if raw[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", raw[6:10])
        if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
            if raw[12:16] == b"VP8X":
                return int.from_bytes(raw[24:27], "little") + 1, int.from_bytes(raw[27:30], "little") + 1
            if raw[12:16] == b"VP8L":
                bits = int.from_bytes(raw[21:25], "little")
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            if raw[12:16] == b"VP8 ":
                w, h = struct.unpack("<HH", raw[26:30])
                return w & 0x3FFF, h & 0x3FFF
        if raw[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(raw):
                kind, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
                    return w, h
                at += 2 + size
    except (struct.error, IndexError):
        pass
    return None


@F.pandas_udf(T.StructType([T.StructField("w", T.DoubleType()), T.StructField("h", T.DoubleType())]))
def pixel_size(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([header_size(x) or (None, None) for x in content], columns=["w", "h"], dtype="float64")


def fit(width: int, height: int, longest: int, drawing: bool = False) -> tuple[int, int]:
    """Size of a picture scaled so that its longest side is ``longest``: only ever down, but for a drawing (SVG)."""
    scale = longest / max(width, height, 1)
    scale = scale if drawing else min(1.0, scale)
    return max(1, round(width * scale)), max(1, round(height * scale))


def png(alpha_rows: list[list[int]]) -> bytes:
    """Black pixels of the given alpha as an RGBA PNG."""
    raw = b"".join(b"\0" + b"".join(bytes((0, 0, 0, a)) for a in row) for row in alpha_rows)
    part = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    head = struct.pack(">IIBBBBB", len(alpha_rows[0]) if alpha_rows else 0, len(alpha_rows), 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw, 9)) + part(b"IEND", b"")


#: Pixels of the largest image that is decoded, 64 million; a larger one keeps its size and has no pixels.
MOST_PIXELS = 1 << 26
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Adam7 passes: first column and row, and steps.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfilter(raw: memoryview, height: int, stride: int, step: int) -> tuple[np.ndarray, memoryview]:
    """Rows of bytes with their filters undone; step: bytes of a pixel. Left neighbours are taken pixel by pixel."""
    if len(raw) < height * (stride + 1):
        raise ValueError("cut off")
    lines = np.frombuffer(raw[: height * (stride + 1)], np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + step), np.uint8)  # a row above and a pixel before, of zeros
    for y, line in enumerate(lines):
        kind, row, up = line[0], line[1:].astype(np.int32), out[y].astype(np.int32)
        if kind == 0 or kind == 2:
            out[y + 1, step:] = row + (up[step:] if kind else 0)
        elif kind == 1:
            padded = np.zeros(-(-stride // step) * step, np.int32)
            padded[:stride] = row
            out[y + 1, step:] = np.cumsum(padded.reshape(-1, step), axis=0).ravel()[:stride]
        elif kind in (3, 4):
            now = out[y + 1].astype(np.int32)
            for x in range(0, stride, step):
                a, b, c = now[x : x + step], up[x + step : x + 2 * step], up[x : x + step]
                n = len(b)
                if kind == 3:
                    guess = (a[:n] + b) // 2
                else:
                    pa_, pb, pc = np.abs(b - c[:n]), np.abs(a[:n] - c[:n]), np.abs(a[:n] + b - 2 * c[:n])
                    guess = np.where((pa_ <= pb) & (pa_ <= pc), a[:n], np.where(pb <= pc, b, c[:n]))
                now[x + step : x + step + n] = (row[x : x + n] + guess) & 255
            out[y + 1] = now
        else:
            raise ValueError("no such filter")
    return out[1:, step:], raw[height * (stride + 1) :]


def decode_png(raw: bytes) -> np.ndarray:
    """RGBA of 8 bits, (height, width, 4). ValueError for what isn't whole."""
    at, data, palette, clear, head = 8, [], None, None, None
    while True:
        if at + 12 > len(raw):
            raise ValueError("cut off")
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size or len(raw) < at + 12 + size or zlib.crc32(kind + body) != int.from_bytes(raw[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("damaged")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[3] not in _CHANNELS or head[2] not in (1, 2, 4, 8, 16):
        raise ValueError("no header")
    width, height, depth, color, _, _, interlaced = head
    if width * height > MOST_PIXELS:
        raise OverflowError
    try:
        rest = memoryview(zlib.decompress(b"".join(data)))
    except zlib.error as e:
        raise ValueError("damaged") from e
    channels = _CHANNELS[color]
    samples = np.zeros((height, width, channels), np.uint16)
    for x0, y0, dx, dy in _PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        bits = depth * channels
        rows, rest = _unfilter(rest, h, -(-w * bits // 8), max(1, bits // 8))
        if depth == 16:
            part = rows.reshape(h, w, channels, 2).astype(np.uint16)
            part = part[..., 0] << 8 | part[..., 1]
        elif depth == 8:
            part = rows.reshape(h, w, channels)
        else:
            part = np.unpackbits(rows, axis=1).reshape(h, -1, depth)[:, :w] @ (1 << np.arange(depth)[::-1])
            part = part.reshape(h, w, 1)
        samples[y0::dy, x0::dx] = part
    out = np.full((height, width, 4), 255, np.uint8)
    if color == 3:
        if palette is None or samples.max(initial=0) >= len(palette):
            raise ValueError("no such color")
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear or b"")] = np.frombuffer(clear or b"", np.uint8)[: len(palette)]
        out[..., :3], out[..., 3] = palette[samples[..., 0]], alpha[samples[..., 0]]
        return out
    full = (samples >> 8 if depth == 16 else samples * (255 // ((1 << depth) - 1))).astype(np.uint8)
    out[..., :3] = full[..., :3] if color in (2, 6) else full[..., :1]
    if color in (4, 6):
        out[..., 3] = full[..., -1]
    elif clear:
        out[..., 3] = np.where((samples == np.frombuffer(clear, ">u2")).all(axis=2), 0, 255)
    return out


def _lzw(data: bytes, least: int, wanted: int) -> np.ndarray:
    out, table, size, at = bytearray(), [], least + 1, 0
    clear, end, before = 1 << least, (1 << least) + 1, b""
    while len(out) < wanted:
        if at + size > 8 * len(data):
            raise ValueError("cut off")
        code = int.from_bytes(data[at >> 3 : (at + size + 7) >> 3], "little") >> (at & 7) & ((1 << size) - 1)
        at += size
        if code == clear:
            table, size, before = [bytes([i]) for i in range(clear)] + [b"", b""], least + 1, b""
            continue
        if code == end or not table or code > len(table) or code == len(table) and not before:
            raise ValueError("damaged")
        word = table[code] if code < len(table) else before + before[:1]
        out += word
        if before and len(table) < 4096:
            table.append(before + word[:1])
            size += len(table) == 1 << size and size < 12
        before = word
    return np.frombuffer(bytes(out[:wanted]), np.uint8)


def decode_gif(raw: bytes) -> np.ndarray:
    """RGBA of the first picture, on its canvas."""
    try:
        width, height, flags = struct.unpack("<HHB", raw[6:11])
        at, clear = 13, None
        table = lambda f, a: (np.frombuffer(raw[a : a + 3 * (2 << (f & 7))], np.uint8).reshape(-1, 3), a + 3 * (2 << (f & 7)))
        colors = None
        if flags & 128:
            colors, at = table(flags, at)
        if width * height > MOST_PIXELS:
            raise OverflowError

        def blocks(a: int) -> tuple[bytes, int]:
            out = []
            while n := raw[a]:
                if a + n >= len(raw):
                    raise ValueError("cut off")
                out.append(raw[a + 1 : a + 1 + n])
                a += n + 1
            return b"".join(out), a + 1

        while raw[at] == 0x21:
            body, after = blocks(at + 2)
            if raw[at + 1] == 0xF9:
                clear = body[3] if body[0] & 1 else None
            at = after
        if raw[at] != 0x2C:
            raise ValueError("no picture")
        x, y, w, h, flags = struct.unpack("<HHHHB", raw[at + 1 : at + 10])
        at += 10
        if flags & 128:
            colors, at = table(flags, at)
        data, _ = blocks(at + 1)
        index = _lzw(data, raw[at], w * h).reshape(h, w)
        if flags & 64:
            lines = np.concatenate([np.arange(a, h, d) for a, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            index = index[np.argsort(lines)]
        out = np.zeros((max(height, y + h), max(width, x + w), 4), np.uint8)
        if colors is None or index.max(initial=0) >= len(colors):
            raise ValueError("no such color")
        out[y : y + h, x : x + w, :3], out[y : y + h, x : x + w, 3] = colors[index], np.where(index == clear, 0, 255) if clear is not None else 255
        return out[:height, :width]
    except (struct.error, IndexError) as e:
        raise ValueError("cut off") from e


def shrunk(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each pixel the mean of the area that it covers, colors weighed by their alpha; half goes to even."""
    x = pixels.astype(np.float64)
    x[..., :3] *= x[..., 3:] / 255
    for axis, n in ((0, height), (1, width)):
        x = np.moveaxis(x, axis, 0)
        sums = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        edge = np.arange(n + 1) * len(x) / n
        low = np.minimum(edge.astype(int), len(x) - 1)
        at = sums[low] + (edge - low)[:, None, None] * x[low]
        x = np.moveaxis(np.diff(at, axis=0) * (n / len(x)), 0, axis)
    alpha = x[..., 3:]
    x[..., :3] = np.where(alpha > 1e-9, x[..., :3] * 255 / np.maximum(alpha, 1e-9), 0)
    return np.clip(np.rint(np.round(x, 9)), 0, 255).astype(np.uint8)


def rgba_png(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    raw = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    part = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 9)) + part(b"IEND", b"")


def thumbnail(raw: bytes | None, drawing: bool, longest: int) -> tuple:
    """(w, h, thumb_w, thumb_h, failed, png). A drawing has no pixel size of its own and is scaled both ways."""
    failed = (None, None, None, None, True, None)
    if drawing:
        made = drawn(raw, longest)
        return failed if made is None else (None, None, *made[:2], False, made[2])
    size = header_size(raw)
    if size is None or min(size) < 1:
        return failed
    to = fit(*size, longest)
    decode = decode_png if raw[:1] == b"\x89" else decode_gif if raw[:3] == b"GIF" else None
    try:
        pixels = rgba_png(shrunk(decode(raw), *to)) if decode else None
    except ValueError:
        return failed
    except OverflowError:
        pixels = None
    return (*map(float, size), *to, False, pixels)


def drawn(raw: bytes | None, longest: int) -> tuple[int, int, bytes] | None:
    """Width, height and PNG of a drawing whose longest side is ``longest``; None for what can't be drawn."""
    if (size := drawing_size(raw)) is None:
        return None
    to = fit(*size, longest, drawing=True)
    try:
        return (*to, rgba_png(draw(raw, *to)))
    except ValueError:
        return None


def with_drawn(rows: DataFrame, longest: int, content: str = "content") -> DataFrame:
    """rows with the markup in ``content`` as a PNG, or null; a few drawings at a time in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 4) for x in batches for i in range(0, x.num_rows, 4)):
            at = b.schema.get_field_index(content)
            made = [(drawn(x.as_py(), longest) or (None,))[-1] for x in b.column(at)]
            yield b.set_column(at, content, pa.array(made, b.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema)


def with_thumbnails(rows: DataFrame, longest: int) -> DataFrame:
    """rows: (id, drawing, content). (id, w, h, thumb_w, thumb_h, failed, png), an image at a time in each task."""
    names = ("w", "h", "thumb_w", "thumb_h", "failed", "png")
    types = (pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 64) for x in batches for i in range(0, x.num_rows, 64)):
            made = [thumbnail(c.as_py(), bool(d.as_py()), longest) for d, c in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[k] for m in made], t) for k, t in enumerate(types))], names=["id", *names])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "drawing", "content").mapInArrow(run, f"id {kind}, w double, h double, thumb_w int, thumb_h int, failed boolean, png binary")


@F.pandas_udf(T.BinaryType())
def png_of(alpha: pd.Series, width: pd.Series) -> pd.Series:
    """Black pixels as a PNG; alpha: an array, row by row."""

    def draw(values, w: int) -> bytes:
        rows = np.asarray(values, np.uint8).reshape(-1, w)
        return rgba_png(np.dstack([np.zeros((*rows.shape, 3), np.uint8), rows]))

    return pd.Series([draw(a, w) for a, w in zip(alpha, width, strict=True)])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def pixels_of(content: pd.Series) -> pd.Series:
    """Pixels of a PNG or GIF, row by row, as (red, green, blue, alpha); null for what can't be decoded."""

    def read(raw: bytes | None):
        try:
            return (decode_gif if (raw or b"")[:3] == b"GIF" else decode_png)(raw or b"").reshape(-1, 4).astype(int).tolist()
        except (ValueError, OverflowError):
            return None

    return content.map(read)
