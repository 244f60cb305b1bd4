"""Drawings as pixels, against areas known from geometry and pixels worked out by hand."""

import math

import numpy as np
import pytest

from pagelens.sources import drawings as D
from pagelens.sources import images as I


def drawn(body, n=16, attrs='viewBox="0 0 16 16"'):
    return D.draw(f'<svg xmlns="http://www.w3.org/2000/svg" xmlns:x="http://www.w3.org/1999/xlink" {attrs}>{body}</svg>'.encode(), n, n)


def area(body, n=400):
    return drawn(body, n)[..., 3].sum() / 255 * (16 / n) ** 2


LINE = '<path d="M3 8H13" fill="none" stroke="#000" stroke-width="2" stroke-linecap="%s"/>'
BOX = '<path d="M3 3H13V13H3Z" fill="none" stroke="#000" stroke-width="2" stroke-linejoin="%s"/>'


@pytest.mark.parametrize(
    "body,size",
    [
        ('<circle cx="8" cy="8" r="6"/>', 36 * math.pi),
        ('<path d="M2 8A6 6 0 1 1 14 8 6 6 0 0 1 2 8z"/>', 36 * math.pi),
        ('<path d="M2 8a6 6 0 1112 0 6 6 0 01-12 0z"/>', 36 * math.pi),
        ('<path d="M2 8a1 1 0 1 1 12 0z"/>', 18 * math.pi),  # radii that don't reach
        ('<path d="M14 8A6 6 0 0 0 8 2V8z"/>', 9 * math.pi),
        ('<path d="M14 8A6 6 0 1 1 8 2V8z"/>', 27 * math.pi),
        ('<ellipse cx="8" cy="8" rx="6" ry="3" transform="rotate(30 8 8)"/>', 18 * math.pi),
        ('<rect x="2" y="2" width="12" height="12" rx="2"/>', 144 - 16 + 4 * math.pi),
        ('<path d="M0 8C0 16 16 16 16 8"/>', 76.8),
        ('<path d="M0 8Q8 24 16 8"/>', 256 / 3),
        ('<path d="M0 8q4 8 8 0t8 0"/>', 128 / 3),
        ('<path d="M0 8c0 4 8 4 8 0s8-4 8 0"/>', 38.4),
        ('<polygon points="0,0 16,16 0,16"/>', 128.0),
        ('<polyline points="0 0 16 16 0 16"/>', 128.0),
        ('<path d="M0 0h8v8h-8zM2 2h4v4h-4z"/>', 64.0),
        ('<path fill-rule="evenodd" d="M0 0h8v8h-8zM2 2h4v4h-4z"/>', 48.0),
        ('<path d="M0 0h8v8h-8zM2 2v4h4v-4z"/>', 48.0),
        ('<path d="M0 0h4v4h-4z M8 8h4v4x9"/>', 24.0),  # up to the error
        ('<rect width="50%" height="4" transform="translate(1,2) scale(2 1)"/>', 60.0),
        ('<rect width="4" height="4" transform="skewX(45)"/>', 16.0),
        ('<rect width="4" height="4" transform="matrix(0 2 -1 0 8 0)"/>', 32.0),
        ('<line x1="2" y1="8" x2="14" y2="8" stroke="black" stroke-width="2"/>', 24.0),
        (LINE % "butt", 20.0),
        (LINE % "square", 24.0),
        (LINE % "round", 20 + math.pi),
        ('<path d="M8 8h0" stroke="#000" stroke-width="4" stroke-linecap="round"/>', 4 * math.pi),
        (BOX % "miter", 80.0),
        (BOX % "bevel", 78.0),
        (BOX % "round", 76 + math.pi),
        ('<circle cx="8" cy="8" r="5" fill="none" stroke="red" stroke-width="2"/>', 20 * math.pi),
        ('<path d="M2 2H14M8 1V9" stroke="#000" stroke-width="2"/>', 24 + 16 - 4),
        ('<text>x</text><defs><rect width="9" height="9"/></defs><rect width="9" height="9" display="none"/><rect width="9" height="9" visibility="hidden"/><rect width="9" height="9" fill="none"/>', 0.0),
    ],
)
def test_areas(body, size):
    assert area(body) == pytest.approx(size, abs=0.03)


def test_pixels_by_hand():
    alpha = drawn('<rect x="1.5" y="2" width="4" height="3.5" fill="red"/>')[..., 3]
    assert alpha[3].tolist() == [0, 128, 255, 255, 255, 128, *[0] * 10] and alpha[5].tolist() == [0, 64, 128, 128, 128, 64, *[0] * 10] and not alpha[6:].any()
    assert (drawn('<path d="M0 0L16 16L0 16Z"/>')[..., 3].diagonal() == 128).all()


def test_many_crossings_come_in_parts(monkeypatch):
    star = "M" + " ".join(f"{8 + 7 * math.cos(2.7 * k):.3f} {8 + 7 * math.sin(2.7 * k):.3f}" for k in range(101)) + "Z"
    for rule in ("nonzero", "evenodd"):
        body = f'<path fill-rule="{rule}" d="{star}"/>'
        whole = drawn(body, 64)
        with monkeypatch.context() as m:
            m.setattr(D, "CROSSINGS", 500)
            assert (drawn(body, 64) == whole).all()


def test_colors_and_layers():
    assert drawn('<g opacity=".5"><rect width="8" height="8"/><rect width="8" height="8" fill="white"/></g>')[0, 0].tolist() == [255, 255, 255, 128]
    assert drawn('<rect width="8" height="8"/><rect width="8" height="8" fill="#fff" fill-opacity="50%"/>')[0, 0].tolist() == [128, 128, 128, 255]
    assert drawn("<style>/* x */ .a, .c {fill:#0f0} #b{fill:blue}</style><rect id='b' class='a' width='100%' height='16'/>")[15, 15].tolist() == [0, 0, 255, 255]
    assert drawn('<g fill="red" color="lime"><rect width="9" height="9" style="fill:currentColor" fill="blue"/></g>')[0, 0].tolist() == [0, 255, 0, 255]
    assert drawn('<defs><rect id="r" width="2" height="2"/></defs><use x:href="#r" x="4" y="4" fill="rgb(10,20,30)"/>')[4, 4].tolist() == [10, 20, 30, 255]
    assert [D.color(x) for x in ("#1234", "rgb(100%, 0, 0)", "none", "#12")] == [(17 / 255, 34 / 255, 51 / 255, 68 / 255), (1.0, 0.0, 0.0, 1.0), None, None]


def test_gradients():
    stops = '<stop offset="0" stop-color="#000"/><stop offset="1" style="stop-color:#fff"/>'
    across = drawn(f'<linearGradient id="s">{stops}</linearGradient><linearGradient id="g" x:href="#s"/><rect width="16" height="16" fill="url(#g)"/>')
    assert across[3, :, 0].tolist() == [round(255 * (k + 0.5) / 16) for k in range(16)]
    down = drawn(f'<linearGradient id="g" x2="0" y2="8" gradientUnits="userSpaceOnUse" spreadMethod="reflect">{stops}</linearGradient><rect width="16" height="16" fill="url(#g)"/>')
    assert (down[:8] == down[:7:-1]).all() and down[0, 0, 0] < down[7, 0, 0]
    ring = drawn(f'<radialGradient id="g">{stops}</radialGradient><rect width="16" height="16" fill="url(#g)"/>')
    assert ring[8, 15, 0] == round(255 * math.hypot(7.5, 0.5) / 8) and ring[0, 0, 0] == 255
    assert not drawn('<rect width="16" height="16" fill="url(#none)"/>').any() and drawn('<rect width="16" height="16" fill="url(#none) red"/>')[0, 0, 0] == 255


def test_view_boxes():
    box = '<rect x="10" y="10" width="10" height="10"/>'
    alpha = lambda how: drawn(box, 16, f'width="16" height="16" viewBox="10 10 10 5" preserveAspectRatio="{how}"')[..., 3] > 0
    assert alpha("xMidYMid").sum() == 16 * 12 and not alpha("xMidYMid")[:4].any()  # below the box, there is room to draw
    assert alpha("xMinYMin").all() and alpha("none").all() and alpha("xMidYMid slice").all()
    # width and height scale to the pixels asked for
    assert (D.draw(b'<svg width="2" height="1"><rect width="1" height="1"/></svg>', 8, 4)[..., 3] > 0).sum() == 16


@pytest.mark.parametrize("bad", [b"", b'<svg width="1" height="1">', b"<a/>", b'<x><svg width="1" height="1"/></x>', b'<svg width="1" height="1">' + b'<g opacity=".5">' * 9 + b"</g>" * 9 + b"</svg>", b'<svg width="1" height="1"><g id="a"><use href="#a"/><use href="#a"/></g></svg>', b'<svg width="1" height="1">' + b"<g>" * 300 + b"</g>" * 300 + b"</svg>", b'<?xml version="1.0" encoding="none-such"?><svg width="1" height="1"/>', b"\x89PNG"])
def test_what_cannot_be_drawn(bad):
    with pytest.raises(ValueError):
        D.draw(bad, 4, 4)
    assert I.drawn(bad, 4) is None and I.drawn(None, 4) is None


def test_odd_numbers_do_not_crash():
    for body in ('<path d="M1e30 0L-1e30 9 4 4z"/>', '<path d="M0 0C1e300 0 0 1e300 1 1z" transform="scale(1e300)"/>', '<circle r="1e200"/>', '<rect width="nan" height="1"/>', '<path d="L1 1"/>', '<path/>', '<path d="M"/>', '<polygon points="1"/>', '<path d="M0 0L1 1" transform="scale(0)" stroke="red"/>', '<path d="M1 1A0 5 0 0 1 3 3A2 2 0 0 1 3 3" stroke="red"/>', '<rect width="3" height="3" rx="-1" fill="url(#x"/>'):
        made = I.drawn(f'<svg viewBox="0 0 16 16">{body}</svg>'.encode(), 16)
        assert made is None or np.isfinite(I.decode_png(made[2])).all()
