"""Drawings (SVG) as pixels: shapes become polygons, and each pixel takes the share of it that they cover.

Drawn: paths, rectangles, circles, ellipses, lines, polylines and polygons, groups, uses, transforms, fills by both rules,
strokes with caps and joins, flat colors, linear and radial gradients, opacities (of groups as well), and style rules of
one tag, class or id. Not drawn: text, pictures, patterns, clips, masks, filters, markers and dashes (a dashed line is
whole). Nested viewports are moved and neither scaled nor clipped. What isn't well-formed XML, nests too deep or repeats
itself without end is a ValueError.
"""

from __future__ import annotations

import math
import re
from xml.etree import ElementTree

import numpy as np

#: Lines on which a row of pixels is looked at; along a line the covered length is exact.
LINES = 16
#: Pixels that a flattened curve may be off.
TOLERANCE = 0.02
#: Crossings held at a time, and what one drawing may ask for.
CROSSINGS, DEEPEST, MOST_ELEMENTS, MOST_LAYERS = 1 << 20, 200, 200_000, 8

# Names of colors, how many numbers each command of a path takes, properties that descendants inherit.
COLORS = {
    "black": "#000000", "silver": "#c0c0c0", "gray": "#808080", "grey": "#808080", "white": "#ffffff", "maroon": "#800000", "red": "#ff0000", "purple": "#800080", "fuchsia": "#ff00ff", "magenta": "#ff00ff",
    "green": "#008000", "lime": "#00ff00", "olive": "#808000", "yellow": "#ffff00", "navy": "#000080", "blue": "#0000ff", "teal": "#008080", "aqua": "#00ffff", "cyan": "#00ffff", "orange": "#ffa500",
}
NUMBERS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
INHERITED = {"fill": "black", "stroke": "none", "stroke-width": "1", "fill-rule": "nonzero", "fill-opacity": "1", "stroke-opacity": "1", "stroke-linecap": "butt", "stroke-linejoin": "miter", "stroke-miterlimit": "4", "color": "black", "visibility": "visible"}

_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_NEXT = re.compile(rf"[\s,]*({_NUMBER})")
_FLAG = re.compile(r"[\s,]*([01])")
_COMMAND = re.compile(r"[\s,]*([A-Za-z])")
_CIRCLE = 2 * math.pi
_LENGTH = r"\s*([0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?)\s*(?:px)?\s*"


def drawing_size(raw: bytes | None) -> tuple[float, float] | None:
    """Width and height of an SVG as its root says, or as its view box does; None if it has neither, or no area."""
    text = (raw or b"").decode("utf-8", "replace")
    m = re.search(r"<svg\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", text)
    if not m:
        return None
    attrs = {k: a or b for k, a, b in re.findall(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", m[1])}
    box = re.findall(r"[-+0-9.eE]+", attrs.get("viewBox", ""))
    sides = []
    for k, name in ((2, "width"), (3, "height")):
        if side := re.fullmatch(_LENGTH, attrs.get(name, "")):
            sides.append(float(side[1]))
        else:
            try:
                sides.append(float(box[k]))
            except (IndexError, ValueError):
                return None
    return (sides[0], sides[1]) if min(sides) > 0 else None


def covered(polygons: list[np.ndarray], width: int, height: int, even_odd: bool = False) -> tuple[int, int, np.ndarray]:
    """(top, left, share of each pixel of a box that lies inside). polygons: arrays (..., corners, 2), in pixels, closed."""
    a = np.concatenate([p.reshape(-1, 2) for p in polygons])
    b = np.concatenate([np.roll(p, -1, axis=-2).reshape(-1, 2) for p in polygons])
    a, b = np.clip(a, -1e7, 1e7), np.clip(b, -1e7, 1e7)
    left, top = (max(0, int(np.floor(v))) for v in a.min(axis=0))
    right, bottom = min(width, int(np.ceil(a[:, 0].max()))), min(height, int(np.ceil(a[:, 1].max())))
    w, h = right - left, bottom - top
    if w <= 0 or h <= 0:
        return 0, 0, np.zeros((0, 0))
    a, b = a - (left, top), b - (left, top)
    y0, y1 = a[:, 1] * LINES - 0.5, b[:, 1] * LINES - 0.5
    lo, hi = (np.clip(np.ceil(v), 0, h * LINES).astype(np.int64) for v in (np.minimum(y0, y1), np.maximum(y0, y1)))
    met = hi > lo
    a, b, y0, y1, lo, hi = a[met], b[met], y0[met], y1[met], lo[met], hi[met]
    slope, turn = (b[:, 0] - a[:, 0]) / (y1 - y0), np.where(y1 > y0, 1, -1)
    out = np.empty((h, w))
    rows = max(1, h * CROSSINGS // max(CROSSINGS, int((hi - lo).sum())))
    for r in range(0, h, rows):
        n_rows = min(rows, h - r)
        first = np.maximum(lo, r * LINES)
        n = np.maximum(np.minimum(hi, (r + n_rows) * LINES) - first, 0)
        e = np.repeat(np.arange(len(n)), n)
        line = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n) + first[e]
        x = np.clip(a[e, 0] + (line - y0[e]) * slope[e], 0, w)
        order = np.lexsort((x, line))
        # a closed outline leaves a line as often as it enters, so windings need no start of their own
        wound = np.cumsum(turn[e][order])
        inside = np.concatenate([[0], (wound & 1 if even_odd else wound != 0).astype(np.int64)])
        step = np.diff(inside)
        x, cell = x[order], (line[order] // LINES - r) * (w + 2)
        at = np.minimum(x.astype(np.int64), w)
        size = n_rows * (w + 2)
        grown = np.bincount(cell + at, step * (at + 1 - x), size) + np.bincount(cell + at + 1, step * (x - at), size)
        out[r : r + n_rows] = np.cumsum(grown.reshape(n_rows, w + 2), axis=1)[:, :w] / LINES
    return top, left, np.clip(out, 0, 1)


def _bent(points: list[tuple], scale: float) -> list[tuple]:
    """A Bezier curve as points after its first."""
    p = np.array(points, float)
    most = np.hypot(*np.diff(p, n=2, axis=0).T).max() * scale
    degree = len(p) - 1
    n = int(min(4096, max(1, math.ceil(math.sqrt(degree * (degree - 1) / 8 * most / TOLERANCE)))))
    t = np.arange(1, n + 1)[:, None] / n
    weights = [math.comb(degree, k) * t**k * (1 - t) ** (degree - k) for k in range(degree + 1)]
    return [*map(tuple, sum(w * q for w, q in zip(weights, p, strict=True))[:-1].tolist()), points[-1]]


def _arc(start: tuple, rx: float, ry: float, turn: float, large: bool, sweep: bool, end: tuple, scale: float) -> list[tuple]:
    """An elliptical arc as points after its first; radii that are too short grow until they reach."""
    rx, ry, turn = abs(rx), abs(ry), math.radians(turn)
    if start == end:
        return []
    if not rx or not ry:
        return [end]
    c, s = math.cos(turn), math.sin(turn)
    dx, dy = (start[0] - end[0]) / 2, (start[1] - end[1]) / 2
    x, y = (c * dx + s * dy) / rx, (c * dy - s * dx) / ry  # half the chord, where the ellipse is a unit circle
    reach = math.hypot(x, y)
    if reach > 1:
        rx, ry, x, y, reach = rx * reach, ry * reach, x / reach, y / reach, 1.0
    off = math.sqrt(max(0.0, 1 / reach**2 - 1)) * (-1 if large == sweep else 1)
    mx, my = off * y, -off * x
    a, z = math.atan2(y - my, x - mx), math.atan2(-y - my, -x - mx)
    span = (z - a) % _CIRCLE if sweep else -((a - z) % _CIRCLE)
    n = int(min(4096, max(2, math.ceil(abs(span) / math.sqrt(8 * TOLERANCE / max(max(rx, ry) * scale, 1e-9))))))
    angle = a + span * np.arange(1, n) / n
    u, v = rx * (np.cos(angle) + mx), ry * (np.sin(angle) + my)
    middle = np.array([(start[0] + end[0]) / 2, (start[1] + end[1]) / 2])
    return [*map(tuple, (np.stack([c * u - s * v, s * u + c * v], axis=1) + middle).tolist()), end]


def lines_of(d: str, scale: float = 1.0) -> list[tuple[np.ndarray, bool]]:
    """(points, whether closed) of each part of a path, as far as it can be read. scale: pixels a unit."""
    out, part, at, command, args = [], [], 0, "", []
    here = begin = (0.0, 0.0)
    handle, kind = None, ""

    def end(closed: bool) -> None:
        if part:
            out.append((np.array(part, float), closed))
            part.clear()

    while True:
        if m := _COMMAND.match(d, at):
            command, at = m[1], m.end()
            if command.upper() not in NUMBERS or (not out and not part and command.upper() != "M"):
                break
        elif not command or command.upper() == "Z":
            break
        args = []
        for k in range(NUMBERS[command.upper()]):
            if not (m := (_FLAG if command in "Aa" and k in (3, 4) else _NEXT).match(d, at)):
                end(False)
                return out
            args.append(float(m[1]))
            at = m.end()
        c, (ox, oy) = command.upper(), here if command.islower() else (0.0, 0.0)
        pairs = [(ox + x, oy + y) for x, y in zip(args[::2], args[1::2], strict=False)]
        if c == "M":
            end(False)
            here = begin = pairs[0]
            part.append(here)
            command, kind = ("l" if command == "m" else "L"), "M"
            continue
        if c == "Z":
            end(True)
            here, kind = begin, "Z"
            continue
        if not part:
            part.append(here)
        if c in "HV":
            new = [(ox + args[0], here[1]) if c == "H" else (here[0], oy + args[0])]
        elif c == "A":
            new = _arc(here, *args[:3], bool(args[3]), bool(args[4]), (ox + args[5], oy + args[6]), scale)
        elif c == "L":
            new = pairs
        else:
            if c in "ST":  # the first handle mirrors the last one of a curve of the same kind
                near = handle if kind and kind in ("CS" if c == "S" else "QT") else here
                pairs = [(2 * here[0] - near[0], 2 * here[1] - near[1]), *pairs]
            handle = pairs[-2]
            new = _bent([here, *pairs], scale)
        part += new
        here, kind = part[-1], c
    end(False)
    return out


def _oriented(p: np.ndarray) -> np.ndarray:
    """Polygons (n, corners, 2), all turning one way, so that their union is what any of them winds around."""
    q = np.roll(p, -1, axis=1)
    area = (p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]).sum(axis=1)
    return np.where((area < 0)[:, None, None], p[:, ::-1], p)


def outlines(points: np.ndarray, closed: bool, width: float, cap: str, join: str, limit: float, scale: float) -> list[np.ndarray]:
    """Polygons whose union is the stroke along the points: a box a segment, and a piece a corner and end."""
    half = width / 2
    p = points[np.concatenate([[True], (np.diff(points, axis=0) != 0).any(axis=1)])]
    if closed and len(p) > 1 and (p[0] == p[-1]).all():
        p = p[:-1]
    n = int(max(8, math.ceil(_CIRCLE / math.sqrt(8 * TOLERANCE / max(half * scale, 1e-9)))))
    angle = np.arange(n) * _CIRCLE / n
    disc = half * np.stack([np.cos(angle), np.sin(angle)], axis=1)
    if len(p) == 1:
        square = half * np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]], float)
        return [p[0] + (disc if cap == "round" else square)[None]] if cap in ("round", "square") else []
    ends = p[[0, -1]]
    if closed:
        p = np.concatenate([p, p[:1]])
    way = np.diff(p, axis=0)
    way /= np.hypot(way[:, 0], way[:, 1])[:, None]
    if not closed and cap == "square":
        p = p.copy()
        p[0], p[-1] = p[0] - half * way[0], p[-1] + half * way[-1]
    side = half * np.stack([-way[:, 1], way[:, 0]], axis=1)
    out = [np.stack([p[:-1] + side, p[1:] + side, p[1:] - side, p[:-1] - side], axis=1)]
    one, two, corner = (side, np.roll(side, -1, axis=0), p[1:]) if closed else (side[:-1], side[1:], p[1:-1])
    if len(corner) and join == "round":
        out.append(corner[:, None] + disc)
    elif len(corner):
        outer = np.where(one[:, 0] * two[:, 1] - one[:, 1] * two[:, 0] > 0, -1.0, 1.0)[:, None]
        a, b = corner + outer * one, corner + outer * two
        out.append(np.stack([corner, a, b], axis=1))
        cos = (one * two).sum(axis=1) / half**2
        sharp = (join == "miter") & (2 <= limit**2 * (1 + cos)) & (cos > -1 + 1e-12)
        tip = corner[sharp] + (outer * (one + two))[sharp] / (1 + cos[sharp])[:, None]
        out.append(np.stack([a[sharp], tip, b[sharp]], axis=1))
    if not closed and cap == "round":
        out.append(ends[:, None] + disc)
    return [_oriented(x) for x in out if len(x)]


def matrix(text: str) -> np.ndarray:
    """The product of a list of transforms, 3 x 3; the unit matrix for what can't be read."""
    out = np.eye(3)
    for name, body in re.findall(r"(\w+)\s*\(([^)]*)\)", text):
        v = [float(x) for x in re.findall(_NUMBER, body)]
        tan = lambda x: math.tan(math.radians(x))
        try:
            if name == "matrix":
                m = [[v[0], v[2], v[4]], [v[1], v[3], v[5]]]
            elif name == "translate":
                m = [[1, 0, v[0]], [0, 1, v[1] if len(v) > 1 else 0]]
            elif name == "scale":
                m = [[v[0], 0, 0], [0, v[1] if len(v) > 1 else v[0], 0]]
            elif name == "rotate":
                c, s, (x, y) = math.cos(math.radians(v[0])), math.sin(math.radians(v[0])), v[1:3] or (0, 0)
                m = [[c, -s, x - c * x + s * y], [s, c, y - s * x - c * y]]
            elif name in ("skewX", "skewY"):
                m = [[1, tan(v[0]), 0], [0, 1, 0]] if name == "skewX" else [[1, 0, 0], [tan(v[0]), 1, 0]]
            else:
                return np.eye(3)
        except (IndexError, ValueError):
            return np.eye(3)
        out = out @ np.array([*m, [0, 0, 1]], float)
    return out


def color(text: str) -> tuple[float, float, float, float] | None:
    """Red, green, blue and alpha from 0 to 1; None for none and what isn't known."""
    text = COLORS.get(t := text.strip().lower(), t)
    if re.fullmatch(r"#(?:[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", text):
        digits = text[1:] if len(text) > 5 else "".join(2 * c for c in text[1:])
        v = [int(digits[i : i + 2], 16) / 255 for i in range(0, len(digits), 2)]
    elif m := re.fullmatch(rf"rgba?\(\s*((?:{_NUMBER}%?[\s,/]*){{3,4}})\)", text):
        v = [_share(x, 255 if k < 3 else 1) for k, x in enumerate(re.findall(rf"{_NUMBER}%?", m[1]))]
    else:
        return None
    return (*v[:3], v[3] if len(v) > 3 else 1.0)


def _share(text: str, whole: float = 1.0) -> float:
    """A number of ``whole``, or a percentage, as a share from 0 to 1; 1 for what can't be read."""
    m = re.match(rf"\s*({_NUMBER})(%?)", text)
    return min(1.0, max(0.0, float(m[1]) / (100 if m[2] else whole))) if m else 1.0


def _name(e) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _href(e) -> str:
    return (e.get("href") or e.get("{http://www.w3.org/1999/xlink}href") or "").strip()


def _declared(text: str) -> dict[str, str]:
    pairs = (x.partition(":") for x in text.split(";"))
    return {k.strip().lower(): v.replace("!important", "").strip() for k, _, v in pairs if v.strip()}


class _Drawing:
    """One drawing under way: its ids and rules, and the layer that shapes are painted on (colors times alpha)."""

    def __init__(self, root, width: int, height: int, size: tuple[float, float]):
        self.width, self.height, self.drawn, self.layers = width, height, 0, 0
        self.ids = {e.get("id"): e for e in root.iter() if e.get("id")}
        self.rules: dict[str, dict[str, str]] = {}
        for e in root.iter():
            if _name(e) == "style":
                for names, body in re.findall(r"([^{}]+)\{([^{}]*)\}", re.sub(r"/\*.*?\*/", "", e.text or "", flags=re.S)):
                    for name in names.split(","):
                        self.rules.setdefault(name.strip(), {}).update(_declared(body))
        box = [float(x) for x in re.findall(_NUMBER, root.get("viewBox", ""))]
        self.view = tuple(box[2:4]) if len(box) == 4 and min(box[2:]) > 0 else size
        placed = np.eye(3)
        if self.view is not size:
            zoom, how = np.array(size) / self.view, root.get("preserveAspectRatio", "xMidYMid meet")
            if "none" not in how:
                zoom[:] = zoom.max() if "slice" in how else zoom.min()
            at = [next((v for k, v in (("Min", 0.0), ("Max", 1.0)) if f"{c}{k}" in how), 0.5) for c in ("x", "Y")]
            for k in (0, 1):
                placed[k, k], placed[k, 2] = zoom[k], (size[k] - self.view[k] * zoom[k]) * at[k] - box[k] * zoom[k]
        self.to_pixels = np.diag([width / size[0], height / size[1], 1.0]) @ placed

    def length(self, text: str | None, along: int | None = None, default: float = 0.0) -> float:
        m = re.match(rf"\s*({_NUMBER})(%?)", text or "")
        if not m:
            return default
        whole = self.view[along] if along is not None else math.hypot(*self.view) / math.sqrt(2)
        return float(m[1]) * (whole / 100 if m[2] else 1)

    def said(self, e) -> dict[str, str]:
        """Properties of an element: attributes, below rules of its tag, classes and id, below its own style."""
        out = {k: v for k, v in e.attrib.items() if not k.startswith("{")}
        for key in (_name(e), *(f".{c}" for c in e.get("class", "").split()), f"#{e.get('id')}"):
            out |= self.rules.get(key, {})
        return out | _declared(e.get("style", ""))

    def path(self, e) -> str:
        kind, n = _name(e), lambda k, along=None: self.length(e.get(k), along)
        if kind == "path":
            return e.get("d", "")
        if kind == "line":
            return f"M{n('x1', 0)} {n('y1', 1)}L{n('x2', 0)} {n('y2', 1)}"
        if kind in ("polyline", "polygon"):
            v = re.findall(_NUMBER, e.get("points", ""))
            return "M" + " ".join(v[: len(v) // 2 * 2]) + ("Z" if kind == "polygon" else "") if len(v) > 1 else ""
        if kind in ("circle", "ellipse"):
            x, y = n("cx", 0), n("cy", 1)
            rx, ry = (n("r"), n("r")) if kind == "circle" else (n("rx", 0), n("ry", 1))
            return f"M{x + rx} {y}A{rx} {ry} 0 1 1 {x - rx} {y}A{rx} {ry} 0 1 1 {x + rx} {y}Z" if min(rx, ry) > 0 else ""
        x, y, w, h = n("x", 0), n("y", 1), n("width", 0), n("height", 1)
        if min(w, h) <= 0:
            return ""
        rx, ry = self.length(e.get("rx", e.get("ry")), 0), self.length(e.get("ry", e.get("rx")), 1)
        rx, ry = min(max(rx, 0), w / 2), min(max(ry, 0), h / 2)
        if not rx or not ry:
            return f"M{x} {y}h{w}v{h}h{-w}Z"
        bend = lambda dx, dy: f"a{rx} {ry} 0 0 1 {dx} {dy}"
        return f"M{x + rx} {y}h{w - 2 * rx}{bend(rx, ry)}v{h - 2 * ry}{bend(-rx, ry)}h{2 * rx - w}{bend(-rx, -ry)}v{2 * ry - h}{bend(rx, -ry)}Z"

    def gradient(self, e, box: tuple, to_pixels: np.ndarray, at: np.ndarray) -> np.ndarray | None:
        """Colors (n, 4) at pixels (n, 2)."""
        said, stops, kind, seen = {}, [], _name(e), set()
        while e is not None and _name(e) in ("linearGradient", "radialGradient") and id(e) not in seen:
            seen.add(id(e))
            said = {**e.attrib, **said}
            stops = stops or [s for s in e if _name(s) == "stop"]
            e = self.ids.get(_href(e)[1:])
        if not stops:
            return None
        own = said.get("gradientUnits") != "userSpaceOnUse"
        view, self.view = self.view, (1.0, 1.0) if own else self.view
        v = {k: self.length(said.get(k), along, default * (1 if own else x)) for k, along, default, x in (("x1", 0, 0, 0), ("y1", 1, 0, 0), ("x2", 0, 1, view[0]), ("y2", 1, 0, 0), ("cx", 0, 0.5, view[0]), ("cy", 1, 0.5, view[1]), ("r", None, 0.5, math.hypot(*view) / math.sqrt(2)))}
        self.view = view
        x, y, w, h = box
        m = to_pixels @ (np.array([[w, 0, x], [0, h, y], [0, 0, 1.0]]) if own else np.eye(3)) @ matrix(said.get("gradientTransform", ""))
        if abs(np.linalg.det(m)) < 1e-12:
            return None
        p = (np.linalg.inv(m) @ np.concatenate([at, np.ones((len(at), 1))], axis=1).T)[:2].T
        if kind == "linearGradient":
            way = np.array([v["x2"] - v["x1"], v["y2"] - v["y1"]])
            t = (p - (v["x1"], v["y1"])) @ way / (way @ way) if way.any() else np.ones(len(p))
        else:
            t = np.hypot(*(p - (v["cx"], v["cy"])).T) / v["r"] if v["r"] > 0 else np.ones(len(p))
        spread = said.get("spreadMethod", "pad")
        t = t % 1 if spread == "repeat" else 1 - np.abs(t % 2 - 1) if spread == "reflect" else t
        told = [self.said(s) for s in stops]
        tones = np.array([color(s.get("stop-color", "black")) or (0, 0, 0, 1) for s in told])
        tones[:, 3] *= [_share(s.get("stop-opacity", "1")) for s in told]
        where = np.maximum.accumulate([_share(s.get("offset", "0")) for s in told])
        return np.stack([np.interp(t, where, c) for c in tones.T], axis=1)

    def paint(self, layer: np.ndarray, polygons: list[np.ndarray], even_odd: bool, what: str, opacity: float, state: dict, box: tuple, to_pixels: np.ndarray) -> None:
        if not polygons:
            return
        shown = [np.asarray(p) @ to_pixels[:2, :2].T + to_pixels[:2, 2] for p in polygons]
        if not all(np.isfinite(p).all() for p in shown):
            return
        source = None
        if m := re.match(r"url\(\s*['\"]?#([^'\")]*)['\"]?\s*\)\s*(.*)", what):
            source, what = self.ids.get(m[1]), m[2] or "none"
        top, left, share = covered(shown, self.width, self.height, even_odd)
        if not share.size:
            return
        h, w = share.shape
        tone = None
        if source is not None:
            y, x = np.mgrid[top : top + h, left : left + w]
            tone = self.gradient(source, box, to_pixels, np.stack([x.ravel() + 0.5, y.ravel() + 0.5], axis=1))
            tone = tone if tone is None else tone.reshape(h, w, 4)
        if tone is None:
            flat = color(state["color"] if what.lower() == "currentcolor" else what)
            if flat is None:
                return
            tone = np.broadcast_to(np.array(flat), (h, w, 4))
        alpha = (share * opacity)[..., None] * tone[..., 3:]
        under = layer[top : top + h, left : left + w]
        under *= 1 - alpha
        under[..., :3] += tone[..., :3] * alpha
        under[..., 3:] += alpha

    def shape(self, e, layer: np.ndarray, state: dict, to_pixels: np.ndarray) -> None:
        scale = math.sqrt(abs(np.linalg.det(to_pixels[:2, :2])))
        parts = lines_of(self.path(e), scale)
        if not parts or state["visibility"] != "visible" or not scale:
            return
        every = np.concatenate([p for p, _ in parts])
        box = (*every.min(axis=0), *np.ptp(every, axis=0))
        if state["fill"] != "none" and _name(e) != "line":
            self.paint(layer, [p for p, _ in parts], state["fill-rule"] == "evenodd", state["fill"], _share(state["fill-opacity"]), state, box, to_pixels)
        width = self.length(state["stroke-width"], default=1.0)
        if state["stroke"] != "none" and width > 0:
            limit = max(1.0, self.length(state["stroke-miterlimit"], default=4.0))
            lines = [o for p, closed in parts for o in outlines(p, closed, width, state["stroke-linecap"], state["stroke-linejoin"], limit, scale)]
            self.paint(layer, lines, False, state["stroke"], _share(state["stroke-opacity"]), state, box, to_pixels)

    def draw(self, e, layer: np.ndarray, state: dict, to_pixels: np.ndarray, deep: int = 0) -> None:
        kind = _name(e)
        self.drawn += 1
        if deep > DEEPEST or self.drawn > MOST_ELEMENTS:
            raise ValueError("too deep or too much")
        shape = kind in ("path", "rect", "circle", "ellipse", "line", "polyline", "polygon")
        if not shape and kind not in ("svg", "g", "a", "use", "switch", "symbol"):
            return
        said = self.said(e)
        if said.get("display") == "none":
            return
        state = state | {k: said[k] for k in INHERITED if k in said and said[k] != "inherit"}
        to_pixels = to_pixels @ matrix(e.get("transform", ""))
        if kind == "use" or kind == "svg" and deep:
            to_pixels = to_pixels @ np.array([[1, 0, self.length(e.get("x"), 0)], [0, 1, self.length(e.get("y"), 1)], [0, 0, 1.0]])
        opacity = _share(said.get("opacity", "1"))
        on = layer
        if opacity < 1:
            self.layers += 1
            if self.layers > MOST_LAYERS:
                raise ValueError("too many layers")
            on = np.zeros_like(layer)
        if shape:
            self.shape(e, on, state, to_pixels)
        elif kind == "use":
            if (used := self.ids.get(_href(e)[1:])) is not None:
                self.draw(used, on, state, to_pixels, deep + 1)
        else:
            for child in e if kind != "symbol" or deep else ():
                if _name(child) != "symbol":
                    self.draw(child, on, state, to_pixels, deep + 1)
        if on is not layer:
            self.layers -= 1
            layer *= 1 - on[..., 3:] * opacity
            layer += on * opacity


def draw(raw: bytes | None, width: int, height: int) -> np.ndarray:
    """RGBA of 8 bits, (height, width, 4), of the whole drawing at so many pixels. ValueError for what is no drawing."""
    size = drawing_size(raw)
    try:
        root = ElementTree.fromstring(raw or b"")
    except (ElementTree.ParseError, LookupError) as e:
        raise ValueError("not well-formed") from e
    if size is None or _name(root) != "svg":
        raise ValueError("no drawing")
    layer = np.zeros((height, width, 4), np.float64)
    drawing = _Drawing(root, width, height, size)
    try:
        with np.errstate(all="ignore"):
            drawing.draw(root, layer, dict(INHERITED), drawing.to_pixels)
    except (OverflowError, ZeroDivisionError, RecursionError, np.linalg.LinAlgError) as e:
        raise ValueError("no sizes to draw at") from e
    alpha = layer[..., 3:]
    layer[..., :3] = np.where(alpha > 1e-9, layer[..., :3] / np.maximum(alpha, 1e-9), 0)
    return np.clip(np.rint(np.round(layer * 255, 9)), 0, 255).astype(np.uint8)
