"""Pages as element tables: a streaming HTML parse per row, in Arrow batches, with no shuffle.

Python emits elements only (tag, attributes, place in the tree); what is an image, a link or a rule of style is decided
by column functions. What a live browser adds is not there: layout boxes, the source a browser picked. Shadow roots are
declarative templates; other templates and what only browsers without scripts show hold no elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, ExtractConfig
from .urls import parse, resolve, resolved

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that another of their kind closes.
_CLOSES_ITSELF = frozenset(("a", "li", "option", "p"))
#: What stays out of the tree of elements.
INERT = -1


class _Tree(HTMLParser):
    """Elements in document order: (tag, attributes, parent, root), and the last descendant of each.

    A root is a document (-2 for the page, -3 and on for its frames), the element that a shadow root belongs to, or
    INERT. An element at the top of its root has no parent (-1).
    """

    def __init__(self, root: int = -2, first: int = 0) -> None:
        super().__init__(convert_charrefs=True)
        self.root, self.first = root, first
        self.nodes: list[tuple[str, dict, int, int]] = []
        self.close_at: list[int] = []
        self.open: list[int] = []
        self.text: dict[int, str] = {}

    def _inside(self, parent: int) -> tuple[int, int]:
        """(parent, root) of what is put into the element in place ``parent``."""
        if parent < 0:
            return -1, self.root
        tag, attrs, above, root = self.nodes[parent]
        if root == INERT or tag == "noscript":
            return parent, INERT
        if tag == "template":
            return (-1, above + self.first) if "shadowrootmode" in attrs and above >= 0 else (parent, INERT)
        return parent, root

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES_ITSELF and any(self.nodes[k][0] == tag for k in (self.open if tag == "a" else self.open[-1:])):
            self.handle_endtag(tag)
        parent, root = self._inside(self.open[-1] if self.open else -1)
        seen: dict = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        self.nodes.append((tag, seen, parent, root))
        self.close_at.append(len(self.nodes) - 1)
        if tag not in _VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open:
            self._end(len(self.open) - 1)

    def _end(self, k: int) -> None:
        for i in self.open[k:]:
            self.close_at[i] = len(self.nodes) - 1
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):  # what follows still goes into the body
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]][0] == tag:
                self._end(k)
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.nodes[self.open[-1]][0] == "style":
            at = self.open[-1]
            self.text[at] = self.text.get(at, "") + data


def parsed(html: str, root: int = -2, first: int = 0) -> _Tree:
    t = _Tree(root, first)
    t.feed(html)
    t.close()
    t._end(0)
    return t


def tree(html: str) -> list[tuple[str, dict, int, int]]:
    return parsed(html).nodes


#: Attributes that a rule looks at.
ATTRIBUTES = frozenset(("src", "srcset", "data-srcset", "href", "xlink:href", "rel", "as", "imagesrcset", "property", "name", "itemprop", "content", "poster", "style", "class", "id", "width", "height", *DEFAULT.lazy_attributes))
DOM = "array<struct<pos:int,close:int,parent:int,root:int,nth:int,doc:int,path:array<int>,tag:string,attrs:map<string,string>,text:string>>"
#: Pages parsed between two batches of rows.
_PAGES = 64


def _frames(t: _Tree, base: str, given: list[dict] | None) -> Iterator[tuple[str, str]]:
    """(base, html) of the page's own frames, in order: with their markup inline, or given by URL and of the same origin."""
    pages = {f["url"]: f["html"] for f in given or ()}
    origin = lambda u: u and (u.scheme, u.host, u.port)
    for tag, attrs, _, root in t.nodes:
        if tag in ("iframe", "frame") and root == t.root:
            if attrs.get("srcdoc") and tag == "iframe":
                yield base, attrs["srcdoc"]
            elif (url := resolve(attrs.get("src"), base)) in pages and origin(parse(url)) == origin(parse(base)):
                yield url, pages[url] or ""


def _base(t: _Tree, url: str) -> str:
    return next((resolve(a["href"], url) or url for tag, a, _, root in t.nodes if tag == "base" and a.get("href") and root == t.root), url)


def dom(pages: DataFrame) -> DataFrame:
    """Adds ``elements`` (DOM) and ``bases``, the base URL of each document of a page, to pages (url, html, ...).

    close: pos of the last descendant; parent: -1 at the top of a root; nth: number within the root; doc: 0 for the page
    itself, then its frames, one level deep; path: elements whose shadow roots lie around, from the outside. pages may
    have ``frames``, an array of (url, html): a frame with another origin, or not among them, has no elements.
    """
    given = "frames" in pages.columns
    at = {c: i for i, c in enumerate(pages.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, _PAGES) for x in batches for i in range(0, x.num_rows, _PAGES)):
            ints: dict[str, list] = {c: [] for c in ("pos", "close", "parent", "root", "nth", "doc")}
            tags, texts, path, path_at, keys, values, attr_at, rows, bases, bases_at = [], [], [], [0], [], [], [0], [0], [], [0]
            frames = b.column(at["frames"]).to_pylist() if given else [None] * b.num_rows
            for url, html, inner in zip(b.column(at["url"]).to_pylist(), b.column(at["html"]).to_pylist(), frames, strict=True):
                top = parsed(html or "")
                docs = [(top, _base(top, url or ""))]
                first = len(top.nodes)
                for frame_base, frame in _frames(top, docs[0][1], inner):
                    t = parsed(frame, -2 - len(docs), first)
                    docs.append((t, _base(t, frame_base)))
                    first += len(t.nodes)
                bases += [u for _, u in docs]
                bases_at.append(len(bases))
                for doc, (t, _) in enumerate(docs):
                    counts: dict[int, int] = {}
                    asked = any("[" in x for x in t.text.values())  # style rules may look at any attribute
                    paths: dict[int, list[int]] = {t.root: []}
                    for k, (tag, attrs, parent, root) in enumerate(t.nodes):
                        if root == INERT or tag == "template":
                            continue
                        if root not in paths:  # its host came before
                            paths[root] = [*paths.get(t.nodes[root - t.first][3], []), root]
                        nth = counts[root] = counts.get(root, -1) + 1
                        for c, v in zip(ints, (k + t.first, t.close_at[k] + t.first, parent + t.first if parent >= 0 else -1, root, nth, doc), strict=True):
                            ints[c].append(v)
                        tags.append(tag)
                        texts.append(t.text.get(k))
                        path += paths[root]
                        path_at.append(len(path))
                        for name, v in attrs.items():
                            if asked or name in ATTRIBUTES:
                                keys.append(name)
                                values.append(v)
                        attr_at.append(len(keys))
                rows.append(len(tags))
            off = lambda x: pa.array(np.array(x, np.int32))
            cols = [pa.array(v, pa.int32()) for v in ints.values()]
            cols += [pa.ListArray.from_arrays(off(path_at), pa.array(path, pa.int32())), pa.array(tags, pa.string()), pa.MapArray.from_arrays(off(attr_at), pa.array(keys, pa.string()), pa.array(values, pa.string())), pa.array(texts, pa.string())]
            found = pa.StructArray.from_arrays(cols, names=[*ints, "path", "tag", "attrs", "text"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(off(rows), found), pa.ListArray.from_arrays(off(bases_at), pa.array(bases, pa.string()))], names=[*b.schema.names, "elements", "bases"])

    made = T.StructType([*pages.schema.fields, *T._parse_datatype_string(f"elements {DOM}, bases array<string>").fields])
    return pages.mapInArrow(run, made)


def with_frames(pages: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds ``frames`` to pages, for `dom`; frames: (page_id, url, html), the documents that were loaded in frames."""
    given = frames.groupBy("page_id").agg(F.collect_list(F.struct("url", "html")).alias("frames"))
    return pages.join(given, "page_id", "left")


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, url): links of each page, resolved."""
    rows = dom(pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html"))
    links = F.filter("elements", lambda e: (e["doc"] == 0) & (e["tag"] == "a") & (F.coalesce(F.try_element_at(e["attrs"], F.lit("href")), F.lit("")) != ""))
    hrefs = rows.select("page_id", "bases", F.transform(links, lambda e: F.try_element_at(e["attrs"], F.lit("href"))).alias("hrefs"))
    urls = hrefs.withColumn("urls", resolved("hrefs", F.transform("hrefs", lambda h: F.lit(0)), "bases"))
    return urls.select("page_id", F.posexplode(F.arrays_zip("hrefs", "urls")).alias("pos", "a")).select("page_id", "pos", F.col("a.hrefs").alias("href"), F.col("a.urls").alias("url"))


ELEMENTS = "array<struct<pos:int,tag:string,label:string,role:string,in_link:boolean,laid_out:boolean,width:double,height:double,container:int,ancestors:array<int>>>"
_ELEMENTS = pa.list_(pa.struct([("pos", pa.int32()), *[(c, pa.string()) for c in ("tag", "label", "role")], *[(c, pa.bool_()) for c in ("in_link", "laid_out")], *[(c, pa.float64()) for c in ("width", "height")], ("container", pa.int32()), ("ancestors", pa.list_(pa.int32()))]))
_CONTAINERS = frozenset(("article", "main", "section"))
_HIDDEN = re.compile(r"(?i)(?:^|;)\s*display\s*:\s*none")
#: How far up the container is where no element around is one by name.
_UP = 6


def _number(text: str | None) -> float:
    m = re.match(r"\s*(\d+(?:\.\d+)?)", text or "")
    return float(m[1]) if m else 0.0


def _elements(html: str) -> list[dict]:
    """Pictures and labelled elements. Boxes are what width and height attributes say; hidden or display: none, here or
    around, is not laid out."""
    nodes, out = tree(html), []
    for i, (tag, a, _, shadow) in enumerate(nodes):
        if shadow != -2 or tag != "img" and "aria-label" not in a:
            continue
        around, p = [], nodes[i][2]
        while p >= 0:
            around.append(p)
            p = nodes[p][2]
        chain = [i, *around]
        named = next((k for k in chain if nodes[k][0] in _CONTAINERS or nodes[k][1].get("role") == "dialog"), None)
        hidden = any("hidden" in nodes[k][1] or _HIDDEN.search(nodes[k][1].get("style") or "") for k in chain)
        out.append({"pos": i, "tag": tag, "label": a.get("aria-label"), "role": a.get("role"), "in_link": any(nodes[k][0] == "a" for k in chain), "laid_out": not hidden, "width": _number(a.get("width")), "height": _number(a.get("height")), "container": named if named is not None else chain[min(_UP, len(around))], "ancestors": around})
    return out


def elements(pages: DataFrame) -> DataFrame:
    """Adds ``elements`` to pages with html: what operators.controls looks at, in document order, none for a null html."""

    def parsed(html: pa.Array) -> pa.Array:
        some = lambda i: pa.array([_elements(h or "") for h in html.slice(i, _PAGES).to_pylist()], _ELEMENTS)
        return pa.concat_arrays([some(i) for i in range(0, max(len(html), 1), _PAGES)])

    return pages.withColumn("elements", F.arrow_udf(parsed, ELEMENTS)("html"))
