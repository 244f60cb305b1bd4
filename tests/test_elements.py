"""Element tables: containment, style cascade, frames, provenance, and URLs by published cases."""

import random

import pytest
from pyspark.sql import functions as F

from pagelens.functions import containment
from pagelens.operators import scan, sweeps
from pagelens.sources import html as H
from pagelens.sources import urls as U

BASE = "https://h.example/x/y/z.html"
# What browsers make of these, against BASE.
URLS = [
    ("https:foo", "https://h.example/x/y/foo"), ("http:foo", "http://foo/"), ("http:\\\\a\\b", "http://a/b"), ("/../../a/./b/..", "https://h.example/a/"), ("?q'x", "https://h.example/x/y/z.html?q%27x"),
    ("#a b`", "https://h.example/x/y/z.html#a%20b%60"), ("http://0x7f.1/", "http://127.0.0.1/"), ("http://256.256.256.256/", None), ("http://1.2.3/", "http://1.2.0.3/"), ("http://[::ffff:1.2.3.4]:8080/", "http://[::ffff:102:304]:8080/"),
    ("http://[1:0:0:2::3]/", "http://[1:0:0:2::3]/"), ("http://[0:0:0:0:0:0:0:1]", "http://[::1]/"), ("http://[1::2::3]/", None), ("http://bücher.example/ä", "http://xn--bcher-kva.example/%C3%A4"), ("http://faß.de", "http://xn--fa-hia.de/"),
    ("http://日本。jp/", "http://xn--wgv71a.jp/"), ("http://u:p@h/", "http://u:p@h/"), ("http://u@@h/", "http://u%40@h/"), ("http://user:@h/", "http://user@h/"), ("http://:@/", None), ("http://a b/", None), ("http://ho%20st/", None),
    ("http://h:99999/", None), ("http://h:x/", None), ("http://h:080/", "http://h/"), ("http://ex%41mple.COM/", "http://example.com/"), ("mailto:a@b", "mailto:a@b"), ("javascript:alert(1)", "javascript:alert(1)"), ("%2e%2E/x", "https://h.example/x/x"),
    ("file:///C/../a", "file:///a"), ("https://h.example?x", "https://h.example/?x"), ("{a}|b", "https://h.example/x/y/%7Ba%7D|b"), ("///p/q", "https://p/q"), ("foo://h/p/../q", "foo://h/q"), ("foo:/a/../b", "foo:/b"), ("http://example.com/foo%2", "http://example.com/foo%2"),
]


@pytest.mark.parametrize("url,want", URLS)
def test_urls(url, want):
    assert U.resolve(url, BASE) == want


def met(spark, markup, url="https://h.example/d/", **more):
    row = spark.createDataFrame([(1, url, markup)], "page_id bigint, url string, html string")
    return sweeps.occurrences(row, **more).first()


def test_containment_against_brute_force(spark):
    """Random trees: nearest enclosing elements of the same root, and descendants as slices."""
    rng = random.Random(2)
    for _ in range(6):
        nodes, stack = [], []
        for i in range(120):
            while stack and rng.random() < 0.4:
                stack.pop()
            nodes.append([i, i, rng.choice((-2, 7)), rng.choice("oin")])
            stack.append(i)
            for k in stack:
                nodes[k][1] = i
        e = spark.createDataFrame([([tuple(n) for n in nodes],)], "e array<struct<pos:int,close:int,root:int,kind:string>>")
        of = lambda k: F.filter("e", lambda x: x["kind"] == k)  # noqa: B023, E731
        row = e.select(containment.nearest(of("o"), of("i"), lambda o: o["pos"], "int").alias("near"), containment.within(of("o"), of("i")).alias("spans")).first()
        inner, outer = [n for n in nodes if n[3] == "i"], [n for n in nodes if n[3] == "o"]
        assert row.near == [max((o[0] for o in outer if o[0] < n[0] <= o[1] and o[2] == n[2]), default=None) for n in inner]
        want = {o[0]: [n[0] for n in inner if o[0] < n[0] <= o[1]] for o in outer}
        assert {s.pos: [n[0] for n in inner[s["from"] - 1 : s["from"] - 1 + s.n]] for s in row.spans} == want


@pytest.mark.parametrize(
    "style,what",
    [("width:40px;height:40px", "sprite"), ("width:40px;height:80px", "kept"), ("width:40px", "kept"), ("", "kept"), ("width:40%;height:40px", "kept"), ("WIDTH: 59.5PX ; height:0", "sprite"), ("display:none", "sprite"), ("width:40px;height:40px;width:60px", "kept"), ("width:40px!important;height:40px;width:60px", "sprite")],
)
def test_boxes_of_backgrounds(spark, style, what):
    assert [m.what for m in met(spark, f'<i style="background:red url(a.png);{style}"></i>').met] == [what]
    assert [m.what for m in met(spark, f"<style>i{{background:url('a.png');{style}}}</style><i></i>").met] == [what]


def test_cascade(spark):
    shown = lambda css, body: [m.url.rpartition("/")[2] for m in met(spark, f"<style>{css}</style>{body}").met]
    assert shown("i{background:url(1)} .a{background:url(2)} i{background:url(3)}", "<i class='b a'></i><i></i>") == ["2", "3"]
    assert shown("#x{background:url(1)} .a.b{background:url(2)}", "<i id=x class='a b'></i><b class='a b'></b><u class=a></u>") == ["1", "2"]
    assert shown("i{background:url(1)!important}", "<i style='background:url(2)'></i>") == ["1"]
    assert shown("i{background:url(1)} i{background:none}", "<i></i>") == [] == shown("i + b, b ~ i, i:hover, i::before, i >, > i{background:url(1)}", "<i x><b></b><b></b></i>")
    assert shown("@media print { i { background-image: url(1), url(data:image/png;base64,x;y=) , url('2') } }", "<i></i>") == ["1", "2"]
    assert shown("", "<div><template shadowrootmode=open><style>i{background:url(1)}</style><i></i></template></div><i></i>") == ["1"]
    row = met(spark, "<style>i{background:url(data:image/png;base64,x);width:1px;height:1px}</style><i></i><i></i>")
    assert row.met == [] and row.n_sprites == 2
    late = "<b></b>" * 3996 + "<style>i{background:url(1)}</style>"  # with html-less markup, the style is number 3997
    assert len(met(spark, late + "<b></b><b></b><i></i>").met) == 1 and met(spark, late + "<b></b><b></b><b></b><i></i>").met == []


@pytest.mark.parametrize(
    "selector,body,want",
    [("p > b", "<p><b id=1></b><i><b id=2></b></i></p>", "1"), ("p b", "<p><b id=1></b><i><b id=2></b></i></p><b id=3></b>", "12"), (".a .a>.b", "<div class=a><div class='b' id=1></div><div class=a><div class='x b' id=2></div></div></div>", "2"),
     ("[data-k]", "<i id=1 data-k></i><i id=2></i>", "1"), ("i[x='a, b > c']", "<i id=1 x='a, b > c'></i><i id=2 x=a></i>", "1"), ("[x~=b], [x|=en]", "<i id=1 x='a b'></i><i id=2 x=ab></i><i id=3 x=en-us></i><i id=4 x=english></i>", "13"),
     ("[x^=a][x$=c][x*='b']", "<i id=1 x=abc></i><i id=2 x=ac></i><i id=3 x=xabc></i>", "1"), ("[x^=''],[x~='']", "<i id=1 x=></i>", ""), ("[x=A i]", "<i id=1 x=a></i>", "1"), ("[x=A]", "<i id=1 x=a></i>", ""), ("[TYPE=A]", "<i id=1 type=a></i>", "1"), ("[type=A s]", "<i id=1 type=a></i>", ""),
     ("div i", "<div><template shadowrootmode=open><i id=1></i></template><i id=2></i></div>", "2"), ("u   i,\n b>i", "<u><i id=1></i></u><b><i id=2></i></b><i id=3></i>", "12")],
)
def test_selectors(spark, selector, body, want):
    row = spark.createDataFrame([(1, "https://h.example/d/", f"<style>{selector}{{background:url(x.png)}}</style>{body}")], "page_id bigint, url string, html string")
    ids = {n.pos: n.attrs.get("id", "") for n in H.dom(row).first().elements}
    found = sweeps.found_in(H.dom(row)).first().found
    assert "".join(ids[f.key[2 if len(f.key) == 5 else -3]] for f in found if f.sweep == sweeps.CSS) == want


def test_weights_of_selectors(spark):
    shown = lambda css, body: [m.url.rpartition("/")[2] for m in met(spark, f"<style>{css}</style>{body}").met]
    assert shown("p b{background:url(1)} b{background:url(2)}", "<p><b></b></p><b></b>") == ["1", "2"]
    assert shown("p b[x]{background:url(1)} p b.a{background:url(2)} p > b{background:url(3)}", "<p><b x class=a></b><b></b></p>") == ["2", "3"]
    assert shown("b b b{background:url(1)} .a{background:url(2)}", "<b><b><b class=a></b></b></b>") == ["2"]


def test_selectors_against_brute_force(spark):
    """Chains of random compounds over random trees, matched from the inside out, all ways tried."""
    rng = random.Random(4)
    chains = [[(rng.choice("> "), rng.choice("pbiu"), rng.choice(["", ".a", ".b"])) for _ in range(rng.randint(1, 4))] for _ in range(40)]
    css = "".join("".join((j if k else "") + tag + cls for k, (j, tag, cls) in enumerate(c)) + f"{{background:url({n})}}" for n, c in enumerate(chains))
    nodes, body, stack = [], "", []
    for k in range(200):
        while stack and rng.random() < 0.35:
            body += f"</{nodes[stack.pop()][0]}>"
        tag, cls = rng.choice("biu") if k % 9 or stack else "p", rng.choice("abc")
        nodes.append((tag, "." + cls, stack[-1] if stack else -1))
        stack.append(k)
        body += f"<{tag} class={cls}>"

    def ends(k: int, c: list) -> bool:
        if k < 0 or nodes[k][0] != c[-1][1] or c[-1][2] not in ("", nodes[k][1]):
            return False
        if len(c) == 1:
            return True
        up = nodes[k][2]
        while up >= 0:
            if ends(up, c[:-1]):
                return True
            up = nodes[up][2] if c[-1][0] == " " else -1
        return False

    weight = lambda c: sum(1 + 100 * bool(cls) for _, _, cls in c)
    want = [max(((weight(c), n) for n, c in enumerate(chains) if ends(k, c)), default=(0, None))[1] for k in range(len(nodes))]
    row = spark.createDataFrame([(1, "https://h.example/d/", f"<style>{css}</style>{body}")], "page_id bigint, url string, html string")
    got = {f.key[2]: int(f.url) for f in sweeps.found_in(H.dom(row)).first().found}
    assert [got.get(k + 1) for k in range(len(nodes))] == want and len(set(want)) > 8


def test_provenance(spark):
    """Artwork counts at each of two sweeps and once in the source; shadow roots are credited twice; the source isn't."""
    ui = '<img src="https://h.example/rsrc.php/1.png">' * 2
    row = met(spark, ui + '<div><template shadowrootmode=open><img src=s.png><img src=t.png></template></div><i style="background:url(b.png)"></i>"https://o.example/x.png"')
    one = spark.createDataFrame([row])
    out = one.select(sweeps.skipped_assets(F.col("met")).alias("n"), sweeps.credits(F.col("met")).alias("c")).first()
    assert out.n == 6 and [(c.label, c.n) for c in out.c] == [("img", 2), ("CSS背景", 3)]
    assert [m.what for m in row.met if m.sweep == sweeps.RAW] == ["ui asset", "ui asset", "kept"] and row.n_source == 3 and row.n_imgs == 2


def test_frames(spark):
    markup = '<base href="/b/"><img src=0.png><iframe src=f></iframe><iframe src="https://else.example/f"></iframe><iframe srcdoc="<base href=/c/><img src=2.png><img srcset=\'3.png 2x\'><iframe srcdoc=\'<img src=no.png>\'></iframe>"></iframe><frame src=unknown>'
    pages = spark.createDataFrame([(1, "https://h.example/d/", markup), (2, "https://h.example/", "<img src=x.png>")], "page_id bigint, url string, html string")
    frames = spark.createDataFrame([(1, "https://h.example/b/f", "<img src=1.png><iframe src=f></iframe>"), (1, "https://else.example/f", "<img src=no.png>")], "page_id bigint, url string, html string")
    rows = scan.extract_images(H.with_frames(pages, frames)).orderBy("page_id", "order").collect()
    # what a frame's element says itself is relative to the frame, what is read as text to the page
    assert [r.url for r in rows if r.page_id == 1] == [f"https://h.example/{u}" for u in ("b/0.png", "b/1.png", "c/2.png", "b/3.png")] and rows[-1].page_id == 2


def test_extraction_has_no_shuffle_and_parses_only(spark):
    pages = spark.createDataFrame([(1, "https://h.example/", "<img src=a.png>")], "page_id bigint, url string, html string")
    plan = scan.extract_images(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


def test_counts_of_sweeps_have_the_source(spark):
    """What only the markup's text names is counted under its own label; a page whose source adds nothing adds no row."""
    html = '<img src="https://h.example/a.png"><script>"https://h.example/b.png https://h.example/c.png"</script>'
    pages = spark.createDataFrame([(1, BASE, html), (2, BASE, html), (3, BASE, '<img src="https://h.example/a.png">')], "page_id long, url string, html string")
    assert {(r.label, r.n_new) for r in scan.sweep_counts(sweeps.occurrences(pages)).collect()} == {("img", 3), ("raw source", 4)}
    assert [r.label for r in scan.sweep_counts(sweeps.occurrences(pages.where("page_id = 3"))).collect()] == ["img"]


def test_python_holds_a_slice_of_a_batch():
    """A batch of 10,000 rows of URLs is Python objects 64 rows at a time, and parsing and resolving need no pandas."""
    import subprocess
    import sys
    import tracemalloc

    import pyarrow as pa

    n, k = 10_000, 20
    urls = pa.array([[f"a{j}.png" for j in range(k)] if i % 100 else [] for i in range(n)])
    given = urls, pa.array([[0] * len(u) for u in urls]), pa.array([[f"https://h{i}.example/"] for i in range(n)])
    tracemalloc.start()
    out = U.resolved.func(*given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == n and out[0].as_py() == [] and out[9_999].as_py() == [f"https://h9999.example/a{j}.png" for j in range(k)]
    assert peak < 4e6 and len(U.resolved.func(*[c.slice(0, 0) for c in given])) == 0
    assert subprocess.run([sys.executable, "-c", "import pagelens.sources.html, sys; sys.exit('pandas' in sys.modules)"], check=False).returncode == 0


def test_no_box_without_a_background(spark):
    """The box of an element is worked out only where there is a picture behind it."""
    from pagelens.functions import styles

    fails = F.struct(F.raise_error(F.lit("a box was worked out")).cast("map<string,string>").alias("attrs"))
    none = F.array().cast(f"array<struct<root:int,nth:int,specificity:int,declared:array<{styles.DECLARED}>>>")
    rows = spark.createDataFrame([("width:3px",), ("background:none",), ("background:url(a.png)",)], "style string")
    of = lambda e, c: rows.where(c).select("style", styles.background(e, none, styles.declarations(F.col("style"))).alias("b")).collect()
    assert [(r.b.urls, r.b.sprite) for r in of(fails, "style NOT LIKE '%url%'")] == [([], False)] * 2
    attrs = F.struct(F.create_map(F.lit("width"), F.lit("9"), F.lit("height"), F.lit("9")).alias("attrs"))
    assert [(r.b.urls, r.b.sprite) for r in of(attrs, "style LIKE '%url%'")] == [(["a.png"], True)]
