"""Collocation mining against brute force."""

import random
import re
from collections import Counter

import pytest

from pagelens.llm import phrases as P

DOC = "doc_id bigint, text string, lang string, n string, word string, w1 string, score string, rank string"


def fixture():
    rng = random.Random(8)
    fixed = [[f"p{k}{j}" if rng.random() < 0.7 else f"c{rng.randrange(4)}" for j in range(rng.randint(2, 6))] for k in range(25)]
    rows = []
    for i in range(150):
        t = []
        for _ in range(rng.randrange(12)):
            t += rng.choice(fixed) if rng.random() < 0.5 else [f"c{min(rng.randrange(9), rng.randrange(9))}"]
            t.append(rng.choice(["", "", "", ".", "\n", "\t", ";\r", "!"]))
        rows.append((i, " ".join(t), rng.choice(["en", "en", "en", "de", None])))
    rows += [(200, None, "en"), (201, "", "en"), (202, "the the the the the the the the", "xx"), (203, "C0 c0,C0.c0", "und"), rows[3], rows[3], (None, "É\x1cé nb sp É\x1cé nb sp", "en"), (204, "w " * 3000, "de")]
    return [(*r, "z", "z", "z", "z", "z") for r in rows]


def brute(rows, m):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[(lang, tuple(w[i : i + k]))] += 1
    found = {}
    frequent = {p: a for p, a in f.items() if a >= m.least and len(p[1]) > 1}
    for (lang, p), a in frequent.items():
        if any(len(q) > len(p) and g == lang and 100 * b >= m.cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in frequent.items()):
            continue
        cuts = [(m.scale * a // (f[(lang, p[:k])] + f[(lang, p[k:])]), k) for k in range(1, len(p))]
        s, k = min(cuts)
        found.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), f[(lang, p[:k])], f[(lang, p[k:])]))
    return [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for lang, some in found.items() for r, (s, a, p, x, y) in enumerate(sorted(some)[: m.top])]


@pytest.mark.parametrize("mining", [P.Mining(least=6), P.Mining(least=4, top=12, first=3, more=2, held=40), P.Mining(least=5, top=25, first=10, more=3, step=50, most_bits=8)])
def test_collocations(spark, mining):
    rows = fixture()
    got = [tuple(r) for r in P.collocations(spark.createDataFrame(rows, DOC), mining).collect()]
    want = brute(rows, mining)
    assert len({r[0] for r in want}) > 2 and max(len(r[2].split()) for r in want) == 4
    assert sorted(got) == sorted(want)


def test_bands_end_before_all_nodes_are_expanded(spark):
    """The best phrases are settled without the extensions of weak pairs."""
    docs = spark.createDataFrame(fixture(), DOC)
    search = P.Search(docs, P.Mining(least=4, top=3, first=3, more=2))
    asked = []
    real = P.grown
    P.grown = lambda runs, tests, m: asked.append(tests) or real(runs, tests, m)
    try:
        low = search.run().groupBy("lang").agg({"score": "min"}).collect()
    finally:
        P.grown = real
    assert len(asked) >= 3 and any(r[1] > 100_000 for r in low)


def test_words_that_share_a_hash_get_another(spark, monkeypatch):
    docs = spark.createDataFrame(fixture(), DOC)
    real = P.Search._clashes
    monkeypatch.setattr(P.Search, "_clashes", lambda self, words, salt: salt in ("", "1") or real(self, words, salt))
    mining = P.Mining(least=6)
    assert sorted(tuple(r) for r in P.collocations(docs, mining).collect()) == sorted(brute(fixture(), mining))


def test_empty(spark):
    none = spark.createDataFrame([], DOC)
    assert P.collocations(none).collect() == []
    assert P.collocations(spark.createDataFrame([(1, None, None), (2, "a b", "en")], "doc_id bigint, text string, lang string")).collect() == []
