"""Benchmark decontamination against brute force."""

import hashlib
import random
import re

import pytest

from pagelens.llm import decontamination as D

DOC = "doc_id bigint, text string, words string, window bigint, n_words string, row string, key int"
ITEM = "item_id bigint, text string, words string, window string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        w, hit, named = split(text), set(), set()
        for item_id, t in items:
            i = split(t)
            for s in range(max(1, len(i) - size + 1) if i else 0):
                win = i[s : s + size]
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        hit.update(range(at, at + len(win)))
                        if item_id is not None:
                            named.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(named), sorted(named), bool(hit)))
    return out


def fixture():
    rng = random.Random(5)
    word = lambda n=60: f"w{rng.randrange(n)}é" if rng.random() < 0.2 else f"w{rng.randrange(n)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((1, 2, 3, 9, 10, 11, 30))))) for i in range(25)]
    items = [(i, t) for i, t in items if len(split(t)) > 2 or i < 4]
    items += [(90, "same prompt for all of these items here and now, " + "x y z"), (91, "Same prompt for ALL of these items here and now, a b"), (92, None), (93, "... !"), (None, "nobody owns this passage of ten words and one more"), items[6], (90, "the the the the the the the the the the the")]
    docs = []
    for k in range(40):
        t = [word() for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            i = split(rng.choice(items)[1])
            cut = rng.randrange(3)
            t += [*i[cut : len(i) - rng.randrange(3)], *(word() for _ in range(rng.randrange(4)))]
        docs.append((k, ", ".join(t)))
    docs += [(50, None), (51, ""), (52, " .\n"), (None, "Nobody owns\nthis passage of TEN words and one more!"), (1, docs[3][1]), docs[3], (53, "the " * 400), (54, "É é " + "w1 " * 12), (55, "same prompt for all of these items here and now"), (56, "x" * 300_000)]
    return docs, items


@pytest.mark.parametrize("overlap", [D.Overlap(), D.Overlap(block_bytes=400), D.Overlap(shingle=5), D.Overlap(shingle=1, words=4)])
def test_windows_are_found_whole(spark, overlap):
    docs, items = fixture()
    d = spark.createDataFrame([(*r, "z", 7, "z", "z", 7) for r in docs], DOC)
    b = spark.createDataFrame([(*r, "z", "z") for r in items], ITEM)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in D.contamination(d, b, overlap).collect()]
    want = brute(docs, items, overlap.words)
    assert 10 < sum(r[5] for r in want) and any(not r[5] and r[1] > 20 for r in want)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty_tables(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert D.contamination(d.where("FALSE"), b).collect() == []
    clean = D.contamination(d, b.where("FALSE")).collect()
    assert len(clean) == len(docs) and not any(r.contaminated or r.n_hit or r["items"] for r in clean)
    assert D.contamination(d.where("doc_id = 50"), b.where("item_id = 92")).collect()[0].n_words == 0


def test_digest_of_no_items(spark, tmp_path):
    spark.createDataFrame([(1, "clean")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "other words")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = D.op12_decontaminate(spark, str(tmp_path)).collect()[0]
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest() and not row.contaminated


def test_no_python_on_executors(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert "Python" not in D.contamination(d, b)._jdf.queryExecution().executedPlan().toString()
