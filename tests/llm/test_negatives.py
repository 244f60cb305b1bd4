"""Hard negatives against brute force, and how much the tree leaves out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.llm import negatives as N

VECTOR = "vec_id bigint, label int, embedding array<float>, id string, sig string, leaf int, anchor string, windows int"


def fixture(n=260, dim=12, clusters=9):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((clusters, dim))
    rows = []
    for i in range(n):
        c = 0 if i % 3 == 0 else i % clusters  # one cluster holds a third of all rows
        v = centres[c] + 0.15 * rng.standard_normal(dim)
        rows.append((i, int(c % 4) if i % 5 else int(rng.integers(4)), (v / np.linalg.norm(v)).astype(np.float32).tolist()))
    same = rows[100][2]
    rows += [(n + k, k % 2, same) for k in range(30)]  # ties: copies under two labels
    rows += [(100, 3, same), (100, rows[100][1], rows[5][2]), rows[50], rows[50]]  # one id, other rows; repeated rows
    odd = [(1000, None, same), (1050, 1, None), (None, 1, same), (1100, 1, [*same[:-1], None]), (1150, 1, [*same[:-1], math.nan]), (1200, 1, [*same[:-1], math.inf])]
    other = [(1250 + k, k % 2, [0.5, 0.25 + k / 16]) for k in range(9)] + [(1300, 0, []), (1301, 0, []), (1302, 1, []), (1350, 2, [0.0] * dim), (1351, 2, [0.0] * dim)]
    return [(*r, "z", "z", 7, "z", 7) for r in rows + odd + other]


def brute(rows, search):
    clean = {}
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean[(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v))] = None
    clean, out = list(clean), []
    for a in clean:
        if a[0] % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b) for b in clean if b is not a and len(b[2]) == len(a[2])]
        for p, i, b in sorted((s for s in scored if s[2][1] == a[1]), key=lambda s: s[:2])[: search.positives]:
            hits = [s for s in scored if s[2][1] != a[1] and search.low * -p <= 100 * -s[0] <= search.high * -p]
            out += [(a[0], i, r + 1, j, -p, -s) for r, (s, j, _) in enumerate(sorted(hits, key=lambda s: s[:2])[: search.negatives])]
    return sorted(out)


def frame(spark, rows):
    return N.prepared(spark.createDataFrame(rows, VECTOR).withColumn("anchor", F.col("vec_id") % 50 == 0), F.col("label"))


@pytest.mark.parametrize("search", [N.Search(), N.Search(ways=3, piece=7, block=2, sample=90), N.Search(ways=4, depth=3, sample=5000, low=-50, high=120, positives=2, negatives=4), N.Search(sample=1)])
def test_hard_negatives(spark, search):
    rows = fixture()
    got = sorted(tuple(r) for r in N.mine(frame(spark, rows), search).collect())
    assert len(got) > 40 and got == brute(rows, search)


def test_empty_table(spark):
    assert N.mine(frame(spark, [])).collect() == []
    assert N.mine(frame(spark, [r for r in fixture() if r[0] is None])).collect() == []


def test_ranges_leave_out_leaves_but_no_row(spark):
    """In clustered data an annulus near the anchor leaves out most leaves, and none that holds a row of the window."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    data = [(i, i % 5, ((v := centres[i % 12] + 0.1 * rng.standard_normal(16)) / np.linalg.norm(v)).astype(np.float32).tolist(), "z", "z", 7, "z", 7) for i in range(1500)]
    rows = frame(spark, data).cache()
    search = N.Search(ways=8)
    trees = N.fit(rows, search)
    placed = N.index(rows, trees).toPandas()
    tree, x = trees[16], np.array(placed["vec"].tolist(), np.float64)
    q = x[placed["id"].to_numpy() % 50 == 0]
    scores = q @ x.T
    cut = np.sort(scores, axis=1)[:, -5:-4]
    to = lambda s: np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + tree.length**2 - 2 * s, 0))
    stands = tree.standing(q, to(np.full_like(cut, 2.0**40)), to(cut))
    held = np.zeros_like(stands)
    for k, leaf in enumerate(placed["leaf"]):
        held[:, leaf] |= scores[:, k] >= cut[:, 0]
    assert tree.leaves > 20 and (stands | ~held).all() and stands.mean() < 0.5
