"""Every registered query of operators 1 to 13, and the pipeline, over odd and empty tables: nulls in each column, empty and
very long texts, repeated rows, and extra columns whose names clash with those that operators make."""

import math

import pytest

import __spark_entry__
from pagelens.llm import registry

from .test_first import SCHEMA, corpus

EXTRA = ", doc string, t string, w int, a bigint, b bigint, node bigint, component bigint, mark int, classes string, label string, embedding string, component_id bigint"
VECTORS = "vec_id bigint, embedding array<float>, label int, id string, copies int, a bigint, b bigint, node bigint, component bigint, beyond int, tile int, n_links string"
ITEMS = "item_id bigint, text string, window string, words string, n_words string"
TURNS = "conv_id bigint, turn bigint, role string, text string, id string, window_no string, formatted string"


def vectors():
    rng = [math.sin(i * 1.7) for i in range(16)]
    near = [x + 0.001 for x in rng]
    v = [(0, rng, 1), (1, near, 1), (2, rng, 1), (3, rng, 2), (4, rng, None), (5, None, 1), (6, [0.0] * 16, 1), (7, [*rng[:-1], float("nan")], 1), (8, [*rng[:-1], None], 1), (9, [*rng[:-1], float("inf")], 1)]
    v += [(None, rng, 1), (10, [], 1), (11, [-x for x in rng], 1), v[1], (12, rng[:8], 1)]
    return [(*x, "z", 7, 7, 7, 7, 7, 7, 7, "z") for x in v]


def turns():
    t = [(0, 0, "system", "be brief"), (0, 1, "user", "[INST] \\ </s>"), (0, 2, "assistant", "ok " * 30_000), (1, 0, "user", None), (1, 0, "assistant", ""), (1, 0, "assistant", "x")]
    t += [(2, None, None, None), (None, 0, "user", "whose"), (None, None, "assistant", "nobody's"), t[1], (3, 0, "assistant", "first"), (4, 9, "other role\n", "é\x00 \U0001f600")]
    return [(*x, "z", "z", "z") for x in t]


def items():
    t = [(0, "one two three"), (1, None), (2, ""), (None, "nobody's item of a few words"), (3, "x " * 20_000), (0, "again under one id")]
    return [(*x, "z", "z", "z") for x in t]


@pytest.fixture(scope="module", params=["odd", "empty"])
def tables(spark, request, tmp_path_factory):
    at = tmp_path_factory.mktemp(request.param)
    texts = [(*r, "z", "z", 7, 7, 7, 7, 7, 7, "z", "z", "z", 7) for r in corpus()]
    rows = {"documents": (texts, SCHEMA + EXTRA), "embeddings": (vectors(), VECTORS), "conversations": (turns(), TURNS), "benchmark": (items(), ITEMS)}
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data if request.param == "odd" else [], schema).write.parquet(f"{at}/{name}.parquet")
    n = {k: len(v[0]) if request.param == "odd" else 0 for k, v in rows.items()}
    n["conversations"] = len({t[0] for t in turns()} if n["conversations"] else ()) + 1
    return str(at), n


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, tables, name):
    at, n = tables
    out = registry.queries()[name](spark, at)
    got = out.collect()
    assert len(set(out.columns)) == len(out.columns)
    if name.split("_")[0] in ("op11", "op13"):  # a row for a phrase or a pair; tests of their own say which
        return
    assert len(got) == n[{"op5": "embeddings", "op7": "conversations"}.get(name.split("_")[0], "documents")]
    if name.startswith("op5_") and got:
        by_id = {r.vec_id: r for r in got}
        assert [by_id[i].component_id for i in (0, 1, 2)] == [0, 0, 0] and [by_id[i].n_links for i in (0, 1, 2)] == [2, 2, 2]
        assert all(by_id[i].n_links == 0 and by_id[i].kept for i in range(3, 13))
    if name.startswith("op8_"):
        assert all(r.score <= 0 and math.isfinite(r.score) and r.n_tokens >= 1 for r in got)


def test_pipeline(spark, tables):
    at, n = tables
    got = __spark_entry__.queries()["pipeline"](spark, at).collect()
    assert len(got) <= n["documents"] and bool(got) == bool(n["documents"])
