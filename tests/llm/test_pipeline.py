"""The pipeline against a brute-force version of its stages, and the registry's contract."""

import hashlib
import os
import struct

import numpy as np

import __spark_entry__
import corpus_pipeline
from pagelens.llm import bpe, lines, mixing, quality

from .test_first import brute_lines, corpus
from .test_third import similar_groups

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_follow_one_another(spark, tmp_path):
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in corpus() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    os.makedirs(tmp_path / "documents.parquet", exist_ok=True)
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    judged = quality.assess(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).where("kept").select("doc.doc_id").collect()
    left = {r[0]: list(r) for r in rows if r[0] in {j.doc_id for j in judged}}
    for d, _, dropped, text in brute_lines([(d, r[1]) for d, r in left.items()]):
        if dropped:
            left[d][1], left[d][4] = text, len(text)
    groups = similar_groups(sorted((d, r[1]) for d, r in left.items()))
    left = {d: r for d, r in left.items() if groups[d] == d}

    words = {d: len((r[1] or "").encode().split()) for d, r in left.items()}
    cell = {d: (r[3], r[2], topic(r[1] or "", words[d])) for d, r in left.items()}
    weight = brute_rake(words, cell, mixing.Mix())
    draw = {d: int(hashlib.md5(str(d).encode()).hexdigest()[:12], 16) / 2**48 for d in left}
    left = {d: r for d, r in left.items() if draw[d] < weight[cell[d]]}

    assert set(got) == set(left) and len(got) > 20
    import public_tokenizers as P

    enc = bpe.Bpe(open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), P.PATTERN)
    for d, r in left.items():
        ids = [i for piece in enc.split(r[1] or "") for i in enc.encode_piece(piece.encode())]
        assert got[d].n_tokens == len(ids) and got[d].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest()


def topic(text: str, n: int) -> str:
    return "table" if text.count("|") * 5 >= max(n, 1) else "list" if (text.count("\n") + 1) * 8 >= n else "prose"


def brute_rake(words: dict, cell: dict, mix: mixing.Mix) -> dict:
    """Probability of each cell."""
    tokens: dict = {}
    for d, c in cell.items():
        tokens[c] = tokens.get(c, 0) + words[d]
    dims, share = list(mix.powers.items()), []
    wanted = sum(tokens.values()) * mix.rate
    for k, (_, power) in enumerate(dims):
        by: dict = {}
        for c, n in tokens.items():
            by[c[k]] = by.get(c[k], 0) + n
        raised = {key: n**power for key, n in by.items()}
        share.append({key: x / sum(raised.values()) for key, x in raised.items()})
        wanted = min([wanted, *(mix.slack * by[key] / x for key, x in share[k].items() if x)])
    w = {c: n * wanted / sum(tokens.values()) for c, n in tokens.items()}

    def margins(k):
        out: dict = {}
        for c, x in w.items():
            out[c[k]] = out.get(c[k], 0.0) + x
        return out

    for check in range(1, mix.lowered * mix.patience + 1):
        for _ in range(mix.rounds):
            for k in range(len(dims)):
                margin = margins(k)
                w = {c: min(x * share[k][c[k]] * wanted / margin[c[k]], tokens[c]) if margin[c[k]] > 0 else 0.0 for c, x in w.items()}
        if all(abs(x / wanted - share[k][key]) <= mix.tolerance for k in range(len(dims)) for key, x in margins(k).items()):
            break
        wanted *= 1.0 if check % mix.patience else 0.9
    return {c: min(1.0, w[c] / tokens[c]) if tokens[c] else 0.0 for c in tokens}


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    rows = [(*r[:5], "more") for r in corpus()]
    docs = spark.createDataFrame(rows, SCHEMA + ", kept string")
    for docs_in in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs_in, "")
            assert out.columns == docs.columns and out.count() <= len(rows)


def test_registry():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
    assert lines.LineRules().min_docs == 5 and np.uint64(1)
