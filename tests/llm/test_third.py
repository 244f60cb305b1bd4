"""Similarity links, repeated and null ids, and trees that split, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.llm import chat, embeddings, simhash

from .test_first import brute_groups, corpus, naive_fingerprint

DOC = "doc_id bigint, text string"


def near_texts():
    """Groups of copies with ever more words changed, chains of them, and texts of few or no words."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(9000)}"
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.randint(60, 400))]
        for k in range(8):
            t = list(base)
            for _ in range(k * len(t) // 200):
                t[rng.randrange(len(t))] = word()
            rows.append(" ".join(t))
    rows += ["", None, " \n", "one two", "ONE  two", "one two three", *rows[:3]]
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


def naive_sets(text, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def similar_groups(rows, least=0.8):
    """rows: (id, text), ids distinct. Group of each, by its smallest id."""
    sets, label = [(d, naive_sets(t)) for d, t in rows], {d: d for d, _ in rows}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if len(x & y) >= least * len(x | y):
                u, v = top(a), top(b)
                label[max(u, v)] = min(u, v)
    return {d: top(d) for d, _ in rows}


@pytest.mark.parametrize("tile", [5, 4096])
def test_similar_texts_keep_one_of_each_group(spark, tile):
    rows = near_texts()
    groups = similar_groups(rows)
    assert 12 < len(set(groups.values())) < len(rows) - 30
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOC + ", fp string")
    out = simhash.drop_near_duplicates(docs, simhash.Similar(tile=tile))
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(set(groups.values()))
    assert simhash.drop_near_duplicates(docs.limit(0), simhash.Similar()).count() == 0


def test_similarity_of_very_large_sets():
    from pagelens.llm import simhash

    rng = np.random.default_rng(1)
    for n in (1, 10, 70_000, 200_000):
        x = np.unique(rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32))
        y = np.unique(np.concatenate([x[: len(x) * 9 // 10], rng.integers(0, 1 << 32, n // 10, np.uint64).astype(np.uint32)]))
        both = len(np.intersect1d(x, y))
        assert simhash.jaccard(x, y) == simhash.jaccard(y, x) == both / (len(x) + len(y) - both)
    assert simhash.jaccard(x[:0], y) == 0


def test_repeated_and_null_ids_link(spark):
    """A row without an id joins two documents; a repeated id joins its two texts."""
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(3)]
    bits = lambda a, b: (naive_fingerprint(a) ^ naive_fingerprint(b)).bit_count()
    chain = [texts[0]]
    while len(chain) < 3:
        w = chain[-1].split()
        w[rng.randrange(3, len(w))] = f"n{rng.randrange(10**6)}"
        t = " ".join(w)
        if 0 < bits(t, chain[-1]) <= 3 and (len(chain) < 2 or bits(t, chain[0]) > 3):
            chain.append(t)
    rows = [(9, chain[0]), (None, chain[1]), (4, chain[2]), (7, texts[1]), (7, texts[2]), (8, texts[2]), (None, "alone")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()), key=str)
    assert got == sorted([(9, 4), (None, 4), (4, 4), (7, 7), (7, 7), (8, 7), (None, None)], key=str)


@pytest.mark.parametrize("blocks", [4, 5, 6])
def test_links_at_every_number_of_blocks(spark, blocks):
    rng = np.random.default_rng(blocks)
    base = [int(x) for x in rng.integers(0, 2**64, 150, np.uint64)]
    near = [b ^ int(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), False))) for b in base for _ in range(3)]
    fps = sorted({*base, *near})
    n = {4: 10, 5: 1 << 20, 6: 1 << 25}[blocks]
    assert simhash.block_count(n) == blocks
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    found = simhash.components(simhash.links(spark.createDataFrame(rows, "fp bigint, rep bigint"), n)).collect()
    want = brute_groups(list(enumerate(fps)))
    assert {i: i for i in want} | {r.node: r.component for r in found} == want


def test_chat_of_one_conversation_to_a_partition(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "yo"), (5, 0, "system", "long " * 3000), *((5, t, "user", "hi") for t in range(1, 201))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            windows = chat.format_windows(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))
            got = {r.conv_id: r for r in chat.digests(windows).collect()}
            assert got[None].n_turns == 2 and got[None].loss_chars == 2 and got[5].n_turns == 201
            assert got[5].formatted_chars < 30_000 and got[5].n_windows == 2  # the system turn isn't repeated
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_chat_query_formats_the_extra_conversation(spark):
    import hashlib

    got = {r.conv_id: r for r in chat.op7_chat_format(spark, "/root/testdata/sf0.001").collect()}[-1]
    text = "</s>[INST] ok [/INST]"
    want = hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == (2, want, len(text), hashlib.sha256(text.encode()).hexdigest())


def links_of(x, label):
    v = x.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    link = (v @ v.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    return link


@pytest.mark.parametrize("dim", [64, 256, 768])
def test_default_forest_splits_and_finds_links(spark, dim):
    """Production parameters, one label, trees that split some levels deep; a tight cluster counts all its pairs."""
    rng = np.random.default_rng(dim)
    base = rng.standard_normal((3200, dim)).astype(np.float32)
    near = np.concatenate([base[:1300] + rng.standard_normal((1300, dim)).astype(np.float32) * s for s in (0.1, 0.17)])
    x = np.concatenate([base, near, base[0] + rng.standard_normal((300, dim)).astype(np.float32) * 0.1])
    label = np.ones(len(x), int)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int").repartition(4)
    forest = embeddings.Forest()
    rows = embeddings.keyed(df).select(F.col("node").alias("id"), "kind", "embedding")
    leaves = embeddings.leaf_table(rows, forest)
    assert leaves.select("leaf").distinct().count() > 40 and leaves.count() <= 3 * forest.trees * len(x)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, forest).collect()}
    want = links_of(x, label)
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= want.sum(axis=1)).all() and n.sum() >= 0.97 * want.sum() > 80_000, n.sum() / want.sum()


def test_null_vec_id_joins_groups(spark):
    a = np.zeros(8)
    a[0] = 1.0
    turn = lambda t: [float(np.cos(t)), float(np.sin(t)), *[0.0] * 6]
    rows = [(9, turn(0), 1), (None, turn(0.19), 1), (4, turn(0.38), 1), (None, turn(2.0), 1), (6, turn(0.19), 2), (7, turn(0), 1), (7, turn(1.0), 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(9, 1, 4, False), (None, 3, 4, False), (4, 0, 4, True), (None, 0, None, False), (6, 0, 6, True), (7, 1, 4, False), (7, 0, 7, True)], key=str)


def test_odd_corpus_through_the_similar_stage(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], DOC)
    groups = similar_groups(sorted({r[0]: r[1] for r in rows if r[0] is not None}.items()))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs, simhash.Similar()).collect()}
    assert kept - {None} == set(groups.values())


def test_pieces_of_a_batch_merge_as_each_alone():
    """One list and queue for many pre-tokens, against tiktoken; with merges whose new pair has a lower rank."""
    import base64

    import public_tokenizers as P
    import tiktoken

    from pagelens.llm import bpe

    tokens = [bytes([c]) for c in range(256)] + [b"ab", b"abc", b"de", b"bc", b"cde", b"aa", b"aaa", b"abcde", b"aaaa"]
    own = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
    for raw, alphabet in ((own, "abcdex"), (open(P.path("byte_bpe_multi_50k.tiktoken"), "rb").read(), "abcdefghinortsu éü漢")):
        b = bpe.Bpe(raw, P.PATTERN)
        enc = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=b.ranks, special_tokens={})
        rng = random.Random(5)
        pieces = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 5, 9, 40]))) for _ in range(3000)] + ["a" * 50_000, "abcde" * 9_001]
        assert b.encode_pieces([p.encode() for p in pieces]) == [enc.encode_ordinary(p) for p in pieces]
        assert not b.queue.top and not any(b.queue.low) and not b.queue.buckets


def test_default_mix_meets_its_targets(spark):
    """Shares of the weights and the rate of the drawn tokens, with the parameters of the query, on the given tables."""
    from pagelens.llm import mixing

    mix = mixing.Mix()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cells = mixing.count_tokens(docs, ["doc_id"]).groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    out = mixing.rake(cells, mix).toPandas()
    assert (out.weight <= out.tokens * (1 + 1e-9)).all() and out.residual.max() <= mix.tolerance and out.wanted[0] > 0.5 * out.tokens.sum()
    for d, p in mix.powers.items():
        by = out.groupby(d, dropna=False)[["tokens", "weight"]].sum()
        assert (by.weight / out.weight.sum() - by.tokens**p / (by.tokens**p).sum()).abs().max() < 0.002


def test_given_targets_and_keys_that_they_leave_out(spark):
    from pagelens.llm import mixing

    rows = [(s, lang, topic, n * (3 if lang else 1) * (2 if topic == "prose" else 1)) for s, n in (("a", 100), ("b", 50), (None, 20), ("c", 10), ("z", 0)) for lang in ("en", None) for topic in ("prose", "list")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    target = spark.createDataFrame([("b", 0.3), (None, 0.1), ("nowhere", 0.5)], "key string, share double")
    shares = {r.key: r.share for r in mixing.target_shares(cells, "source", mixing.Mix(), target).collect()}
    assert shares == pytest.approx({"b": 0.3, None: 0.1, "a": 0.6 * 10 / 11, "c": 0.6 / 11, "z": 0.0})
    out = mixing.rake(cells, mixing.Mix(), {"source": target}).toPandas()
    got = out.fillna("-").groupby("source").weight.sum() / out.weight.sum()
    assert out.residual.max() <= 0.001 and abs(got["b"] - 0.3) < 0.002 and abs(got["-"] - 0.1) < 0.002
    assert mixing.rake(cells.limit(0)).count() == 0


def test_training_carries_the_state_over_segments():
    """Counts of long texts cut into segments are those of the whole texts."""
    from pagelens.llm import hmm

    rng = np.random.default_rng(9)
    a, b = rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(7), 3)
    first = rng.dirichlet(np.ones(3))
    texts = [rng.integers(0, 7, n).astype(np.uint16).tobytes() for n in (1, 5, 64, 65, 300, 7, 129)]
    whole = hmm.text_counts(texts, hmm.Hmm(whole=10_000), a, b, first)
    for batch in (1 << 18, 100):
        cut = hmm.text_counts(texts, hmm.Hmm(whole=20, segment=16, batch_tokens=batch), a, b, first)
        assert all(np.allclose(x, y) for x, y in zip(whole, cut, strict=True))
    assert np.isclose(whole[3].sum(), len(texts)) and np.isclose(whole[1].sum(), sum(len(t) // 2 for t in texts))


def test_equal_names_of_different_strings_remove_nothing(monkeypatch):
    """All windows of a bucket get one name: bytes still tell them apart."""
    import pyarrow as pa

    from pagelens.llm import suffixes

    spec, rng = suffixes.Repeats(), random.Random(4)
    texts = [rng.randbytes(rng.randint(50, 80)) for _ in range(40)]
    texts += [texts[3], texts[5][:50] + b"x", b"y" + texts[7][-50:]]
    ids = [rng.randrange(20) for _ in texts]
    table = lambda: pa.table({"bucket": [0], "chunk": [0], "kind": [1], "a": [b"".join(texts)], "b": [bytes(map(len, texts))], "c": [np.array(ids, np.int64).tobytes()]})
    want = suffixes._rank_runs(table(), spec)
    least = {}
    for i, t in zip(ids, texts, strict=True):
        for k in range(len(t) - 49):
            least[t[k : k + 50]] = min(least.get(t[k : k + 50], 99), i)
    brute = [sum(1 << k for k in range(len(t) - 49) if least[t[k : k + 50]] < i) for i, t in zip(ids, texts, strict=True)]
    assert np.frombuffer(want[0], np.uint64).tolist() == brute and any(brute)
    monkeypatch.setattr(suffixes, "names", lambda x, length, family=0: np.zeros((*x.shape[:-1], x.shape[-1] - length + 1), np.uint64))
    assert suffixes._rank_runs(table(), spec) == want


def test_licence_rows_are_judged_by_themselves(spark, tmp_path):
    from pagelens.llm import licences

    rows = [(2, "Licensed under the MIT License.\nfoo"), (2, "Licensed under the MIT License. foo"), (None, "licensed under the MIT license\nx"), (None, "licensed under the mit license x"), (3, "Licence licence non-commercial non commercial")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in licences.scan(docs).collect()), key=str)
    assert got == sorted([(2, None, "MIT", 1), (2, None, "", 0), (None, None, "MIT", 1), (None, None, "", 0), (3, None, "", 0)], key=str)
    assert docs.where("doc_id = 3").select(licences.canonical(F.col("text"))).first()[0] == "license license noncommercial noncommercial"


def test_known_whole_texts(spark):
    """Each known text as a whole document; a long licence by the digest of its canonical form alone."""
    from pagelens.llm import licences

    rows = [(i, k, t) for i, (k, t) in enumerate((k, t) for k, ts in licences.NOTICES.items() for t in ts)]
    long = "Section 1.\n\nA licence of its own, with organisation.\n"
    digest = spark.createDataFrame([(long.upper(),)], "t string").select(F.sha2(licences.canonical(F.col("t")), 256)).first()[0]
    docs = spark.createDataFrame([(i, "(c) 2001 A. Body\n" + t.upper().replace(", ", ",\n")) for i, _, t in rows] + [(-1, long)], "doc_id bigint, text string")
    got = {r.doc_id: r.whole_licence for r in licences.scan(docs, digests={"Own-1.0": [digest]}).collect()}
    assert got == {i: k for i, k, _ in rows} | {-1: "Own-1.0"}
    assert all(len(d) == 64 for ds in licences.DIGESTS.values() for d in ds) and len(licences.DIGESTS) >= 13
