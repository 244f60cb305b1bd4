"""Operators 1, 3, 6, 9, 10 on small tables with nulls, empties, repeats and clashing columns."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagelens.llm import bpe, lines, mixing, quality, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, n_words bigint, fp bigint, weight double, id string"


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long_line = "This very same line stands at the foot of many documents, word for word"
    texts = [prose(rng.randint(40, 160)) for _ in range(60)]
    texts += [t + "\n" + long_line.upper() + " " for t in texts[:7]] + [texts[0]] * 3 + [t.replace(" ", "  ", 3) for t in texts[:5]]
    texts += ["", " \n\t", None, "one", "two words", "a b a b a b a b " * 20, "x" * 3000, prose(20_000), "é ² ½ 'll don't x\x1cy  \n", "%%% " * 80]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), len(t or ""), None, 7, 7, 7.0, "z") for i, t in enumerate(texts)]
    return rows + [rows[3], (None, texts[2], None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def test_quality_counts_and_carried_columns(spark, docs):
    out = quality.assess(docs, ["doc_id", "text"]).select("doc.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(out) == docs.count()
    for r in out:
        t = r.text or ""
        w = t.encode().split()
        win = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        full = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(hit), len(full) - len(set(full)))
        assert r.word_chars == sum(len(x.decode()) for x in w) and r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.filter_quality(docs).columns == docs.columns
    assert quality.filter_quality(docs.limit(0)).count() == 0


def brute_lines(rows, rules=lines.LineRules()):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    low = lambda d: lines.NO_ID if d is None else d
    held = collections.defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x).decode()) >= rules.min_chars:
                held[key(x)].add(low(d))
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(s := held.get(key(x), ())) >= rules.min_docs and max(s) != low(d))]
        out.append((d, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lines.drop_lines(docs).select("doc.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(((a, b, c, d or "") for a, b, c, d in got), key=str) == brute_lines(rows)
    assert sum(r.n_dropped for r in got) >= 6
    assert lines.drop_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_a_line_in_every_document(spark):
    """The hot key is dealt over partitions; counts and the holder come from their edges."""
    hot = "a line that every single document of this table holds, twice in some"
    rows = [(i // 2 if i < 60 else i, f"own text of document number {i}, which nobody else has at all\n{hot}\n{hot if i % 3 == 0 else i}") for i in range(2000)]
    got = lines.drop_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_lines(rows)


def naive_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(ids_fps):
    label = {i: i for i, _ in ids_fps}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, x) in enumerate(ids_fps):
        for b, y in ids_fps[:i]:
            if (x ^ y).bit_count() <= 3:
                u, v = top(a), top(b)
                label[max(u, v)] = min(u, v)
    return {a: top(a) for a, _ in ids_fps}


def test_simhash(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    texts = {(r.doc_id): r.text for r in docs.collect()}
    fps = {d: naive_fingerprint(t) for d, t in texts.items() if d is not None}
    groups = brute_groups(sorted(fps.items()))
    for r in got:
        if r.doc_id is not None:
            assert r.fp & (2**64 - 1) == fps[r.doc_id] and r.component_id == groups[r.doc_id]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()}
    assert kept - {None} == set(groups.values())


def test_a_row_of_its_own_stays_when_its_doc_id_is_also_on_a_copy(spark):
    rng = random.Random(7)
    one, two, three = (" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(3))
    close = next(t for t in (" ".join([*one.split()[:-2], f"end{i}"]) for i in range(99)) if 0 < (naive_fingerprint(t) ^ naive_fingerprint(one)).bit_count() <= 3)
    rows = [(1, one), (5, one), (5, two), (6, close), (6, three), (None, one), (8, ""), (9, None)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, one), (5, two), (6, three), (None, one), (8, "")], key=str)


@pytest.mark.parametrize("tile", [40, 4096])
def test_pivot_tables_find_every_component(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 300, np.uint64)
    near = [int(b) ^ int(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), False))) for b in base for _ in range(2)]
    chain = [int(base[0]) ^ int(1 << i) ^ int(1 << j) for i in range(14) for j in range(14)]
    fps = sorted({*map(int, base), *near, *chain})
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp bigint, rep bigint"), len(fps), tile)).collect()
    want = brute_groups([(i, f) for i, f in enumerate(fps)])
    got = {i: i for i in want} | {r.node: r.component for r in found}
    assert got == want


def test_mixing_meets_its_targets(spark, docs):
    cells = [(s, l, t, n) for s, l, t, n in [("a", "en", "prose", 1000), ("a", "de", "prose", 300), ("b", "en", "list", 500), ("b", "de", "prose", 700), (None, "en", "prose", 200), ("b", "de", "list", 100)]]
    mix = mixing.Mix(rate=0.3, rounds=40)
    out = mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint"), mix).toPandas()
    assert (out.weight <= out.tokens + 1e-9).all()
    for d, p in mix.powers.items():
        tokens = out.fillna("-").groupby(d).tokens.sum() ** p
        share = out.fillna("-").groupby(d).weight.sum() / (0.3 * 2800)
        assert np.allclose(share, tokens / tokens.sum(), atol=0.02)
    full = mixing.mix_documents(docs, ["doc_id"])
    assert full.count() == docs.count() and mixing.sample_documents(docs).columns == docs.columns
    assert mixing.sample_documents(docs.limit(0)).count() == 0


def test_bpe_matches_tiktoken(spark, docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    more = ["<|endoftext|> x", "naïve café – “quoted” ’s I'll'd've", "日本語 テキスト ١٢٣ Ⅷ½²", "a​ b\x85c\x1d \x1e d   \n\n e", "\U0001f600 ́ é", "_under_score__ 12ab34 a_b", "aaaa" * 500, "ab" * 3001, " " * 99 + "z", "\r\n\r\n \t x"]
    rows = [*((r.doc_id, r.text) for r in docs.collect()), *enumerate(more, 9000)]
    held = bpe.vocabulary(spark, path, P.PATTERN)
    out = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string"), held), held).select("doc.doc_id", "ids", "decoded").collect()
    texts = dict(rows)
    for r in out:
        t = texts[r.doc_id] or ""
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == enc.encode_ordinary(t), t[:80]
        assert bytes(r.decoded).decode() == t
    assert bpe.digests(docs.limit(0)).count() == 0
    assert {r.doc_id: r.ids_sha256 for r in bpe.digests(docs).collect()}[62] == hashlib.sha256(np.array(enc.encode_ordinary(texts[62] or ""), "<u4").tobytes()).hexdigest()


def test_rank_queue_orders_like_a_sorted_list():
    rng, q, held = random.Random(1), bpe.RankQueue(300_000), []
    for _ in range(4000):
        if held and rng.random() < 0.45:
            assert q.pop() == held.pop(held.index(min(held)))
        else:
            held.append((rng.randrange(300_000), rng.randrange(50)))
            q.push(*held[-1])
    assert [q.pop() for _ in held] == sorted(held) and q.pop() is None and not F.lit(1) is None
