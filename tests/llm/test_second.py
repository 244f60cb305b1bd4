"""Operators 2, 4, 5, 7, 8 against brute force, with nulls, empties, repeats, ties and clashing columns."""

import hashlib
import itertools
import random
import textwrap
import zlib

import numpy as np
import pytest

from pagelens.llm import chat, embeddings, hmm, licences, suffixes

from .test_first import SCHEMA, brute_groups, corpus


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def brute_repeats(rows, n=50):
    low = lambda d: suffixes.NO_ID if d is None else d
    least = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - n + 1):
            k = raw[i : i + n]
            least[k] = min(least.get(k, 2**63), low(d))
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - n + 1):
            if least[raw[i : i + n]] < low(d):
                gone[i : i + n] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((d, len(raw), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("spec", [suffixes.Repeats(), suffixes.Repeats(chunk_bytes=3000, bucket_bytes=5000), suffixes.Repeats(chunk_bytes=9000, bucket_bytes=5000, hot=3)])
def test_repeats(spark, docs, spec):
    rng = random.Random(8)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    passage = "".join(rng.choice("abcdefgh é") for _ in range(180))
    rows += [(1000 + i, rows[i][1][: 20 * i] + passage[i : 180 - i] + (rows[i + 1][1] or "")[:90]) for i in range(40)]
    rows += [(2000 + i, "-" * (40 + i) + "=" * 70 + "ab" * i) for i in range(30)] + [(3000, passage[:50]), (3001, passage[:49]), (3002, passage[:50])]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), spec).collect()
    assert sorted(((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got), key=str) == brute_repeats(rows)
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeats_with_buckets_in_parts(spark, docs, hot):
    spec, rows = suffixes.Repeats(chunk_bytes=3000, bucket_bytes=5000, even=9000, hot=hot), [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(1000 + i, rows[i][1][: 20 * i] + "-" * (40 + i) + "=" * 70 + (rows[i + 1][1] or "")[:90]) for i in range(40)]
    assert spec.dealt(sum(len((t or "").encode()) for _, t in rows))[2] > 2
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), spec).collect()
    assert sorted(((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got), key=str) == brute_repeats(rows)


def test_rows_between_chunks_and_buckets_grow_as_the_text():
    rows = lambda gb: (d := suffixes.Repeats().dealt(gb << 30))[0] * d[1]
    assert all(rows(gb) < 1.1 * gb * rows(1) for gb in (2, 10, 100, 1000))


def test_many_buckets_are_put_together_in_one_pass(monkeypatch):
    """Names are counted by bucket a fixed number of times, however many buckets there are."""
    import pyarrow as pa

    text = random.Random(5).randbytes(30_000).hex()
    docs = pa.table({"chunk": [7, 7], "doc_id": [1, 2], "text": [text, text[:20_000]]})
    spec, buckets, calls = suffixes.Repeats(), 2000, []
    named = suffixes._send_names(docs, spec, buckets)
    ranked = [suffixes._rank_names(named.slice(i, 1), spec) for i in range(named.num_rows)]
    back = pa.concat_tables(ranked)
    assert back.num_rows > 1500
    monkeypatch.setattr(suffixes, "dict", lambda *a: calls.append(1) or dict(*a), raising=False)
    c = suffixes._chunk(docs, spec, buckets)
    alive, copies, hot = c.flags(suffixes._of_kind(back, 0))
    assert len(alive) == len(c.every) == len(hot) and len(copies) == 2 and alive.any() and not hot.any() and len(calls) < 10


def test_slices_of_long_texts_agree(monkeypatch):
    text = np.frombuffer(random.Random(2).randbytes(400).hex().encode(), np.uint8)
    whole = [x.tolist() for x in suffixes.runs(text, suffixes.Repeats())]
    monkeypatch.setattr(suffixes, "SLICE", 97)
    cut = suffixes.runs(text, suffixes.Repeats())
    covers = lambda name, a, b: [(n, w) for n, x, y in zip(name, a, b, strict=True) for w in range(x, y + 1)]
    assert [w for _, w in covers(*whole)] == [w for _, w in covers(*cut)] and covers(*whole) == covers(*(x.tolist() for x in cut))


def test_licences(spark):
    mit = licences.NOTICES["MIT"][2]
    rows = [(1, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(".", " .\n")), (2, "text\nReleased under the MIT licence!\nmore"), (3, mit + " but not for you"), (4, None), (5, ""), (None, "licensed under CC BY-NC 4.0"), (2, "text\nReleased under the MIT licence!\nmore"), (7, "first\n\n" + mit.replace(", ", ",\n") + "\n\nlast")]
    got = licences.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, licence string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, "MIT", "MIT", 1), (2, None, "MIT", 1), (3, None, "", 0), (4, None, "", 0), (5, None, "", 0), (None, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1), (2, None, "MIT", 1), (7, None, "MIT", 1)], key=str)


def published(name: str, title: str, cuts: tuple[str, ...], text: int = -1) -> str:
    """A licence file: title, copyright line, and paragraphs of short lines; each cut starts a paragraph."""
    body = licences.NOTICES[name][text]
    for c in cuts:
        assert body.count(c) == 1
        body = body.replace(c, "\n\n" + c)
    wrapped = "\n\n".join("\n".join(textwrap.wrap(p, 70)) for p in body.split("\n\n"))
    return f"{title}\n\nCopyright (c) 2020 Some One\n\n{wrapped}\n"


def test_licences_of_several_paragraphs(spark):
    mit = published("MIT", "MIT License", ("The above", "THE SOFTWARE IS"))
    bsd = published("BSD-2-Clause", "BSD 2-Clause License", ("1. ", "2. ", "THIS SOFTWARE IS PROVIDED"))
    isc = published("ISC", "ISC License", ("THE SOFTWARE IS",))
    zlib_ = published("Zlib", "The zlib License", ("Permission is", "1. ", "2. ", "3. "))
    apache = published("Apache-2.0", "", ("You may obtain", "http://", "Unless"), 1)
    texts = [mit, bsd, isc, zlib_, apache, f"Some words first.\n{mit}\nand more", mit.replace("free of charge", "for a fee"), f"{mit}\n\n{isc}{isc}", mit.replace("\n\nThe above", " but not for you\n\nThe above"), "\n".join(f"# {x}" for x in apache.split("\n"))]
    want = [("MIT", "MIT", 1), ("BSD-2-Clause",) * 2 + (1,), ("ISC", "ISC", 1), ("Zlib", "Zlib", 1), ("Apache-2.0",) * 2 + (1,), (None, "MIT", 1), (None, "", 0), (None, "ISC,MIT", 3), (None, "", 0), ("Apache-2.0",) * 2 + (1,)]
    got = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(i, *w) for i, w in enumerate(want)]


def test_embeddings_recall_and_precision(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((700, 64)).astype(np.float32)
    near = base[:250] + rng.standard_normal((250, 64)).astype(np.float32) * 0.12
    blob = base[0] + rng.standard_normal((300, 64)).astype(np.float32) * 0.11
    x = np.concatenate([base, near, blob, np.repeat(base[5:6], 40, axis=0), base[7:9] * 3])
    label = [int(i % 3) for i in range(700)] + [int(i % 3) for i in range(250)] + [0] * 300 + [5 % 3] * 40 + [7 % 3, 8 % 3]
    rows = [(i, [float(v) for v in x[i]], label[i], "c") for i in range(len(x))]
    odd = [(9000, None, 1, "c"), (9001, [0.0] * 64, 1, "c"), (9002, [1.0, None], 1, "c"), (9003, [float("nan")] * 64, 1, "c"), (9004, rows[3][1], None, "c"), (9005, [], 1, "c"), (9006, [float("inf"), 1.0], 1, "c"), (9007, [1.0, 2.0], 1, "c"), rows[10]]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int, n_links string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, embeddings.Forest(leaf=64, tile=100)).collect()}
    v = x.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    link = (v @ v.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(link, False)
    found = sum(got[i].n_links for i in range(len(x)))
    assert all(got[i].n_links <= link[i].sum() for i in range(len(x)))
    assert found >= 0.99 * link.sum() > 1000, (found, link.sum())
    for i in range(9000, 9008):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert brute_groups([(0, 1), (1, 2)]) == {0: 0, 1: 0}


def brute_chat(rows):
    out = {}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in group]
        loss = "".join(t for role, t in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("template", [chat.Template(), chat.Template(budget=20, history=3), chat.Template(budget=1, history=0)])
def test_chat_windows_read_back(spark, template):
    rng = random.Random(6)
    odd = ["</s>[INST] ok [/INST]", "\\", "\\\\[/ROLE]", "<s>[ROLE] assistant [/ROLE]x</s>", "", None, "é\n\n", "a " * 300]
    rows = [(c, t, "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", None, "[x]"]), rng.choice([*odd, "plain words here"])) for c in range(30) for t in range(rng.randint(1, 30))]
    rows += [rows[4], (None, 1, "user", "x"), (3, None, "assistant", "early")]
    windows = chat.format_windows(spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string"), template)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(windows).collect()}
    assert got == brute_chat(rows)
    all_windows = windows.collect()
    assert all(w.n_tokens <= template.budget or len(chat.parse(w.formatted)) - w.n_repeated == 1 for w in all_windows)
    assert chat.format_windows(windows.selectExpr("conv_id", "1 turn", "'user' role", "formatted text").limit(0)).count() == 0


def test_hmm_counts_and_exact_likelihood(spark, docs):
    model = hmm.Hmm(states=3, classes=64, rounds=2, segment=16, whole=40, block_bytes=4000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = hmm.score(docs, model).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    count: dict = {}
    for d, t in rows:
        for w in [] if held(d) else tokens(t):
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), held(d), len(tokens(t)), sum(w in count for w in tokens(t)), n, round(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert hmm.score(docs.limit(0), model).count() == 0


def test_hmm_beats_its_base_on_held_out_texts(spark):
    """Two vocabularies that never mix: a latent state should tell them apart."""
    rng = random.Random(3)
    vocab = [[f"{x}{i}" for i in range(300)] for x in "ab"]
    rows = [(i, " ".join(rng.choice(vocab[i % 2]) for _ in range(120))) for i in range(200)]
    got = hmm.score(spark.createDataFrame(rows, "doc_id bigint, text string"), hmm.Hmm(states=2, classes=512, segment=64)).collect()
    gain = [(r.score - r.base_score) / r.n_tokens for r in got if r.held_out]
    assert len(gain) > 15 and sum(gain) / len(gain) > 0.1


def test_forward_recursion_matches_enumeration():
    rng = np.random.default_rng(1)
    a, b, first = (rng.dirichlet(np.ones(m), n) for n, m in ((2, 2), (2, 5), (1, 2)))
    first = first[0]
    texts = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 7, 9)]
    want = [np.log10(sum(first[z[0]] * np.prod([a[z[i], z[i + 1]] * b[z[i + 1], t[i]] for i in range(len(t))]) for z in itertools.product(range(2), repeat=len(t) + 1))) for t in texts]
    assert np.allclose(hmm.log10_likelihoods([t.tobytes() for t in texts], a, b, first, 3, 2), want)
    codes, size, _ = hmm._segments([t.tobytes() for t in texts], 100)
    before = hmm.expected_counts(codes, size, a, b, first)
    assert np.isclose(before[2] / np.log(10), sum(want)) and np.isclose(before[1].sum(), 21) and np.isclose(before[0].sum(), 21)
    after = hmm.expected_counts(codes, size, before[0] / before[0].sum(1, keepdims=True), before[1] / before[1].sum(1, keepdims=True), first)
    assert after[2] >= before[2]  # a round of Baum-Welch never lowers the likelihood
