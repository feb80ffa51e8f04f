"""Tokens, packing, rollups, search and classifiers against libraries, brute force and held-out rows."""

import base64
import hashlib
import random
import zlib
from array import array
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeframe.llm import additive_ann, bpe, byte_cnn, nnpu, packing, queries, token_rollup
from gaugeframe.llm._shared import shared_dir

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  a", "a  b \n\n c \n", "<|endoftext|> x", "a\n \nb", "  x 　y \x1c z", "日本語 🙂🙂 é  ", "'s 's a's", " " * 50 + "x", "a\n  b", "x" * 9000, "1,234.5 $%"]


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def raw(ids):
    return array("I", ids).tobytes()


def test_bpe_is_the_librarys(spark, reference):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(1, ODD[4], "x"), (None, "a", None)], "doc_id long, text string, ids string")
    for r in bpe.digests(docs).collect():
        t = "a" if r["doc_id"] is None else None
        options = [t] if t else [ODD[r["doc_id"]], *([ODD[4]] if r["doc_id"] == 1 else [])]
        want = [(len(reference.encode_ordinary(t or "")), hashlib.sha256(raw(reference.encode_ordinary(t or ""))).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for t in options]
        assert tuple(r)[1:] in want
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'a.é🙂  \x85\x1c,1"), st.characters(codec="utf-8")), max_size=60), max_size=8))
@settings(max_examples=80, deadline=None)
def test_bpe_of_any_text(texts):
    coder = bpe.vocabulary(bpe.default_path())
    ids = coder.encode([t.encode() for t in texts])
    for t, x in zip(texts, ids, strict=True):
        whole = coder.tokenizer.encode(t, add_special_tokens=False).ids
        assert x == raw(whole) and coder.decode(x) == t.encode() and "".join(coder.decode_stream(whole)) == t


def test_bpe_caches_forget_without_harm(monkeypatch, reference):
    monkeypatch.setattr(bpe, "MAX_CHUNKS", 5)
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    coder = bpe.ByteBpe(bpe.default_path())
    for k in range(30):
        t = f"word{k} again, word{k - 1} {k}"
        assert coder.encode([t.encode()]) == [raw(reference.encode_ordinary(t))]


def test_offsets_share_split_characters():
    coder = bpe.vocabulary(bpe.default_path())
    for t in ("plain words", "é🙂日本 x"):
        ids = coder.encode([t.encode()])[0]
        a, b = coder.offsets(t, ids)
        assert a[0] == 0 and b[-1] == len(t) and all(x < y for x, y in zip(a, b, strict=True)) and all(x2 in (y1, y1 - 1) for y1, x2 in zip(b[:-1], a[1:], strict=True))


def pieces_are_whole(rows, ids):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[d]) and r["ids_crc32"] == zlib.crc32(raw(ids[d][at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids[d])
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0, "a sequence is full or as long as a power of two"


@pytest.mark.parametrize("shard", [7, packing.SHARD_DOCS])
def test_packing_keeps_every_token(spark, reference, shard):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", f"w{rng.randint(0, 50)}"]) for _ in range(rng.choice([0, 3, 40, 900, 3000]))) for _ in range(60)] + ODD
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    ids = {i: [*reference.encode_ordinary(t or ""), 0] for i, t in enumerate(texts)}
    pieces_are_whole(packing.pack(docs, shard_docs=shard).collect(), ids)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "w " * 200_000)], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 6 and sum(r["length"] for r in rows if r["doc_id"] is None) == 1
    assert sum(r["length"] for r in rows if r["doc_id"] == 2) == next(r["doc_tokens"] for r in rows if r["doc_id"] == 2) > 200_000


def plain_bm25(docs, seed, k1=1.2, b=0.75):
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in map(set, docs)) for t in set(docs[seed])}
    idf = {t: np.log(1 + (n - v + 0.5) / (v + 0.5)) for t, v in df.items()}
    return [sum(idf[t] * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / mean)) for t in df) for d in docs]


def test_neighbours_are_those_of_plain_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.3, rng.integers(1, 300)).clip(0, 900).astype(np.uint16) for _ in range(60)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1000)
    index = packing.Bm25(docs, packing.Corpus(len(docs), float(np.mean([len(d) for d in docs])), df))
    plain = [d.tolist() for d in docs]
    used = rng.random(60) < 0.3
    for seed in range(60):
        want = np.array(plain_bm25(plain, seed))
        assert np.allclose(index.scores(seed), want, rtol=1e-4)
        near = index.neighbours(seed, used)
        assert not used[near].any() and set(near.tolist()) == set(np.flatnonzero((want > 0) & ~used).tolist()) and (np.diff(want[near]) <= 1e-3).all()


def test_rollup_is_the_recount(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    coder = bpe.vocabulary(bpe.default_path())
    want, seen = defaultdict(lambda: [0, 0, 0]), set()
    for r in docs.orderBy("doc_id").collect():
        if r["text"] not in seen:
            seen.add(r["text"])
            t = want[r["source"], r["lang"], "byte_bpe_50k/2"]
            t[0] += 1
            t[1] += len(coder.encode([r["text"].encode()])[0]) // 4 + 1
            t[2] += len(r["text"].encode())
    got = {tuple(r)[:3]: list(r)[3:] for r in queries.op10_token_rollup(spark, SMALL).collect()}
    assert got == dict(want)


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (2, "a b", "en", "s"), (None, "a b", None, None), (None, None, None, None), (3, "", None, "q"), (4, "x", "de", "t")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, Text string, n_docs long")
    got = sorted((r["source"], r["n_docs"], r["n_tokens"], r["n_bytes"]) for r in token_rollup.maintained(docs).collect())
    assert got == [("q", 1, 1, 0), ("s", 1, 3, 3), ("t", 1, 2, 1)]


def test_only_one_of_two_commits_counts(spark):
    ledger = token_rollup.Ledger(spark, f"{shared_dir(spark)}/race-ledger")
    counts = token_rollup.counted(spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string"))
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda _: ledger.commit("a/b", token_rollup.inserts(counts)), range(4)))
    assert sum(done) == 1 and ledger.batches() == ["a/b"] and ledger.totals().first()["n_docs"] == 1
    ledger.compact()
    assert ledger.commit("c", token_rollup.inserts(counts)) and not ledger.commit("a/b", token_rollup.inserts(counts))
    ledger.compact()
    assert ledger.totals().first()["n_docs"] == 2 and len(ledger._state()[0]) == 1


def test_ledger_replays_have_no_effect(spark):
    ledger = token_rollup.Ledger(spark, f"{shared_dir(spark)}/test-ledger")
    counts = token_rollup.counted(spark.createDataFrame([(1, "a b", None, "s"), (2, None, "en", "s"), (3, "", "en", "s")], "doc_id long, text string, lang string, source string"))
    assert ledger.commit("a", token_rollup.inserts(counts)) and not ledger.commit("a", token_rollup.inserts(counts))
    assert sorted((r["lang"] or "", r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()) == [("", 1, 2), ("en", 2, 0)]
    assert ledger.commit("b", token_rollup.deletes(counts)) and ledger.batches() == ["a", "b"] and ledger.totals().count() == 0
    assert token_rollup.maintained(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_search_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x[5:40] = x[4]
    x[100:130] = x[50] * 2
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000, None, 0), (5050, [0.0] * 24, 0), (5100, [float("nan")] * 24, 0), (5150, [None] * 24, 0), (5200, [1.0], 0), rows[0]]
    got = defaultdict(list)
    for r in additive_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(3000), -np.round(s, 12)))[:5].tolist()
        hit += len(set(best) & {v for v, _ in got[q]})
        assert len(got[q]) == 5 and all(abs(score - s[v]) < 1e-12 for v, score in got[q])
    assert set(got) == set(range(0, 3000, 50)) and hit >= 0.9 * 300
    assert additive_ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_any_magnitude(spark):
    rows = [(0, [1e-200, 1e-200]), (1, [1e200, 1e200]), (2, [1.0, 0.0]), (3, [5e-324, 0.0]), (50, [1e200, 2e200]), (4, [-1e300, 1e300])]
    got = additive_ann.search(spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, VEC_ID string, x long")).collect()
    score = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
    assert score[0, 1] == pytest.approx(1) and score[0, 50] == score[50, 1] == pytest.approx(3 / 10**0.5) and score[0, 4] == pytest.approx(0, abs=1e-12) and len(score) == 10


def test_recall_in_a_dense_group(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 32))
    x[:3000] = x[0] + rng.standard_normal((3000, 32)) * 0.02
    x = x[rng.permutation(6000)]
    got = defaultdict(set)
    for r in additive_ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got[r["query_id"]].add(r["vec_id"])
    u, hit = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in range(0, 6000, 50):
        s = u @ u[q]
        s[q] = -9
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 0.95 * 600


def held_out(spark, digest, label, threshold):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = digest(docs, labels).collect()
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    return [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]


def test_quality_on_held_out_rows(spark):
    pairs = held_out(spark, byte_cnn.digest, "quality", 0.7)
    assert np.mean([p == t for p, t in pairs]) > 0.97 and np.mean([p for p, t in pairs if t]) > 0.98


def test_toxicity_on_held_out_rows(spark):
    pairs = held_out(spark, nnpu.digest, "toxic", 0.3)
    assert np.mean([p == t for p, t in pairs]) > 0.94 and np.mean([p for p, t in pairs if not t]) < 0.03


@pytest.mark.parametrize("digest, label", [(byte_cnn.digest, "quality"), (nnpu.digest, "toxic")])
def test_classifiers_take_anything(spark, digest, label):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(None, "a", "x")], "doc_id long, text string, score string")
    for labels in ([], [(0, 1), (1, 1), (3, 1), (3, 0), (4, None)], [(i, i % 2) for i in range(len(ODD))]):
        rows = digest(docs, spark.createDataFrame(labels, f"doc_id long, {label} int")).collect()
        assert len(rows) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert digest(docs.limit(0), spark.createDataFrame([(1, 1), (4, 0)], f"doc_id long, {label} int")).count() == 0


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = byte_cnn.ByteCnn(rng)
    net.table, net.bias, net.out, net.base = (x.astype(np.float64) for x in (net.table, net.bias, net.out, net.base))
    texts, y = [rng.integers(32, 120, n).astype(np.uint8).tobytes() for n in (10, 500, 900)], np.array([0.0, 1.0, 1.0])
    loss = lambda: -np.mean(y * np.log(net.score(texts)) + (1 - y) * np.log(1 - net.score(texts))) + byte_cnn.DECAY * ((net.table**2).sum() + (net.out**2).sum()) / 2
    g = net.gradients(texts, y, np.ones(3))
    for k, values in enumerate((net.table, net.bias, net.out, net.base)):
        for at in rng.integers(0, values.size, 6):
            old, step = values.flat[at], 1e-2
            values.flat[at] = old + step
            up = loss()
            values.flat[at] = old - step
            assert (up - loss()) / (2 * step) == pytest.approx(g[k].flat[at], abs=2e-3)
            values.flat[at] = old


def test_network_against_plain_loops():
    rng = np.random.default_rng(5)
    net = byte_cnn.ByteCnn(rng)
    for text in (b"", b"ab", rng.integers(0, 256, 700).astype(np.uint8).tobytes()):
        padded = text + bytes(-(-(len(text) + byte_cnn.KERNEL) // byte_cnn.BLOCK) * byte_cnn.BLOCK - len(text) + byte_cnn.KERNEL)
        n = len(padded) - byte_cnn.KERNEL
        high = [max(0.0, max(sum(float(net.table[j, padded[at + j], f]) for j in range(byte_cnn.KERNEL)) for at in range(n)) + float(net.bias[f])) for f in range(byte_cnn.FILTERS)]
        want = 1 / (1 + np.exp(-(sum(h * float(o) for h, o in zip(high, net.out, strict=True)) + float(net.base[0]))))
        assert net.score([text])[0] == pytest.approx(want, abs=1e-5)


def test_risk_against_plain_loops():
    rng = np.random.default_rng(6)
    for shift, prior in ((0.0, 0.1), (4.0, 0.6)):
        toxic, other = rng.standard_normal(30) + shift, rng.standard_normal(50) - shift
        loss = lambda z, y: np.log1p(np.exp(-z if y else z))
        miss = prior * sum(loss(z, 1) for z in toxic) / 30
        clean = sum(loss(z, 0) for z in other) / 50 - prior * sum(loss(z, 0) for z in toxic) / 30
        value, dp, du = nnpu.risk(toxic, other, prior)
        assert value == pytest.approx(miss + max(clean, 0)) and (clean < 0) == (not du.any())
        for k in range(3):
            step = np.eye(30)[k] * 1e-5
            assert (nnpu.risk(toxic + step, other, prior)[0] - nnpu.risk(toxic - step, other, prior)[0]) / 2e-5 == pytest.approx(dp[k], abs=1e-6)


def test_long_texts_train_by_stretches_of_all_of_them(spark):
    text = "".join(f"{i:08d}" for i in range(200_000)).encode()
    got = bytes(spark.createDataFrame([(text,), (b"short",)], "text binary").select(byte_cnn.stretches(F.col("text")).alias("t")).orderBy(F.octet_length("t")).collect()[1]["t"])
    assert len(got) == byte_cnn.STRETCHES * byte_cnn.STRETCH and got[:8] == text[:8] and got[-8:] == text[-8:] and text[800_000:800_200] not in (b"",)


def test_clashing_names_and_repeated_rows_of_classifiers(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1.0), (1, "a b", "x", 1.0), (1, "c", "y", None), (None, None, None, None)], "doc_id long, text string, Text string, __toxicity double")
    labels = spark.createDataFrame([(1, 0, "q"), (3, 1, "q")], "doc_id long, toxic int, DOC_ID string")
    out = nnpu.without_toxic(docs, labels)
    assert out.columns == docs.columns and out.count() == 4 and nnpu.digest(docs, labels).count() == 4
    assert byte_cnn.digest(docs, labels.withColumnRenamed("toxic", "quality")).count() == 4


def test_pu_learning_finds_planted_words():
    rng = np.random.default_rng(1)
    text = lambda bad: " ".join(f"w{v}" for v in rng.integers(0, 500, 80)) + (" horrid" if bad else "")
    positive = [nnpu.features(text(True).encode()) for _ in range(100)]
    unlabelled = [nnpu.features(text(k % 10 == 0).encode()) for k in range(1000)]
    model = nnpu.fit(positive, unlabelled, 0.1)
    assert model.score([text(True).encode() for _ in range(50)]).min() > 0.3 > model.score([text(False).encode() for _ in range(50)] + [b""]).max()
