"""Line dedup, quality rules, SimHash and suffix dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeframe.llm import components, line_dedup, quality_rules, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, h string"
ODD = [None, "", " ", "\n\n", "a", "é ü\tß\x0bx", "w " * 3000, "x" * 5000, "🙂 " * 80]


def frame(spark, texts, repeat=True):
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    if repeat:
        rows += [rows[-1], (None, "no id at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def random_texts(seed, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    line = lambda: " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 12)))
    shared = [[line() for _ in range(6)] for _ in range(4)]
    out = []
    for _ in range(n):
        lines = [line() for _ in range(rng.randint(1, 10))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(lines))
            lines[at:at] = rng.choice(shared)
        out.append("\n".join(lines))
    return [*out, out[3], out[3], *ODD]


def test_base_metrics(spark):
    texts = random_texts(1) + ["a b c a b c a b", "x\nx\n \nx y", "# $ $$ <|>"]
    got = {r["doc_id"]: r for r in quality_rules.judged(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w, r = words(t), got[i]
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        full = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(full) - len(set(full)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["kept"] and r["base_failed"])


def test_frequent_lines_deplete_documents(spark):
    own = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(30)]
    boiler = " ".join(f"b{j}" for j in range(200))
    rows = [(i, own[i] + ("\n" + boiler.upper() + " " if i < 25 else ""), "en", "s", 1, "", "") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    assert [i for i in range(30) if not kept[i]["kept"]] == list(range(25)) and kept[0]["n_frequent_lines"] == 1 and kept[0]["n_kept_words"] == 60
    often = quality_rules.frequent_lines(quality_rules.measured(docs))
    assert quality_rules.without_lines(docs, often).where("doc_id = 0").first()["text"] == own[0]


def test_line_chunks_survive_shifts(spark):
    rng = random.Random(5)
    body = [f"line {rng.random()}" for _ in range(60)]
    docs = frame(spark, ["\n".join(body), "\n".join(["new first line", *body]), "\n".join(body[:30] + ["in between"] + body[30:])], repeat=False)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[0]["n_removed_lines"] == 0 and got[1]["n_removed_lines"] == 60 and got[2]["n_removed_lines"] == 60


def brute_lines(rows):
    """Lines that go: those of a chunk (two lines at a boundary, three with a neighbour) that occurred before."""
    seen, found = {}, collections.defaultdict(set)
    for name, line, starts in rows:
        for i in starts:
            for at, n in ((i, 2), (i - 1, 3), (i, 3)):
                if at >= 0 and at + n <= len(line) and any(words(x) for x in line[at : at + n]):
                    found[tuple(line[at : at + n])].add((name, at))
    for chunk, places in found.items():
        first = min(places)
        for name, at in places - {first}:
            seen.setdefault(name, set()).update(range(at, at + len(chunk)))
    return seen


def test_line_dedup_against_brute_force(spark):
    texts = random_texts(2)
    docs = frame(spark, texts)
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text", F.transform(line_dedup.boundaries(line_dedup.lines(F.col("text"))), lambda c: c["at"]).alias("c")).distinct().collect()
    name = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["th"])
    lost = brute_lines([(name(r), r["text"].split("\n"), r["c"]) for r in rows if r["text"] is not None])
    th = {r["text"]: r["th"] for r in rows}
    for r in line_dedup.dedup_lines(docs).collect():
        source = texts[r["doc_id"]] if r["doc_id"] is not None else "no id at all"
        if source is None:
            assert r["text"] is None and r["n_lines"] == 0
            continue
        gone = lost.get((r["doc_id"] is not None, r["doc_id"] or 0, th[source]), set())
        assert r["text"] == "\n".join(x for i, x in enumerate(source.split("\n")) if i not in gone)
        assert r["n_removed_lines"] == len(gone) and r["host"] in ("clash", None)
    assert line_dedup.without_repeats(docs).columns == docs.columns


def test_repeated_passages_go(spark):
    rng = random.Random(3)
    new = lambda n: [f"line {rng.random()}" for _ in range(n)]
    rows, planted = [], collections.defaultdict(list)
    for size in (2, 3, 4, 6, 12):
        for _ in range(60):
            passage = new(size)
            for k in range(2):
                planted[size, k].append(len(rows))
                rows.append((len(rows), "\n".join(new(5) + passage + new(5))))
    block = len(rows)
    rows += [(block, "\n".join(["same"] * 9)), (block + 1, "\n".join([*new(2), *["same"] * 6]))]
    lost = {r["doc_id"]: r["n_removed_lines"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = {size: sum(lost[d] for d in planted[size, 1]) / size / 60 for size in (2, 3, 4, 6, 12)}
    assert share[2] > 0.35 and all(share[size] == 1 for size in (3, 4, 6, 12)), share
    assert not any(lost[d] for (_, k), ids in planted.items() if not k for d in ids) and lost[block] >= 7 and lost[block + 1] >= 5


def brute_fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_groups(spark):
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 999)}" for _ in range(400)]
    texts = random_texts(3)
    for k in range(12):
        copy = list(base)
        copy[rng.randrange(400)] = f"changed{k}"
        texts.append(" ".join(copy).upper() if k % 2 else " ".join(copy))
    docs = frame(spark, texts)
    got = simhash.digest(docs).collect()
    fps = [brute_fingerprint(t) for t in texts]
    group = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3 and group[j] < group[i]:
                    group[i], changed = group[j], True
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}" and r["component_id"] == group[r["doc_id"]]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted({r["doc_id"] for r in kept.collect()} - {None}) == sorted(set(group))


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 11), st.lists(st.integers(0, 63), max_size=5)), max_size=60), st.sampled_from([0, 16]))
@settings(max_examples=60, deadline=None)
def test_trie_join_finds_all_links(seeds, flips, bits):
    keys = set(seeds)
    for at, where in flips:
        keys.add(seeds[at % len(seeds)] ^ sum(1 << b for b in set(where)))
    keys = np.array(sorted(keys), np.uint64)
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 3
    if bits:
        near &= (keys[:, None] >> np.uint64(48)) == (keys[None, :] >> np.uint64(48))
    assert simhash.trie_links(keys, bits).tolist() == simhash._roots(len(keys), *np.nonzero(near)).tolist()


def test_trie_join_in_small_steps(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 8)
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**10, 300, dtype=np.uint64))
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 3
    assert simhash.trie_links(keys).tolist() == simhash._roots(len(keys), *np.nonzero(near)).tolist()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30] + [(7, 7), (100, 99)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(31, 61), 31), 99: 99, 100: 99}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_repeats(texts, n=200):
    count = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + n, int)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                hit[i] += 1
                hit[i + n] -= 1
        covered = np.cumsum(hit)[: len(t)] > 0
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((len(t), int(covered.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~covered].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("most", [suffix_dedup.TREE_MEMBERS, 40])
def test_repeated_strings(spark, most):
    rng = random.Random(1)
    some = lambda n: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    texts = random_texts(4, 30) if most > 40 else ["", None]
    texts += ["ab" * 300, "ab" * 120, "é" * 150 + "tail", "é" * 150] if most > 40 else []
    long, short, gram = some(150), some(40), some(13)  # more occurrences than a tree holds, with different surroundings
    texts += [f"{some(40)} {long} {some(40)}" for _ in range(5)] + [f"{some(30)} {gram} {some(30)}" for _ in range(60)] + [f"{some(30)} {short} {some(30)}" for _ in range(60)]
    texts += [long, long, long[300:700], "x" + long * 40]
    rows = [(i, t) for i, t in enumerate(texts)] + [(len(texts) - 1, texts[-1])]
    got = sorted(tuple(r) for r in suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string"), most).collect())
    assert got == sorted((i, *x) for (i, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows]), strict=True))


def test_maximal_repeats_of_any_length(spark):
    rng = random.Random(1)
    some = lambda n: " ".join(str(rng.randint(0, 10**6)) for _ in range(n))
    passage = some(150)
    texts = [f"{some(40)} {passage} {some(40)}" for _ in range(5)] + [passage, passage, f"{some(5)}#{passage[300:700]}#{some(5)}"]
    by = collections.defaultdict(set)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    for r in suffix_dedup.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        by[r["repeat"], r["length"]].add((r["doc_id"], texts[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]]))
    assert all(len({b for _, b in v}) == 1 and len(v) > 1 for v in by.values())
    found = {next(iter(v))[1]: {d for d, _ in v} for v in by.values()}
    assert found[passage.encode()] == set(range(7)) and found[passage[300:700].encode()] == set(range(8))


def brute_intervals(lefts, rights, length):
    """For each pair its common extensions; members that reach them are a repeat's occurrences."""
    out = set()
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for i in range(len(lefts)):
        for j in range(i):
            x, y = common(lefts[i], lefts[j]), common(rights[i], rights[j])
            if x + y >= length:
                out.add((x, y, tuple(k for k in range(len(lefts)) if lefts[k][:x] == lefts[i][:x] and rights[k][:y] == rights[i][:y])))
    return out


@given(st.lists(st.tuples(st.binary(max_size=5).map(lambda b: bytes(x % 2 for x in b)), st.binary(max_size=5).map(lambda b: bytes(x % 2 for x in b))), min_size=1, max_size=14, unique=True), st.integers(0, 4))
@settings(max_examples=150, deadline=None)
def test_interval_tree_against_brute_force(sides, length):
    lefts, rights = [a for a, _ in sides], [bytes(120) + b for _, b in sides]
    got = {(x, y, tuple(sorted(m))) for x, y, m in suffix_dedup.maximal(lefts, rights, length + 120)}
    assert got == brute_intervals(lefts, rights, length + 120)


def test_maximal_repeats_are_maximal(spark):
    shared = " ".join(f"s{i}" for i in range(120))
    own = lambda k, side: " ".join(f"{side}{k}x{j}" for j in range(80))
    texts = [f"{own(k, 'l')} {shared} {own(k, 'r')}" for k in range(4)]
    docs = frame(spark, texts, repeat=False)
    found = suffix_dedup.maximal_repeats(docs).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r["repeat"], r["length"]].append((r["doc_id"], texts[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]]))
    assert by and all(len({b for _, b in v}) == 1 and len({d for d, _ in v}) == 4 for v in by.values())
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and not any("s50" in r["text"] for r in left.collect())


CLASHES = "n_lines long, __spans string, __key string, __stay string, __toxicity string, __hits string, Text string, DOC_ID string, row string, th long, spans string, score double, times long"


@pytest.mark.parametrize("operator", [line_dedup.without_repeats, line_dedup.dedup_lines, simhash.keep_one, lambda d: simhash.keep_one(d, simhash.near_duplicates), suffix_dedup.without_repeats, line_dedup.digest, simhash.digest, suffix_dedup.digest, quality_rules.judged, lambda d: quality_rules.without_lines(d, quality_rules.frequent_lines(quality_rules.measured(d)))])
def test_any_column_names_and_odd_rows(spark, operator):
    long = " ".join(f"w{i}" for i in range(160_000))  # a text of 1 MB
    texts = [None, "", " \n", "a b c", "a b c", long, long.replace("w7 ", "x7 ")]
    extra = (1, "s", "k", "t", "x", "h", "T", "D", "r", 2, "p", 0.5, 3)
    rows = [(i, t, "en", None, None, *extra) for i, t in enumerate(texts)] + [(3, "a b c", "en", None, None, *extra), (None, "a b c", None, None, None, *[None] * 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES)
    out = operator(docs)
    n = len(out.collect())
    assert 0 < n <= len(rows) and (n == len(rows) or out.columns == docs.columns)


@pytest.mark.parametrize("grouped", [simhash.linked, simhash.near_duplicates])
def test_one_row_of_each_group_stays(spark, grouped):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (2, a), (1, b), (5, b), (0, b), (None, c), (None, c), (7, None), (8, ""), (None, " ")]
    kept = sorted(tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), grouped).select("doc_id", F.substring("text", 1, 1)).fillna({"doc_id": -1}).collect())
    assert kept == [(-1, "c"), (0, "b"), (1, "a"), (7, None)]


def test_lines_are_counted_by_document(spark):
    boiler = " ".join(f"b{j}" for j in range(200))
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(0, f"{own(0)}\n{boiler}", "s")] * 30 + [(i, own(i), "s") for i in range(1, 30)] + [(None, boiler, "s")] * 30
    judged = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r["kept"] and not r["n_frequent_lines"] for r in judged if r["doc_id"] == 0)


@pytest.mark.parametrize("operator", [line_dedup.digest, quality_rules.judged, simhash.digest, suffix_dedup.digest, line_dedup.without_repeats, simhash.keep_one, suffix_dedup.without_repeats])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
