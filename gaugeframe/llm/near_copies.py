"""Near copies by word shingles: fingerprints and MinHash bands propose pairs, the exact Jaccard similarity of the sets decides.

At a similarity of 0.8, 64-bit fingerprints differ by seven bits in the median and by eleven and more at the edge, too
far for blocks that have to agree as a whole; bands of MinHash values don't depend on that. A pair at 0.8 shares one of
the 48 bands of eight values with a probability of 0.9998, a pair at 0.85 of 0.9999999.

Texts with equal sets are one node. The first round takes what SimHash's tries link, and neighbours within the buckets of
a few bands, so that a large group is joined by a number of pairs that grows with its size only. The second one compares
the members of each bucket, in all bands, that the first hasn't joined: a bucket's sets meet in one worker by lists of the
members that have a shingle, and only links that join its members leave it, never its pairs. No bucket is cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm._shared import batched, cut, dropped, only, parts
from gaugeframe.llm.components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, VALUES, FIRST_BANDS = 48, 8, 8
SEED = 42
#: Shingles whose MinHash values are computed at once.
AT_ONCE = 1 << 10
#: Members of buckets that a shard has on average.
SHARD_ROWS = 2000

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * VALUES), dtype=np.uint32)
_TIMES, _PLUS = _DRAWN[0] | np.uint32(1), _DRAWN[1]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the text's word shingles; a shorter text is one shingle, no word gives none."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint32)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    digest = xxhash.xxh32_intdigest
    cuts = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in cuts], dtype=np.uint32))


def bands(found: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of MinHash values; none for the empty set."""
    import xxhash

    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), AT_ONCE):
        np.minimum(least, (found[at : at + AT_ONCE, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least.reshape(BANDS, VALUES))], np.uint64).view(np.int64)


def _marked(docs: DataFrame, text: str, words: int, fingerprint: Callable[[str | None, int], int]) -> DataFrame:
    """(doc_id, th, node, found, bands, fp): node names the set of shingles, th is the hash of the text, fp its fingerprint."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sets, fps = [shingles(t, words) for t in texts], np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            found, keys = pa.array([x.view(np.int32) for x in sets], pa.list_(pa.int32())), pa.array([bands(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), found, keys, pa.array(fps)], ["doc_id", "th", "node", "found", "bands", "fp"])

    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th bigint, node bigint, found array<int>, bands array<bigint>, fp bigint"
    of = F.col(text).cast("string")
    return only(docs, "doc_id", text).select("doc_id", F.xxhash64(of).alias("th"), of.alias("text")).transform(batched, run, out)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have at least that Jaccard similarity."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    some = sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("found").alias("found"))
    left, right = some.select(F.col("node").alias("u"), F.col("found").alias("a")), some.select(F.col("node").alias("v"), F.col("found").alias("b"))
    both = pairs.join(left, "u").join(right, "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared * (1 + similarity) + 1e-9 >= (F.size("a") + F.size("b")) * similarity).select("u", "v")


def _pairs(x: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs whose sizes allow the similarity."""
    near = F.least("n", "m") + 1e-9 >= F.greatest("n", "m") * similarity
    return x.where(near).select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def _alike(marked: DataFrame, links: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Pairs (node, n, other, m) that the fingerprints propose: nodes with one fingerprint, and fingerprints that `links` joins, by one node of each."""
    nodes = cut(marked.groupBy("fp", "node").agg(F.first(F.size("found")).alias("n")))
    one = cut(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("o")).select("fp", F.col("o.node").alias("other"), F.col("o.n").alias("m")))
    same = nodes.join(one, "fp").where("node <> other").select("node", "n", "other", "m")
    ends = links(one.select("fp"), one.count()).join(one.select(F.col("fp").alias("u"), F.col("other").alias("node"), F.col("m").alias("n")), "u")
    return same.union(ends.join(one.select(F.col("fp").alias("v"), "other", "m"), "v").where("node <> other").select("node", "n", "other", "m"))


def bucket_links(sets: list[np.ndarray], root: np.ndarray, main: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of a bucket's members, at least that similar, that join what all such pairs join; `root` says what is joined already.

    Members of the component `main` are met by the others, never by each other.
    """
    m, size = len(sets), np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    order = flat.argsort(kind="stable")
    owner = np.repeat(np.arange(m), size)[order]
    heads = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
    run = np.empty(len(flat), np.int64)  # the list of members that each shingle of each set has
    run[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(flat))))
    count = np.diff(np.append(heads, len(flat)))
    ends, out, root = np.cumsum(size), [], root.copy()
    for i in np.flatnonzero(root != main).tolist():
        lists = run[ends[i] - size[i] : ends[i]]
        long = count[lists]
        at = np.repeat(heads[lists] - np.cumsum(long) + long, long) + np.arange(long.sum())
        shared = np.bincount(owner[at], minlength=m)
        near = np.flatnonzero((shared * (1 + similarity) + 1e-9 >= (size + size[i]) * similarity) & (root != root[i]))
        if len(near):
            others, first = np.unique(root[near], return_index=True)
            out += [(i, j) for j in near[first].tolist()]
            root[np.isin(root, others)] = root[i]
    return out


def _in_buckets(members: DataFrame, n: int, similarity: float) -> DataFrame:
    """n rows (key, node, root, main, found) -> links (u, v) within each bucket."""
    shards = max(parts(members), math.ceil(n / SHARD_ROWS))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("node", "ascending")])
        key, node, root, main = (t[c].to_numpy() for c in ("key", "node", "root", "main"))
        found = t["found"].combine_chunks()
        flat, at = found.flatten().to_numpy().view(np.uint32), np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy())])
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        u, v = [], []
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(key)], strict=True):
            for i, j in bucket_links([flat[at[k] : at[k + 1]] for k in range(a, b)], root[a:b], main[a], similarity):
                u.append(node[a + i])
                v.append(node[a + j])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    dealt = members.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "u bigint, v bigint").distinct()


def groups(
    docs: DataFrame, fingerprint: Callable[[str | None, int], int], links: Callable[[DataFrame, int], DataFrame], text: str = "text", words: int = WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """(doc_id, th, node, root, component_id) of every document, links being sets of shingles at least that similar.

    `fingerprint` is that of a text by so many words, `links` joins distinct ones (fp) by edges (u, v).
    component_id is the smallest doc_id of the component, root its name even where all doc_ids are null. Texts that are
    null, empty or without a word have the same, empty set. Repeated rows stay repeated; a null doc_id never names a
    component unless the component has no other. An empty table gives no rows.
    """
    marked = cut(_marked(docs, text, words, fingerprint))
    sets = marked.select("node", "found")
    firsts = cut(marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands"), F.first(F.size("found")).alias("n")))
    dealt = lambda keys: firsts.select("node", "n", F.explode(keys).alias("key"))

    order = Window.partitionBy("key").orderBy("node")
    next_ = dealt(F.slice("bands", 1, FIRST_BANDS)).select("node", "n", F.lag("node").over(order).alias("other"), F.lag("n").over(order).alias("m"))
    proposed = next_.where("other is not null").select("node", "n", "other", "m").union(_alike(marked, links))
    first = cut(_similar(cut(_pairs(proposed, similarity)), sets, similarity))
    joined = components(first)

    rooted = dealt("bands").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = rooted.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("c", "root")).alias("main"))
    open_ = cut(rooted.join(per.where("roots > 1").select("key", "main"), "key"))
    some = cut(sets.join(open_.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("found").alias("found")))
    ids = cut(marked.select("doc_id", "th", "node"))
    dropped(marked)
    rest = _in_buckets(open_.select("key", "node", "root", "main").join(some, "node"), open_.count(), similarity)
    joined = components(first.union(rest))
    dropped(first, open_, some)

    named = firsts.select("node", "first").join(joined, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    whole = named.join(least, "root").select("node", "root", "component_id")
    return ids.join(whole, "node").select("doc_id", "th", "node", "root", "component_id")
