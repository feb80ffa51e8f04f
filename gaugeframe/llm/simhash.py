"""SimHash near-duplicates: fingerprints in Arrow batches, linked by a self-join of binary tries.

Two fingerprints with at most three differing bits agree on at least one of their four 16-bit blocks. Distinct
fingerprints are dealt out once for each block; all that share the block stand in one trie over the remaining 48 bits.
Node pairs are traversed together, level by level: differing bits add up, and a pair beyond the error budget is pruned.
A pair of nodes in which every fingerprint is within the budget of every other is linked as a whole, so a large group of
near copies isn't expanded into pairs. Only a spanning forest leaves each shard.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import near_copies
from gaugeframe.llm._shared import batched, cut, only, packed, parts, unpacked
from gaugeframe.llm.components import components

WORDS, SEED, BUDGET = 3, 42, 3
BLOCKS, BLOCK_BITS = 4, 16
#: Rows of a shard of tries on average, node pairs that are held at once, shingles whose bits are counted at once.
SHARD_ROWS, FRONTIER, COUNTED = 100_000, 1_000_000, 1 << 15


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 majority bits over the XXH64 of the text's word shingles; zero if it has no word."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    cuts = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], SEED) for a, b in cuts], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        bits = np.unpackbits(hashes[at : at + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, th, fp): the text's hash and the fingerprint of each whole text as a signed long. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "th", "fp"])

    of = F.col(text).cast("string")
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th bigint, fp bigint"
    return only(docs, "doc_id", text).select("doc_id", F.xxhash64(of).alias("th"), of.alias("text")).transform(batched, run, out)


class _Spread:
    """OR and AND over any range of a sorted array, from tables of ranges whose sizes are powers of two."""

    def __init__(self, x: np.ndarray):
        self.tables = [(x, x)]
        while (half := 1 << (len(self.tables) - 1)) * 2 <= len(x):
            o, a = self.tables[-1]
            self.tables.append((o[:-half] | o[half:], a[:-half] & a[half:]))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        o, a = np.empty(len(lo), np.uint64), np.empty(len(lo), np.uint64)
        for level in np.unique(k):
            at = k == level
            first, last = lo[at], hi[at] - (1 << int(level))
            any_, all_ = self.tables[level]
            o[at], a[at] = any_[first] | any_[last], all_[first] & all_[last]
        return o, a


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the edges."""
    root = np.arange(n)
    while len(u):
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return root


def trie_links(keys: np.ndarray, group_bits: int = BLOCK_BITS, budget: int = BUDGET) -> np.ndarray:
    """For sorted distinct 64-bit keys: the index of each key's root among the keys that share its first group_bits bits.

    Roots join all keys that a chain of pairs with at most `budget` differing bits connects.
    """
    n = len(keys)
    if n < 2:
        return np.arange(n)
    spread = _Spread(keys)
    if group_bits:
        heads = np.flatnonzero(np.concatenate([[True], np.diff(keys >> np.uint64(64 - group_bits)) != 0]))
    else:
        heads = np.array([0])
    ends = np.append(heads[1:], n)
    wide = ends - heads > 1
    heads, ends = heads[wide], ends[wide]
    links: list[tuple[np.ndarray, np.ndarray]] = []
    stack = [(63 - group_bits, np.stack([heads, ends, heads, ends, np.zeros_like(heads)]))]
    root = np.arange(n)
    held = 0

    def merged() -> None:
        nonlocal root, held
        if links:
            u, v = (np.concatenate(x) for x in zip(*links, strict=True))
            root = _roots(n, np.concatenate([np.arange(n), u]), np.concatenate([root, v]))
            links.clear()
        held = 0

    while stack:
        bit, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            half = pairs.shape[1] // 2
            stack += [(bit, pairs[:, :half]), (bit, pairs[:, half:])]
            continue
        alo, ahi, blo, bhi, err = pairs
        # all within the budget of each other: one link for each key, and done
        (ao, aa), (bo, ba) = spread(alo, ahi), spread(blo, bhi)
        close = np.bitwise_count((ao | bo) ^ (aa & ba)) <= budget
        for lo, hi in ((alo[close], ahi[close]), (blo[close], bhi[close])):
            size = hi - lo
            member = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size) + np.arange(size.sum())
            links.append((member, np.repeat(alo[close], size)))
            held += len(member)
        if held > FRONTIER:
            merged()
        single = (ahi - alo == 1) & (bhi - blo == 1)
        alo, ahi, blo, bhi, err = pairs[:, ~close & ~single]
        if not len(alo) or bit < 0:
            continue
        one = np.uint64(1 << bit)
        above = ~np.uint64((1 << (bit + 1)) - 1)
        amid = np.searchsorted(keys, (keys[alo] & above) | one)
        bmid = np.searchsorted(keys, (keys[blo] & above) | one)
        self_, off = alo == blo, err + 1
        children = np.concatenate(
            [
                np.stack([alo, amid, blo, bmid, err]),
                np.stack([amid, ahi, bmid, bhi, err]),
                np.stack([alo, amid, bmid, bhi, off]),
                np.stack([amid, ahi, blo, bmid, off])[:, ~self_],
            ],
            axis=1,
        )
        alo, ahi, blo, bhi, err = children
        alive = (ahi > alo) & (bhi > blo) & (err <= budget) & ~((alo == blo) & (ahi - alo == 1))
        if alive.any():
            stack.append((bit - 1, children[:, alive]))
    merged()
    return root


def links(fps: DataFrame, n: int) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) that connect all within the budget of each other."""
    block = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
    x, by = F.col("fp"), "block * 16"
    turned = F.expr(f"shiftleft(fp, {by}) | CASE WHEN block = 0 THEN 0 ELSE shiftrightunsigned(fp, 64 - {by}) END")
    shards = max(parts(fps), math.ceil(BLOCKS * n / SHARD_ROWS))
    dealt = fps.select(x, block).select("block", turned.alias("turned"))
    key = F.expr("shiftrightunsigned(turned, 48)")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("block", key), F.lit(shards)))

    def run(t: pa.Table) -> pa.Table:
        out_u, out_v = [], []
        blocks, turned = t["block"].to_numpy(), t["turned"].to_numpy().view(np.uint64)
        for b in np.unique(blocks):
            keys = np.sort(turned[blocks == b])
            root = trie_links(keys)
            moved = np.flatnonzero(root != np.arange(len(keys)))
            back = lambda k, s=int(b) * BLOCK_BITS: ((k >> np.uint64(s)) | (k << np.uint64(64 - s)) if s else k).view(np.int64)
            out_u.append(back(keys[moved]))
            out_v.append(back(keys[root[moved]]))
        return pa.table({"u": np.concatenate(out_u), "v": np.concatenate(out_v)})

    return dealt.groupBy("shard").applyInArrow(run, "u bigint, v bigint")


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp, root, component_id) of every document by op6's contract: links are fingerprints with at most three differing bits.

    component_id is the smallest doc_id of the component, root its name even where all doc_ids are null. Texts that are
    null, empty or without a word have fingerprint zero and are linked like any other; a text of any length counts whole.
    Repeated rows stay repeated; a null doc_id never names a component unless the component has no other. An empty table
    gives no rows.
    """
    marked = cut(fingerprints(docs))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(links(fps.select("fp"), fps.count()))
    rooted = fps.join(joined, fps.fp == joined.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "th", "fp", "root", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def digest(docs: DataFrame) -> DataFrame:
    return linked(docs).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, words: int = near_copies.WORDS, similarity: float = near_copies.SIMILARITY) -> DataFrame:
    """(doc_id, th, node, root, component_id) for corpora: links are word shingles of at least that Jaccard similarity, not op6's.

    The tries' links are checked on the sets; what the fingerprints of similar texts are too far apart for is proposed by MinHash.
    """
    return near_copies.groups(docs, fingerprint, links, words=words, similarity=similarity)


def keep_one(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = linked) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id (null after all others), then the smallest text hash.

    Of rows that repeat this doc_id and text any one stays. Texts that are null, empty or without a word are one group.
    All columns pass unchanged, whatever their names; an empty table gives no rows.
    """
    per = cut(grouped(docs).groupBy("root", "doc_id", "th").agg(F.count("*").alias("times")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "times")
    first = per.groupBy("root").agg(F.min(order).alias("f")).select(F.col("f.doc_id").alias("id"), F.col("f.th").alias("h"), "f.times")
    rows = packed(docs, "doc_id", "text")
    stay = rows.join(first, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("h"))).select("row", "id", "h", "times")
    alone = stay.where("times = 1").select("row")
    several = stay.where("times > 1").groupBy("id", "h").agg(F.first("row").alias("row")).select("row")
    return unpacked(alone.unionByName(several), docs)
