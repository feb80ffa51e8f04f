"""Suffix-array dedup: removes every byte of a 200-byte string that also starts anywhere else.

A sparse suffix array does: winnowing picks anchors so that every 200-byte window holds the anchor its own bytes decide,
and equal windows hold it at the same place. Suffixes that start at anchors are sharded by their first 80 bytes. In a
shard the sorted suffixes and their common prefixes are scanned with a stack, which gives the common-prefix intervals:
every set of occurrences that share so many bytes to the right. The members of an interval, sorted by what stands to
their left, are scanned in the same way; a set whose members lie in different children of the interval, and differ in the
byte to their left, is a maximal repeat with all its occurrences. What maximal repeats of 200 bytes or more cover, goes.

Occurrences whose whole surroundings (120 bytes left, 200 right) are equal stand in the tree as one member. Within a batch
they are combined before the shuffle, and frequent grams are broadcast, so a passage that a third of all documents share
doesn't send a third of all anchors to one task. A shard with too many members for one tree is built from the top: what all
its members share is the first interval, and the members are split by the next bytes to the right and, once more, to the left
of that. Two occurrences of a longer common string share the one or the other, so each pair is in one of the parts, and parts
are split again until a tree can hold them.
Surroundings and grams are compared by 64-bit hashes; extensions are compared byte by byte.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm._shared import batched, cut, dropped, met, only, packed, parts, shared_dir, shuffles_removed, unpacked

LENGTH, GRAM = 200, 80
LEFT, SPAN = LENGTH - GRAM, LENGTH - GRAM + 1
#: Members of a shard beyond which it is split into parts.
TREE_MEMBERS = 4096
#: Bytes of text that are hashed at once, at least.
AT_ONCE = 1 << 17

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the hash's base and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 1 << 64))])
        return self.up, self.down


_POWERS = _Powers()


class Hashes:
    """Hashes of all substrings of a byte array, from prefix sums."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _POWERS.upto(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, start, left, right, hash of the gram, hash of the surroundings) of each anchor of some texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    none = tuple(np.zeros(0, np.int64 if k < 4 else np.uint64) for k in range(6))
    if len(raw) < LENGTH:
        return none
    hashes = Hashes(raw)
    gram = hashes.grams(GRAM)
    bits = np.uint64(max(1, int(len(gram)).bit_length()))
    least = ((gram >> bits) << bits) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if SPAN > width:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    # windows that lie in one text; the first of each text's are numbered by its start
    inside = np.zeros(len(least) + 1, np.int64)
    long = sizes >= LENGTH
    np.add.at(inside, (ends - sizes)[long], 1)
    np.add.at(inside, (ends - LENGTH + 1)[long], -1)
    picked = (least & ((np.uint64(1) << bits) - np.uint64(1)))[np.cumsum(inside[:-1]) > 0].astype(np.int64)
    if not len(picked):
        return none
    at = np.unique(picked[np.concatenate([[True], picked[1:] != picked[:-1]])])
    owner = np.searchsorted(ends, at, side="right")
    start = at - (ends - sizes)[owner]
    left, right = np.minimum(start, LEFT), np.minimum(ends[owner] - at, LENGTH)
    around = hashes.of(at - left, at + right) + (left * 256 + right).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return owner, start, left, right, gram[at], _mixed(around)


def _runs(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of enough bytes, with the number of the first."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= AT_ONCE or i == len(texts) - 1:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0


#: What `kind` says of a row: one anchor, one that stands for several with equal surroundings, a stretch they cover.
ONE, MANY, COVER = 0, 1, 2


def combined(keys: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray, h: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, ...]:
    """(h, around, key, at, kind) of some anchors; those with equal surroundings become one row and the merged stretches.

    However often a passage occurs in a batch, its anchors leave it once; stretches are dealt by document, not by gram.
    """
    order = np.lexsort((start, keys, around, h))
    keys, start, left, right, h, around = (x[order] for x in (keys, start, left, right, h, around))
    head = np.concatenate([[True], (h[1:] != h[:-1]) | (around[1:] != around[:-1])])
    many = np.diff(np.append(np.flatnonzero(head), len(h))) > 1
    same = np.repeat(many, np.diff(np.append(np.flatnonzero(head), len(h))))
    rows = [h[head].view(np.int64), around[head].view(np.int64), keys[head], ((start << 16) | (left << 8) | right)[head], many.astype(np.int32)]
    if not same.any():
        return tuple(rows)
    own, begin, end = keys[same], (start - left)[same], (start + right)[same]
    by = np.lexsort((begin, own))
    own, begin, end = own[by], begin[by], end[by]
    base = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]])) << 40  # documents apart, so that one scan merges all
    a, b = merged(begin + base, end + base)
    at = np.searchsorted(begin + base, a)
    cover = [own[at], a - base[at], own[at], b - base[at], np.full(len(a), COVER, np.int32)]
    return tuple(np.concatenate(x) for x in zip(rows, cover, strict=True))


def anchor_rows(base: DataFrame, combine: bool = True, apart: bool = True) -> DataFrame:
    """(doc_id, key, text) -> (h, around, key, at, kind): at packs start, left and right; a cover has begin and end instead.

    Rows with the same key count as copies of each other if `apart`, else as one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not apart:
                batch = batch.take(pa.array(np.unique(batch.column(0).to_numpy(), return_index=True)[1]))
            keys, found = batch.column(0).to_numpy(), []
            for first, some in _runs(batch.column(1).to_pylist()):
                owner, *rest = anchors(some)
                found.append((keys[first + owner], *rest))
            columns = [np.concatenate(x) for x in zip(*found, strict=True)]
            if found and len(columns[0]):
                rows = combined(*columns) if combine else single(*columns)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["h", "around", "key", "at", "kind"])

    return base.select("key", "text").transform(batched, run, "h bigint, around bigint, key bigint, at bigint, kind int")


def single(keys: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray, h: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, ...]:
    """combined() without combining: a row for each anchor."""
    return h.view(np.int64), around.view(np.int64), keys, (start << 16) | (left << 8) | right, np.full(len(h), ONE, np.int32)


def _again(apart: bool) -> Column:
    """Whether a group of anchors has more than one occurrence."""
    other = (F.min(F.xxhash64("key", "at")) != F.max(F.xxhash64("key", "at"))) | (F.max("kind") == MANY)
    return other | (F.count("*") > 1) if apart else other


def repeated(rows: DataFrame, apart: bool = True) -> DataFrame:
    """Anchors (a written table, without covers) whose gram occurs again, as a written table, with what is known of their surroundings:

    `same` if other anchors have equal ones, `first` for one anchor of equal ones, and `differ`, how many the gram has.
    """
    grams = cut(rows.groupBy("h").agg(_again(apart).alias("again"), F.count("*").alias("times")).where("again").select("h", "times"))
    hits = cut(met(rows, grams, ["h"], rows.count()).drop("times"))
    by = ["h", "around"]
    each = cut(hits.groupBy(*by).agg(_again(apart).alias("same"), F.min(F.xxhash64("key", "at")).alias("least"), F.count("*").alias("times")))
    differ = cut(each.groupBy("h").agg(F.count("*").alias("differ")).select("h", "differ", F.col("differ").alias("times")))
    per = cut(met(each.withColumnRenamed("times", "n"), differ, ["h"], each.count()).drop("times").withColumnRenamed("n", "times"))
    found = met(hits, per, by, hits.count())
    found = cut(found.select("h", "around", "key", "at", "kind", "same", (F.xxhash64("key", "at") == F.col("least")).alias("first"), "differ"))
    dropped(grams, hits, each, differ, per)
    return found


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def intervals(rights: list[bytes], members: list[int] | None = None) -> Iterator[tuple[int, list[int], list[int]]]:
    """(common prefix, members, their children) of each common-prefix interval of some suffixes, children before their parents.

    A member's child is a number that it shares with those of the interval that share more than its common prefix.
    """
    order = sorted(range(len(rights)) if members is None else members, key=rights.__getitem__)
    shares = [common(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    stack: list[tuple[int, int]] = []
    for i in range(1, len(order) + 1):
        shared, begin = shares[i - 1] if i < len(order) else -1, i - 1
        while stack and stack[-1][0] > shared:
            depth, begin = stack.pop()
            child, children = 0, [0]
            for k in range(begin, i - 1):
                child += shares[k] == depth
                children.append(child)
            yield depth, order[begin:i], children
        if shared >= 0 and (not stack or stack[-1][0] < shared):
            stack.append((shared, begin))


def maximal(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> list[tuple[int, int, list[int]]]:
    """The maximal repeats (left, right, members) of occurrences with the same gram; lefts are read backwards from the anchor.

    Members share so much on either side, `length` bytes together at least. To their left they have different bytes (or a
    text's edge), as they are an interval of the left extensions; to their right too, as they are in different children.
    """
    found = []
    for depth, members, children in intervals(rights):
        if depth + LEFT < length:
            continue
        child = dict(zip(members, children, strict=True))
        for shared, some, _ in intervals(lefts, members):
            if shared + depth >= length and len({child[i] for i in some}) > 1:
                found.append((shared, depth, some))
    return found


MEMBER = "h bigint, key bigint, at bigint, same boolean, lft binary, rgt binary, side string"


def surroundings(base: DataFrame, members: DataFrame) -> DataFrame:
    """The bytes around anchors: (h, key, at, same, lft, rgt, side, big), lft read backwards from the anchor; side is for split()."""
    wanted = members.groupBy("key").agg(F.collect_list(F.struct("h", "at", "same", "big")).alias("a"))
    joined = base.join(wanted.withColumnRenamed("key", "__key"), F.col("key") == F.col("__key")).select("doc_id", "key", "text", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, want = batch.column(2)[i].as_py(), batch.column(3)[i].values
                at = want.field("at").to_numpy()
                start = (at >> 16).tolist()
                left = pa.array([text[a - n : a][::-1] for a, n in zip(start, (at >> 8 & 255).tolist(), strict=True)], pa.binary())
                right = pa.array([text[a : a + n] for a, n in zip(start, (at & 255).tolist(), strict=True)], pa.binary())
                keys = pa.array(np.full(len(at), batch.column(1)[i].as_py(), np.int64))
                columns = [want.field("h"), keys, want.field("at"), want.field("same"), left, right, pa.array(["rl"] * len(at)), want.field("big")]
                yield pa.RecordBatch.from_arrays(columns, ["h", "key", "at", "same", "lft", "rgt", "side", "big"])

    return joined.transform(batched, run, f"{MEMBER}, big boolean")


def first_intervals(rest: DataFrame) -> DataFrame:
    """(h, times, x, y) of each shard with several members: how many bytes all of them share to the left and to the right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [c.to_pylist() for c in batch.columns[2:]]
            x, y = [pa.array([common(a, b) for a, b in zip(low, high, strict=True)], pa.int32()) for low, high in (ends[:2], ends[2:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], x, y], ["h", "times", "x", "y"])

    ends = rest.groupBy("h").agg(F.count("*").alias("times"), F.min("lft").alias("a"), F.max("lft").alias("b"), F.min("rgt").alias("c"), F.max("rgt").alias("d"))
    return ends.where("times > 1").transform(batched, run, "h bigint, times bigint, x int, y int")


def split(big: DataFrame) -> DataFrame:
    """Members with x and y dealt into parts (new h) by their next bytes to the right, and again by those to the left.

    If the shared bytes are fewer than a repeat needs, a pair has half of the open ones to the right, or the others to the
    left. If they are as many, a pair with a longer repeat has one more byte on one side, and on that side alone the part is
    then split on: a 200-byte string that reaches beyond the shared bytes to the right ends on the left within them.
    """
    names = ["h", "key", "at", "same", "lft", "rgt", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, key, at, same, lft, rgt, sides, x, y in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                open_ = max(1, LENGTH - x - y)
                right = (open_ + 1) // 2
                for side, more, begin, own in (("r", right, y, rgt), ("l", open_ + 1 - right, x, lft)):
                    if side in sides and begin + more <= len(own):
                        part = hashlib.blake2b(own[begin : begin + more], digest_size=8, key=(h & (1 << 64) - 1).to_bytes(8, "little"), salt=side.encode()).digest()
                        rows.append((int.from_bytes(part, "little", signed=True), key, at, same, lft, rgt, side if x + y >= LENGTH else sides))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return big.select(*names, "x", "y").transform(batched, run, MEMBER)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows with the same first column, from batches sorted by it; a row that repeats (key, at) once."""
    held: dict[tuple, tuple] = {}
    now = None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and now != row[0]:
                yield list(held.values())
                held = {}
            now = row[0]
            held[row[1], row[2]] = row
    if held:
        yield list(held.values())


REPEAT = "h bigint, repeat bigint, key bigint, at bigint, same boolean, x bigint, y bigint"


def tree_repeats(shards: DataFrame, each: bool = True) -> DataFrame:
    """(h, repeat, key, at, same, x, y): the members of the maximal repeats in each shard's tree, with what they share.

    Without `each`, a member has one row (with repeat 0) that says how far its repeats reach to either side: they all hold
    its anchor, so that together they cover one stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            kinds = [pa.bool_() if k == 4 else pa.int64() for k in range(7)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, ["h", "repeat", "key", "at", "same", "x", "y"])

        for group in _groups(batches):
            found = maximal([r[4] for r in group], [r[5] for r in group])
            if not each:
                reach: dict[int, tuple[int, int]] = {}
                for left, right, some in found:
                    for i in some:
                        x, y = reach.get(i, (0, 0))
                        reach[i] = max(x, left), max(y, right)
                rows += [(*group[i][:1], 0, *group[i][1:4], x, y) for i, (x, y) in reach.items()]
                found = []
            for k, (left, right, some) in enumerate(found):
                rows += [(group[i][0], k, group[i][1], group[i][2], group[i][3], left, right) for i in some]
                if len(rows) > 10_000:
                    yield out()
            if len(rows) > 10_000:
                yield out()
        yield out()

    dealt = shards.repartition(parts(shards), "h").sortWithinPartitions("h")
    return dealt.select("h", "key", "at", "same", "lft", "rgt").transform(batched, run, REPEAT)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder; unlike a checkpoint's, its plan knows nothing of the rounds before."""
    path = f"{shared_dir(df.sparkSession)}/parts-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach(part: DataFrame, side: str, known: str) -> DataFrame:
    """(h, key, at, far): the longest common prefix of each member's `side` with any other's of its shard, `known` at least.

    Members are sorted over all tasks, where that prefix is one of a member with its neighbours. What reaches the driver
    has two rows for each partition.
    """
    own = part.select("h", F.col(side).alias("own"), "key", "at", F.col(known).alias("known"))
    own = own.repartitionByRange(parts(part), "h", "own", "key", "at").sortWithinPartitions("h", "own", "key", "at")
    own = cut(own.withColumn("part", F.spark_partition_id().cast("long")))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if batch.num_rows:
                first = first or (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
                last, at = (batch.column(0)[-1].as_py(), batch.column(1)[-1].as_py()), batch.column(2)[0].as_py()
        if first:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([at, at], [first[0], last[0]], [first[1], last[1]])], ["part", "h", "own"])

    edges = sorted(((r["part"], k, r["h"], bytes(r["own"])) for k, r in enumerate(own.select("h", "own", "part").transform(batched, ends, "part bigint, h bigint, own binary").collect())), key=lambda e: e[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = after = None
        held: list[tuple] = []  # the row that waits for its next one, with its prefix so far

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["h", "key", "at", "far"])

        for batch in batches:
            done = []
            if batch.num_rows and not held:
                at = batch.column(5)[0].as_py()
                before, after = next((e[2:] for e in reversed(edges) if e[0] < at), None), next((e[2:] for e in edges if e[0] > at), None)
            for h, mine, key, place, least, _ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                shared = common(before[1], mine) if before and before[0] == h else 0
                if held:
                    done.append((*held[0][:3], max(held[0][3], shared if held[0][0] == h else 0)))
                held, before = [(h, key, place, max(least, shared))], (h, mine)
            if done:
                yield out(done)
        if held:
            shared = common(before[1], after[1]) if after and after[0] == held[0][0] else 0
            yield out([(*held[0][:3], max(held[0][3], shared))])

    return own.transform(batched, run, "h bigint, key bigint, at bigint, far bigint")


def repeats(base: DataFrame, members: DataFrame, most: int = TREE_MEMBERS, each: bool = True) -> DataFrame:
    """tree_repeats of all shards; members are one anchor for each of several surroundings (a written table).

    Of a part with too many members that share all of a 200-byte string, this is the first repeat. Longer ones reach beyond
    it on one side and end on the other within it, so without `each` the farthest shared byte on either side is enough.
    """
    around = surroundings(base, members.withColumn("big", F.col("differ") > most))
    found: list[DataFrame] = []
    split_up = members.where(F.col("differ") > most).limit(1).count() > 0
    if split_up:  # then the texts are shuffled once for both kinds of shards
        around = written(around)
    shards = around.where("not big").drop("big")
    if split_up:
        rest = written(around.where("big").drop("big").dropDuplicates(["h", "key", "at"]))
        while rest is not None:
            ends = written(first_intervals(rest))
            rest = written(met(rest, ends, ["h"], rest.count()).coalesce(parts(base)))
            shards = shards.unionByName(rest.where(F.col("times") <= most).drop("times", "x", "y"))
            big, whole = rest.where(F.col("times") > most), F.col("x") + F.col("y") >= LENGTH
            shared = big.where(whole)
            if each:
                found.append(shared.select("h", F.lit(-1).cast("long").alias("repeat"), "key", "at", "same", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")))
            else:
                if shared.limit(1).count():
                    left, right = reach(shared, "lft", "x").withColumnRenamed("far", "x"), reach(shared, "rgt", "y").withColumnRenamed("far", "y")
                    both = shared.select("h", "key", "at", "same").join(left, ["h", "key", "at"]).join(right, ["h", "key", "at"])
                    found.append(both.select("h", F.lit(-1).cast("long").alias("repeat"), "key", "at", "same", "x", "y"))
                big = big.where(~whole)
            rest = written(split(big)) if big.limit(1).count() else None
    out = tree_repeats(shards, each)
    for more in found:
        out = out.unionByName(more)
    return out


def _place(shift: Column) -> Column:
    return F.shiftright("at", 16) - shift


def maximal_repeats(docs: DataFrame, most: int = TREE_MEMBERS) -> DataFrame:
    """Maximal repeats of 200 bytes or more: (repeat, length, doc_id, start), a row for each of all their occurrences.

    A repeat ends where its occurrences begin to differ. One that is longer than the surroundings of an anchor (120 bytes
    to the left, 200 to the right) is put together from the pieces that have the same occurrences; where a part of it occurs
    elsewhere too, that part is a repeat of its own and the rest comes in the pieces to its sides. Rows that repeat a doc_id
    and text are one document. Null and short texts have no repeats; an empty table has no rows.
    """
    base = _base(docs)
    found = repeated(cut(anchor_rows(base, combine=False, apart=False)), apart=False)
    members = found.where(F.col("first") & (F.col("differ") > 1))
    left, right = F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255)
    # anchors with equal surroundings are a repeat of these; in a tree one of them stands for all
    alike = found.select("h", "around", "key", "at").distinct()
    equal = found.where("same").select(F.concat_ws(":", "h", "around").alias("piece"), "key", _place(left).alias("start"), (left + right).alias("length")).distinct()
    stood = repeats(base, members, most).select(F.concat_ws(":", "h", "repeat", F.lit("t")).alias("piece"), "key", "at", "x", "y")
    stood = stood.join(members.select("key", "at", "h", "around").distinct(), ["key", "at"]).select("piece", "h", "around", "x", "y")
    pieces = stood.join(alike, ["h", "around"]).select("piece", "key", _place(F.col("x")).alias("start"), (F.col("x") + F.col("y")).alias("length"))
    pieces = cut(equal.unionByName(pieces).distinct())
    # pieces with the same occurrences, but for a shift: the same documents, and the same sum of weighted starts from the first one's
    weight = F.pmod(F.xxhash64("key"), F.lit(1_000_003)).cast("decimal(20,0)")
    total = lambda c: F.sum(c.cast("decimal(38,0)"))
    per = pieces.groupBy("piece", "length").agg(
        F.min(F.struct("key", "start")).alias("lead"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("keys"), total(weight * F.col("start")).alias("s"), total(weight).alias("w"),
        F.sum("start").alias("plain"),
    )
    first = F.col("lead.start")
    per = per.select("piece", "length", F.col("lead.key").alias("key"), first.alias("start"), "n", "keys", (F.col("s") - F.col("w") * first).alias("shape"), (F.col("plain") - F.col("n") * first).alias("rest"))
    by = Window.partitionBy("key", "n", "keys", "shape", "rest").orderBy("start", F.desc("length"), "piece")
    high = F.max(F.col("start") + F.col("length")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = per.withColumn("island", F.sum((F.coalesce(F.col("start") > high, F.lit(True))).cast("int")).over(by))
    name = Window.partitionBy("key", "n", "keys", "shape", "rest", "island")
    heads = islands.withColumn("end", F.max(F.col("start") + F.col("length")).over(name)).withColumn("r", F.row_number().over(name.orderBy("start", F.desc("length"), "piece")))
    heads = heads.where("r = 1").select("piece", (F.col("end") - F.col("start")).alias("total"))
    out = pieces.join(heads, "piece").join(base.select("key", "doc_id").distinct(), "key")
    return out.select(F.col("piece").alias("repeat"), F.col("total").cast("long").alias("length"), "doc_id", "start")


def _base(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the row's doc_id and text as its key, and the text's bytes (null: none)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return only(docs, "doc_id", "text").select("doc_id", F.xxhash64("doc_id", text).alias("key"), text.cast("binary").alias("text"))


def covered(docs: DataFrame, apart: bool = True, most: int = TREE_MEMBERS) -> DataFrame:
    """(covered, spans): for each key that has some, the stretches (begin, end) of its bytes that maximal repeats cover, as a written table.

    Rows that repeat a key are copies if `apart`.
    """
    base = _base(docs)
    rows = cut(anchor_rows(base, apart=apart))
    known = cut(rows.where(F.col("kind") == COVER).select("key", F.col("around").alias("begin"), F.col("at").alias("end")))
    found = repeated(rows.where(F.col("kind") != COVER), apart)
    dropped(rows)
    left, right = F.shiftright("at", 8).bitwiseAND(255), F.col("at").bitwiseAND(255)
    equal = found.where(F.col("same") & (F.col("kind") == ONE)).select("key", _place(left).alias("begin"), _place(-right).alias("end"))
    tree = repeats(base, found.where(F.col("first") & (F.col("differ") > 1)), most, each=False).where("not same")
    spans = known.union(equal).union(tree.select("key", _place(F.col("x")).alias("begin"), _place(-F.col("y")).alias("end")))
    out = cut(spans.groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("spans")).withColumnRenamed("key", "covered"))
    dropped(known, found)
    return out


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of some stretches."""
    order = np.argsort(begin, kind="stable")
    begin, high = begin[order], np.maximum.accumulate(end[order])
    head = np.concatenate([[True], begin[1:] > high[:-1]])
    return begin[head], high[np.append(np.flatnonzero(head)[1:] - 1, len(high) - 1)]


def _kept(text: bytes, spans: pa.Scalar) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed, runs removed."""
    if not spans.is_valid or not len(spans.values):
        return text, 0, 0
    begin, end = merged(spans.values.field("begin").to_numpy(), spans.values.field("end").to_numpy())
    edges = zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True)
    return b"".join([text[a:b] for a, b in edges]), int((end - begin).sum()), len(begin)


def digest(docs: DataFrame, most: int = TREE_MEMBERS) -> DataFrame:
    """Per row of docs: n_bytes, n_removed, n_spans and SHA-256 of the remaining bytes.

    Null texts are empty; texts under 200 bytes lose nothing; longer ones of any length are taken whole. Rows that repeat a
    doc_id and text are copies of each other, and lose all but what is under 200 bytes. Other columns play no part. Empty
    tables give no rows.
    """
    base = _base(docs)
    joined = base.join(covered(docs, True, most), F.col("key") == F.col("covered"), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                left, removed, n = _kept(text, batch.column(2)[i])
                rows.append((len(text), removed, n, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.transform(batched, run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, most: int = TREE_MEMBERS) -> DataFrame:
    """docs with covered bytes removed from `text` and n_chars brought up to date; documents left without a word go.

    Rows that repeat a doc_id and text are one document here, not copies: they lose what it shares with others or within
    itself. Copies under different doc_ids lose all that they share. Bytes of a character that was cut in two become U+FFFD.
    Rows from which nothing was removed pass unchanged, null and empty texts included. All columns stay, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = packed(docs, "doc_id", "text").select("row", F.xxhash64("doc_id", text).alias("key"), F.col("text").cast("string").alias("text"))
    joined = rows.join(covered(docs, False, most), F.col("key") == F.col("covered"), "left").select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lost, stays = [], [], []
            for i in range(batch.num_rows):
                own = batch.column(1)[i].as_py()
                left, removed, _ = _kept((own or "").encode(), batch.column(2)[i])
                out.append(left.decode(errors="replace") if removed else own)
                lost.append(removed > 0)
                stays.append(not removed or bool(left.split()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(lost, pa.bool_()), pa.array(stays, pa.bool_())], ["row", "text", "lost", "stays"])

    kept = joined.transform(batched, run, f"row {rows.schema['row'].dataType.simpleString()}, text string, lost boolean, stays boolean").where("stays")
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("lost"), F.char_length("text")).otherwise(F.col("row")[f"c{docs.columns.index('n_chars')}"])
    return unpacked(kept, docs, **changed)
