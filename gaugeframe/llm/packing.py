"""Lexical retrieval packing of documents into sequences of 1024 tokens.

Whole texts are encoded once. The document frequency of every token is counted over the whole corpus, and with it each
document's rarest tokens, by which documents are sorted into partitions: those that share rare tokens, and all copies of a
text, become neighbours. Runs of that order are the shards of an inverted index with BM25 weights. A seed document opens a
window; the index scores all documents of its shard by all of the seed's tokens, and the unused ones fill the window in order
of their score. What doesn't fit is cut and opens the next window, so only the end of a partition leaves an open one. That rest
is cut into sequences whose lengths are powers of two: nothing is padded, at the price of up to ten short sequences at the
end of each partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import bpe
from gaugeframe.llm._shared import batched, cut, only, parts

WINDOW, END = 1024, 0
#: A shard has so many documents or tokens (the document that reaches it included); BM25's parameters; rare tokens that sort a document.
SHARD_DOCS, SHARD_TOKENS, K1, B, RARE = 512, 1 << 18, 1.2, 0.75, 3
#: A sequence's id is its partition's number times this, plus a count.
SEQUENCES = 1 << 40


@dataclass
class Corpus:
    """What BM25 needs of the whole corpus: documents, their mean length, and the inverse frequency of each token."""

    docs: int
    mean: float
    df: np.ndarray

    def __post_init__(self):
        self.idf = np.log1p((self.docs - self.df + 0.5) / (self.df + 0.5)).astype(np.float32)
        # tokens from the rarest that two documents have to the commonest; those of one document tell nothing
        order = np.lexsort((np.arange(len(self.df)), np.where(self.df > 1, self.df, np.iinfo(np.int64).max)))
        self.rank = np.empty(len(self.df), np.int32)
        self.rank[order] = np.arange(len(self.df))


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct tokens and how often each occurs."""
    x = np.sort(ids, kind="stable")
    new = np.ones(len(x) + 1, bool)
    np.not_equal(x[1:], x[:-1], out=new[1:-1])
    at = new.nonzero()[0]
    return x[at[:-1]], at[1:] - at[:-1]


def smallest(x: np.ndarray, n: int) -> list[int]:
    """The n smallest distinct values, or all."""
    out: list[int] = []
    while len(x) and len(out) < n:
        out.append(int(x.min()))
        x = x[x > out[-1]]
    return out


class Bm25:
    """An inverted index over one shard: for each of its tokens the documents that have it and their weights, in one table."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        found = [distinct(ids) for ids in docs]
        sizes = np.array([len(x) for x in docs], np.float32)
        owner = np.repeat(np.arange(len(docs)), [len(t) for t, _ in found])
        all_terms = np.concatenate([t for t, _ in found])
        known, term = np.unique(all_terms, return_inverse=True)
        tf = np.concatenate([n for _, n in found]).astype(np.float32)
        self.weight = np.zeros((len(known), len(docs)), np.float32)
        self.weight[term, owner] = corpus.idf[all_terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[owner] / max(corpus.mean, 1)))
        self.terms = np.split(term, np.cumsum([len(t) for t, _ in found])[:-1])

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document of the shard for all distinct tokens of one of them."""
        return self.weight[self.terms[doc]].sum(axis=0)

    def neighbours(self, doc: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a token with the seed, best first, ties to the earlier one."""
        score = self.scores(doc)
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


class Packer:
    """Fills windows from shard after shard; rows() are the pieces (document, start, length, sequence, offset)."""

    def __init__(self, window: int = WINDOW):
        self.window, self.sequence, self.filled = window, 0, 0
        self.pieces: list[list[int]] = []
        self.open: list[list[int]] = []

    def place(self, doc: int, size: int) -> None:
        start = 0
        while start < size:
            take = min(size - start, self.window - self.filled)
            self.open.append([doc, start, take, self.sequence, self.filled])
            start, self.filled = start + take, self.filled + take
            if self.filled == self.window:
                self.close()

    def close(self) -> None:
        self.pieces += self.open
        self.open, self.filled, self.sequence = [], 0, self.sequence + 1

    def pack(self, docs: list[np.ndarray], base: int, corpus: Corpus) -> None:
        """Places all documents of a shard; base is added to their numbers."""
        index, used = Bm25(docs, corpus), np.zeros(len(docs), bool)
        for first in range(len(docs)):
            if used[first]:
                continue
            seed, used[first] = first, True
            self.place(base + first, len(docs[first]))
            while self.filled:
                before, cut = self.sequence, None
                for near in index.neighbours(seed, used).tolist():
                    used[near] = True
                    self.place(base + near, len(docs[near]))
                    if self.sequence != before:
                        cut = near
                        break
                if cut is None:  # nothing alike is left; the next document goes into the open window
                    break
                seed = cut  # what was cut off opens the next window

    def finish(self) -> None:
        """Cuts the open window into sequences whose lengths are powers of two, the longest first."""
        rest = self.open
        self.open = []
        while (left := sum(p[2] for p in rest)) > 0:
            room, at, tail = 1 << (left.bit_length() - 1), 0, []
            for doc, start, size, *_ in rest:
                take = min(size, room - at)
                if take:
                    self.pieces.append([doc, start, take, self.sequence, at])
                    at += take
                if size > take:
                    tail.append([doc, start + take, size - take])
            rest, self.sequence = tail, self.sequence + 1
        self.filled = 0


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of whole texts, the end id last; ids are 16-bit numbers where the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.vocabulary(path)
        kind = _kind(coder)
        for batch in batches:
            for at in range(0, batch.num_rows, bpe.SLICE):
                rows = batch.slice(at, bpe.SLICE)
                ids = [np.frombuffer(raw + END.to_bytes(4, "little"), "<u4").astype(kind).tobytes() for raw in coder.encode(rows.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])
        coder.rest()

    texts = only(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return texts.transform(batched, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def _kind(coder: bpe.ByteBpe) -> str:
    return "<u2" if len(coder.lengths) <= 1 << 16 else "<u4"


def corpus_of(rows: DataFrame, path: str) -> Corpus:
    """Document frequencies over all documents; what reaches the driver has a row for each token of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.vocabulary(path)
        df, sums, kind = np.zeros(len(coder.lengths), np.int64), np.zeros(2, np.int64), _kind(coder)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids = np.frombuffer(raw, kind)
                df[distinct(ids)[0]] += 1
                sums += (1, len(ids))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([sums, df[at]]))], ["token", "n"])

    got = rows.select("ids").transform(batched, run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    token, n = got["token"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(len(bpe.vocabulary(path).lengths), np.int64)
    df[token[token >= 0]] = n[token >= 0]
    docs, tokens = (int(n[token == k].sum()) for k in (-2, -1))
    return Corpus(docs, tokens / max(docs, 1), df)


def routed(rows: DataFrame, corpus: Corpus, path: str) -> DataFrame:
    """rows dealt by ranges of (route, salt) and sorted by them; route is a document's rarest tokens, the rarest first.

    The salt, a hash of the row, lets a group of copies of any size be cut between partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _kind(bpe.vocabulary(path))
        for batch in batches:
            found = np.full((batch.num_rows, RARE), 1 << 16 if kind == "<u2" else 1 << 30, np.int64)
            for i, raw in enumerate(batch.column(1).to_pylist()):
                low = smallest(corpus.rank[np.frombuffer(raw, kind)], RARE)
                found[i, : len(low)] = low
            keys = [f"r{k}" for k in range(RARE)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(found[:, k].astype(np.int32)) for k in range(RARE)]], ["doc_id", "ids", *keys])

    keys = [f"r{k}" for k in range(RARE)]
    out = rows.transform(batched, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, " + ", ".join(f"{k} int" for k in keys))
    out = out.withColumn("salt", F.xxhash64("doc_id", "ids"))
    return out.repartitionByRange(parts(rows), *keys, "salt").sortWithinPartitions(*keys, "salt").select("doc_id", "ids")


def pack(docs: DataFrame, path: str | None = None, shard_docs: int = SHARD_DOCS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and `ids`, binary).

    A null or empty text is one token, the end id; texts of any length are packed whole. Repeated rows are documents of their
    own; other columns play no part. An empty table has no piece.
    """
    path = path or bpe.default_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"`{c}` bigint" for c in names[1:]) + (", ids binary" if with_ids else "")
    rows = cut(encoded(docs, path))
    corpus = corpus_of(rows, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, kind = Packer(), _kind(bpe.vocabulary(path))
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) * SEQUENCES
        key: pa.DataType | None = None
        held: dict[int, tuple[object, np.ndarray]] = {}  # documents that an open window still refers to
        shard: list[np.ndarray] = []
        size = first = count = 0

        def out() -> pa.RecordBatch:
            pieces, packer.pieces = packer.pieces, []
            cols = np.array(pieces, np.int64).reshape(-1, 5)
            ids = [held[d][1][s : s + n].astype("<u4").tobytes() for d, s, n, *_ in pieces]
            arrays = [
                pa.array([held[d][0] for d in cols[:, 0].tolist()], key), pa.array(cols[:, 1]), pa.array(cols[:, 2]), pa.array(np.array([zlib.crc32(x) for x in ids], np.int64)),
                pa.array(np.array([len(held[d][1]) for d in cols[:, 0].tolist()], np.int64)), pa.array(cols[:, 3] + base), pa.array(cols[:, 4]),
            ]
            alive = {p[0] for p in packer.open}
            for d in [d for d in held if d not in alive]:
                del held[d]
            return pa.RecordBatch.from_arrays([*arrays, *([pa.array(ids, pa.binary())] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])

        for batch in batches:
            key = batch.schema.field(0).type
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, kind)
                held[count] = (doc_id, ids)
                shard.append(ids)
                count, size = count + 1, size + len(ids)
                if size >= SHARD_TOKENS or len(shard) >= shard_docs:
                    packer.pack(shard, first, corpus)
                    shard, size, first = [], 0, count
                    yield out()
        if shard:
            packer.pack(shard, first, corpus)
        packer.finish()
        if packer.pieces:
            yield out()

    return routed(rows, corpus, path).transform(batched, run, schema)
