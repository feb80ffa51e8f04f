"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one full-dimensional codeword of each codebook. Codebooks are fitted one after
the other to the residuals of a bounded sample; every row is then encoded by a beam search over partial sums and stored
as one byte a codebook with the norm of its approximation. A query's dot products with all codewords make a lookup
table, from which codes are scored; the best are ranked again by the exact cosine of the original vectors.

Queries and codes are dealt into blocks, and each pair of blocks is a group of one join: no driver loop, no broadcast, and a
task holds one block of either. A query's list of candidates is taken as complete if it reaches so far below its best
approximate scores that the codes' usual error can't hide a neighbour behind its end. Where it doesn't, as in a large group
of nearly equal vectors, whose codes say little, the query is scored exactly against all vectors, in blocks as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.llm._shared import batched, cut, only, parts

#: Codebooks, codewords of each, partial sums kept by the beam, vectors fitted to at most, rounds of k-means, seed.
BOOKS, WORDS, BEAM, SAMPLE, ROUNDS, SEED = 16, 256, 4, 16_384, 8, 11
#: Neighbours returned; candidates of each query that are ranked exactly at once; queries and rows of a block at most, on average.
NEIGHBOURS, RERANKED, QUERY_BLOCK, ROW_BLOCK = 5, 300, 1024, 32_768
#: A candidate list is complete if its last score is so many standard errors of a code's score below that of its fifth.
MARGIN = 2.5
#: Rows scored at once; magnitudes between which vectors are taken as they are, others are scaled to a largest component of 1.
ROWS_AT_ONCE, SMALL, LARGE = 2048, 1e-100, 1e100


@dataclass
class Quantiser:
    books: np.ndarray  # (books, words, dimensions), float32

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, books) and norms of the approximations of unit vectors."""
        n, words = len(x), self.books.shape[1]
        rest, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            squares = (rest * rest).sum(-1)[..., None] - 2 * (rest @ book.T) + (book * book).sum(-1)
            flat = squares.reshape(n, -1)
            k = min(beam, flat.shape[1])
            best = np.argpartition(flat, k - 1, axis=1)[:, :k] if k < flat.shape[1] else np.tile(np.arange(k), (n, 1))
            order = np.take_along_axis(flat, best, 1).argsort(axis=1, kind="stable")
            best = np.take_along_axis(best, order, 1)
            parent, word = best // words, best % words
            rest = np.take_along_axis(rest, parent[..., None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[..., None], 1), word[..., None].astype(np.uint8)], axis=2)
        return codes[:, 0], np.linalg.norm(x - rest[:, 0], axis=1).astype(np.float32)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The sums of codewords that codes stand for."""
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(books, words, queries): dot products of unit queries with all codewords."""
        return np.ascontiguousarray(np.einsum("mwd,qd->mwq", self.books, q, optimize=True))


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = SEED) -> Quantiser:
    """Codebooks for unit vectors, each by k-means on what the ones before leave."""
    rng = np.random.default_rng(seed)
    rest, out = x.astype(np.float32).copy(), []
    for _ in range(books):
        book = rest[rng.choice(len(rest), min(words, len(rest)), replace=False)].copy()
        for _ in range(ROUNDS):
            near = ((book * book).sum(-1) - 2 * (rest @ book.T)).argmin(axis=1)
            size = np.bincount(near, minlength=len(book))
            order = near.argsort(kind="stable")
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])[size > 0]
            book[size > 0] = np.add.reduceat(rest[order], starts, axis=0) / size[size > 0, None]
        near = ((book * book).sum(-1) - 2 * (rest @ book.T)).argmin(axis=1)
        rest -= book[near]
        out.append(book)
    return Quantiser(np.stack(out))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that take part: not null or zero, all components finite, of the commonest length.

    Very large and very small vectors are divided by their largest component, so that no square over- or underflows.
    """
    rows = only(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    fine = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0))
    length = fine.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    top = F.array_max(F.transform("x", lambda v: F.abs(v)))
    x = F.when((top > SMALL) & (top < LARGE), F.col("x")).otherwise(F.transform("x", lambda v: v / F.col("top")))
    return fine.where(F.size("x") == (length["d"] if length else 0)).withColumn("top", top).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = _matrix(column)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(rows: DataFrame, sample: int = SAMPLE) -> tuple[Quantiser | None, float]:
    """Codebooks from at most `sample` vectors, drawn by hash of their id, and the standard error of a code's score.

    A unit query's product with what a code leaves of a vector has a standard deviation of that rest's length divided by
    the root of the number of dimensions, if one direction of the rest is as likely as another.
    """
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().sort_by("vec_id")
    if not drawn.num_rows:
        return None, 0.0
    x = _units(drawn["x"]).astype(np.float32)
    quantiser, squares = fit(x), 0.0
    for at in range(0, len(x), ROWS_AT_ONCE):
        some = x[at : at + ROWS_AT_ONCE]
        squares += float(((some - quantiser.decode(quantiser.encode(some)[0])) ** 2).sum())
    return quantiser, math.sqrt(squares / len(x) / x.shape[1])


def encoded(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """(vec_id, codes, norm) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                codes, norm = quantiser.encode(_units(part.column(1)).astype(np.float32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm)], ["vec_id", "codes", "norm"])

    return rows.select("vec_id", "x").transform(batched, run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, codes binary, norm float")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(score) > k:
        least = -np.partition(-score, k - 1)[k - 1]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def nearest(queries: DataFrame, base: DataFrame, k: int, quantiser: Quantiser | None = None) -> DataFrame:
    """(query_id, vec_id, approx): for each query the k best of each block of `base`, itself aside.

    queries are (query_id, q); base is (vec_id, codes, norm) with a quantiser, else (vec_id, x), scored exactly.
    """
    spark, tasks = queries.sparkSession, max(parts(queries), queries.sparkSession.sparkContext.defaultParallelism)
    of_queries = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    of_rows = max(2 * spark.sparkContext.defaultParallelism, math.ceil(base.count() / ROW_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = queries.select(block("query_id", of_queries).alias("i"), every(of_rows).alias("j"), "query_id", "q").repartition(tasks, "i", "j")
    right = base.select(every(of_queries).alias("i"), block("vec_id", of_rows).alias("j"), *base.columns).repartition(tasks, "i", "j")

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        query, own = asked["query_id"].to_numpy(), rows["vec_id"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, own.dtype), np.zeros(0))] * len(query)
        if len(query) and len(own):
            units = _units(asked["q"])
            if quantiser is None:
                all_rows = _units(rows["x"])
            else:
                tables, norms = quantiser.tables(units.astype(np.float32)), np.maximum(rows["norm"].to_numpy(), 1e-12)
                codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(own), -1)
            for at in range(0, len(own), ROWS_AT_ONCE):
                some = slice(at, at + ROWS_AT_ONCE)
                if quantiser is None:
                    score = units @ all_rows[some].T
                else:
                    score = tables[0][codes[some, 0]]
                    for m in range(1, codes.shape[1]):
                        score += tables[m][codes[some, m]]
                    score = np.ascontiguousarray((score / norms[some, None]).T)
                for i, q in enumerate(query):
                    s, v = score[i], own[some]
                    old_v, old_s = found[i]
                    fine = np.flatnonzero((v != q) & (s >= old_s[-1])) if len(old_s) >= k else np.flatnonzero(v != q)
                    if len(fine):
                        s, v = np.concatenate([old_s, s[fine]]), np.concatenate([old_v, v[fine]])
                        top = _best(s, v, k)
                        found[i] = (v[top], s[top])
        ids, scores = np.concatenate([v for v, _ in found] or [own[:0]]), np.concatenate([s for _, s in found] or [np.zeros(0)])
        return pa.table({"query_id": np.repeat(query, [len(v) for v, _ in found]), "vec_id": ids, "approx": scores.astype(np.float64)})

    out = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {base.schema['vec_id'].dataType.simpleString()}, approx double"
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, out)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(vectors: DataFrame, every: int = 50, neighbours: int = NEIGHBOURS, reranked: int = RERANKED, margin: float = MARGIN) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row whose vec_id is divisible by `every`.

    Nearness is the cosine of the original vectors, of any finite magnitude; ties go to the smaller vec_id. Of rows with the
    same vector only the smallest ids can be among the nearest, so `neighbours` + 1 of them (one may be the query) are
    searched. Rows that repeat a vec_id count once. Null, zero and non-finite vectors, and those of another length than
    most, take no part; other columns play none. No usable vector gives no rows.
    """
    rows = cut(usable(vectors).dropDuplicates(["vec_id"]))
    quantiser, error = fitted(rows)
    if quantiser is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    first = Window.partitionBy("x").orderBy("vec_id")
    alone = cut(rows.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= neighbours + 1).select("vec_id", "x"))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    near = Window.partitionBy("query_id").orderBy(F.desc("approx"), "vec_id")
    listed = nearest(queries, cut(encoded(alone, quantiser)), reranked, quantiser).withColumn("r", F.row_number().over(near)).where(F.col("r") <= reranked)
    listed = cut(listed)
    ends = listed.groupBy("query_id").agg(F.max("r").alias("n"), F.min(F.when(F.col("r") <= neighbours, F.col("approx"))).alias("top"), F.min("approx").alias("last"))
    open_ = ends.where((F.col("n") == reranked) & (F.col("last") > F.col("top") - margin * error)).select("query_id")
    again = cut(queries.join(open_, "query_id"))
    pairs = listed.select("query_id", "vec_id")
    if again.limit(1).count():  # codes can't tell their neighbours apart: these are scored exactly
        exact = nearest(again, alone, 2 * neighbours).select("query_id", "vec_id")
        pairs = pairs.join(open_, "query_id", "left_anti").union(exact)
    both = pairs.join(rows, "vec_id").join(queries, "query_id").select("query_id", "vec_id", cosine(F.col("q"), F.col("x")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", "vec_id", "score")
