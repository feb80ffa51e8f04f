"""What the two classifiers share: bounded training samples and scoring of whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm._shared import batched, fold, only, packed

#: Rows of an Arrow batch that are scored at once.
SLICE = 64


def drawn(ids: DataFrame, rows: int) -> DataFrame:
    """At most `rows` of the distinct ids (one column, doc_id), by hash; small enough to broadcast."""
    picked = ids.where("doc_id is not null").distinct()
    return F.broadcast(picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the rows that labels may be learnt from; a doc_id labelled both ways isn't learnt from."""
    rows = only(labels, "doc_id", label).where((fold(F.col("doc_id")) != 2) & F.col(label).isin(0, 1))
    return rows.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("most")).where("y = most").select("doc_id", "y")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(ids' columns, text binary) for the drawn ids, each once: of rows that repeat an id, the text that sorts first."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = only(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    return rows.join(ids, "doc_id").groupBy(*ids.columns).agg(F.min("text").alias("text"))


def scored(docs: DataFrame, score: Callable[[list[bytes]], np.ndarray], *names: str) -> DataFrame:
    """Packed rows of docs with the named columns and `score` of each whole text (null: of the empty text). No shuffle."""
    rows = packed(docs, *names, "text").withColumn("text", F.col("text").cast("string"))
    if names:
        rows = rows.drop("row")
    kept = [f for f in rows.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [(t or "").encode() for t in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(score(texts), pa.float64())], [*[f.name for f in kept], "score"])

    return rows.select(*[f.name for f in kept], "text").transform(batched, run, schema)


def digest(docs: DataFrame, score: Callable[[list[bytes]], np.ndarray], threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    out = scored(docs, score, "doc_id")
    held: Column = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


class Adam:
    """Adam steps on a list of arrays, in place."""

    def __init__(self, values: list[np.ndarray], rate: float):
        self.values, self.rate, self.t = values, rate, 0
        self.m, self.v = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for x, g, m, v in zip(self.values, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
