"""Toxicity by non-negative positive-unlabelled learning, in numpy.

Confirmed toxic documents are the positives; all other text counts as unlabelled, whatever it is. The risk of calling
unlabelled text clean is corrected by the class prior and kept from going negative (it counts as zero where it would). The
classifier is linear over the hashed set of words of the whole text. Its weights and its base are what minimises that
risk. A word's weight is penalised the less, the more clearly its share of the positives exceeds its share of the
unlabelled, as otherwise the many words of few documents fit the positives by heart and the risk soon counts as zero.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import _scoring
from gaugeframe.llm._scoring import Adam, sigmoid
from gaugeframe.llm._shared import batched, only, unpacked

BITS = 18
#: Documents drawn at most: confirmed positives, unlabelled.
POSITIVES, UNLABELLED = 4000, 8000
#: A word is a feature if this many distinct positives have it; the excess, in standard errors, at which a quarter of the
#: penalty is left out of account.
MIN_POSITIVES, CLEAR = 3, 6.0
PASSES, RATE, DECAY = 150, 0.1, 1e-3
THRESHOLD = 0.3

#: ASCII letters in lower case; digits and bytes of other characters as they are; the rest separates words.
_LETTERS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def features(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the words of a whole text."""
    mask = (1 << BITS) - 1
    return np.unique(np.fromiter((zlib.crc32(w) & mask for w in set(text.translate(_LETTERS).split())), np.int64))


class Linear:
    def __init__(self, weights: np.ndarray, base: float):
        self.at = np.flatnonzero(weights)
        self.value, self.base = weights[self.at], base
        self._dense: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self._dense is None:
            self._dense = np.zeros(1 << BITS)
            self._dense[self.at] = self.value
        return sigmoid(np.array([self._dense[features(t)].sum() + self.base for t in texts], np.float64))


def risk(toxic: np.ndarray, other: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of margins of positives and unlabelled under the logistic loss, and its slopes by them."""
    fp, fu = sigmoid(toxic), sigmoid(other)
    miss = -prior * np.log(np.maximum(fp, 1e-12)).mean()
    # loss of calling clean: over all unlabelled, less the part that the positives among them have
    clean = -np.log(np.maximum(1 - fu, 1e-12)).mean() + prior * np.log(np.maximum(1 - fp, 1e-12)).mean()
    by_miss = prior * (fp - 1) / len(fp)
    if clean < 0:  # below what any classifier can have: overfitting, which counts as none
        return miss, by_miss, np.zeros(len(fu))
    return miss + clean, by_miss - prior * fp / len(fp), fu / len(fu)


def scales(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """How freely the weight of each word can move, from 0 to 1."""
    seen = np.bincount(np.concatenate(positive), minlength=1 << BITS)
    usual = (np.bincount(np.concatenate(unlabelled), minlength=1 << BITS) + 1) / (len(unlabelled) + 2)
    z = np.maximum((seen / len(positive) - usual) / np.sqrt(usual * (1 - usual) / len(positive)), 0)
    return np.where(seen >= min(MIN_POSITIVES, len(positive)), (z / (z + CLEAR)) ** 2, 0)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Linear:
    """Minimises the non-negative risk; without positives or unlabelled text nothing tells texts apart, and none is called toxic."""
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    alone = list({x.tobytes(): x for x in positive}.values())  # a text that was copied counts once
    if not alone or not unlabelled:
        return Linear(np.zeros(1 << BITS), float(np.log(1e-4)))
    free = scales(alone, unlabelled)
    used = np.flatnonzero(free)
    column, scale = np.full(1 << BITS, -1), free[used]
    column[used] = np.arange(len(used))

    def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = column[np.concatenate(rows)]
        return doc[col >= 0], col[col >= 0]

    (pd, pc), (ud, uc) = sparse(alone), sparse(unlabelled)
    w, b = np.zeros(len(used)), np.array([np.log(prior / (1 - prior))])
    adam = Adam([w, b], RATE)
    for k in range(PASSES):
        adam.rate = RATE * (1 - k / PASSES)
        value = w * scale
        _, dp, du = risk(np.bincount(pd, value[pc], len(alone)) + b[0], np.bincount(ud, value[uc], len(unlabelled)) + b[0], prior)
        slope = np.bincount(pc, dp[pd], len(used)) + np.bincount(uc, du[ud], len(used))
        adam.step([slope * scale + DECAY * prior * w, np.array([dp.sum() + du.sum()])])
    weights = np.zeros(1 << BITS)
    weights[used] = w * scale
    return Linear(weights, float(b[0]))


def _hashed(texts: DataFrame) -> list[np.ndarray]:
    """The features of drawn documents, found by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "f"])

    out = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, f array<int>"
    got = texts.select("doc_id", "text").transform(batched, run, out).toArrow().sort_by("doc_id")
    found = got["f"].combine_chunks()
    found = found if isinstance(found, pa.ListArray) else pa.concat_arrays(found.chunks) if got.num_rows else pa.array([], pa.list_(pa.int32()))
    values, ends = found.flatten().to_numpy().astype(np.int64), np.cumsum(found.value_lengths().to_numpy())
    return np.split(values, ends[:-1]) if got.num_rows else []


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Linear:
    """Fits to bounded samples; the class prior is the toxic share of all labels that may be learnt from."""
    marked = _scoring.learnable(labels, "toxic")
    n, ones = marked.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    known = _scoring.drawn(marked.where("y = 1").select("doc_id"), positives)
    other = _scoring.drawn(only(docs, "doc_id"), unlabelled)
    return fit(_hashed(_scoring.texts_of(docs, known)), _hashed(_scoring.texts_of(docs, other)), (ones + 0.5) / (n + 1) if n else 0.01)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score and predicted.

    Null and empty texts get the score of the empty text; texts of any length are scored whole. Rows that repeat a doc_id
    are scored each by its own text, and one of their texts is learnt from. A null doc_id isn't held out or learnt from; a
    doc_id labelled both ways isn't learnt from. Without a toxic text to learn from all scores are the same and low. An
    empty table gives no rows.
    """
    return _scoring.digest(docs, train(docs, labels).score, THRESHOLD)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score is below the threshold, with all their columns, whatever these are called.

    Nulls, long texts and repeated rows as in digest: rows with the same text stay or go together.
    """
    out = _scoring.scored(docs, train(docs, labels).score)
    return unpacked(out.where(F.col("score") < THRESHOLD), docs)
