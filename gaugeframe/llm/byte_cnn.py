"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into blocks of 128 bytes, two neighbouring blocks make a chunk, chunks overlap by a block and cover the
whole text. Learned filters read runs of four bytes; each filter's largest response in a chunk goes through a ReLU.
Over all chunks the largest response of each filter is kept, and these are combined by a logistic output.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm import _scoring
from gaugeframe.llm._scoring import Adam, sigmoid

BLOCK, KERNEL, FILTERS = 128, 4, 16
#: Training: documents drawn at most, passes, documents of a step, learning rate, weight decay, seed.
TRAIN_DOCS, PASSES, STEP_DOCS, RATE, DECAY, SEED = 3000, 12, 32, 0.02, 1e-4, 7
THRESHOLD = 0.7
#: A document that trains gives so many stretches of so many bytes at most, evenly spread from its first byte to its last.
STRETCHES, STRETCH = 24, 4096
#: Blocks whose responses are computed at once, so that they stay in the processor's cache.
AT_ONCE = 64


def blocks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each followed by zeros to whole blocks, a kernel's worth at least; first blocks."""
    sizes = np.array([-(-(len(t) + KERNEL) // BLOCK) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.zeros(int(first[-1]) * BLOCK + BLOCK, np.uint8)
    for t, at in zip(texts, first[:-1].tolist(), strict=True):
        flat[at * BLOCK : at * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
    return flat, first


class ByteCnn:
    def __init__(self, rng: np.random.Generator):
        self.table = (rng.standard_normal((KERNEL, 256, FILTERS)) * 0.1).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = (rng.standard_normal(FILTERS) * 0.1).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def responses(self, flat: np.ndarray, n: int, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(n, FILTERS): each filter's largest response in each block; with `where`, its byte."""
        out = np.empty((n, FILTERS), np.float32)
        place = np.empty((n, FILTERS), np.int64) if where else None
        for at in range(0, n, AT_ONCE):
            k = min(AT_ONCE, n - at)
            begin, size = at * BLOCK, k * BLOCK
            r = self.table[0][flat[begin : begin + size]]
            for j in range(1, KERNEL):
                r += self.table[j][flat[begin + j : begin + j + size]]
            r = r.reshape(k, BLOCK, FILTERS)
            if where:
                arg = r.argmax(axis=1)
                place[at : at + k] = arg + (np.arange(at, at + k) * BLOCK)[:, None]
                out[at : at + k] = np.take_along_axis(r, arg[:, None, :], 1)[:, 0]
            else:
                out[at : at + k] = r.max(axis=1)
        return out, place

    def forward(self, texts: list[bytes], train: bool = False) -> dict:
        flat, first = blocks(texts)
        n = int(first[-1])
        value, place = self.responses(flat, n, train)
        value += self.bias
        both = np.maximum(value, 0)
        last = np.zeros(n, bool)
        last[first[1:] - 1] = True
        pair = np.where(last, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))  # a chunk is a block and the next
        chunk = np.maximum(both, both[pair])
        high = np.maximum.reduceat(chunk, first[:-1], axis=0)
        logit = high.astype(np.float64) @ self.out.astype(np.float64) + float(self.base[0])
        return {"logit": logit, "both": both, "chunk": chunk, "high": high, "pair": pair, "place": place, "first": first, "flat": flat}

    def score(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.forward(texts)["logit"])

    def gradients(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        x = self.forward(texts, True)
        d = (sigmoid(x["logit"]) - y) * weight / weight.sum()
        g_out = x["high"].astype(np.float64).T @ d + DECAY * self.out
        doc = np.repeat(np.arange(len(texts)), np.diff(x["first"]))
        top = x["chunk"] == x["high"][doc]
        share = np.add.reduceat(top.astype(np.float64), x["first"][:-1], axis=0)[doc]
        g_chunk = d[doc][:, None] * top * self.out / share
        own = x["both"] >= x["both"][x["pair"]]
        g_both = np.where(own, g_chunk, 0)
        np.add.at(g_both, x["pair"], np.where(own, 0, g_chunk))
        g = g_both * (x["both"] > 0)
        live = np.nonzero(g)
        at = x["place"][live]
        cell = np.stack([(j * 256 + x["flat"][at + j].astype(np.int64)) * FILTERS + live[1] for j in range(KERNEL)])
        g_table = np.bincount(cell.ravel(), np.tile(g[live], KERNEL), KERNEL * 256 * FILTERS).reshape(self.table.shape)
        return [(g_table + DECAY * self.table).astype(np.float32), g.sum(axis=0).astype(np.float32), g_out.astype(np.float32), np.array([d.sum()], np.float32)]


def fit(texts: list[bytes], y: np.ndarray) -> ByteCnn:
    """A network fitted to texts with labels 0 or 1; with one class or none it gives the share of ones, smoothed."""
    rng = np.random.default_rng(SEED)
    model = ByteCnn(rng)
    share = (y.sum() + 1) / (len(y) + 2)
    model.base[0] = np.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        model.out[:] = 0
        return model
    adam = Adam([model.table, model.bias, model.out, model.base], RATE)
    steps = max(1, PASSES * len(texts) // STEP_DOCS)
    rate = adam.rate
    order = np.concatenate([rng.permutation(len(texts)) for _ in range(PASSES + 1)])
    for k in range(steps):
        adam.rate = rate * (1 - k / steps)
        at = order[k * STEP_DOCS : (k + 1) * STEP_DOCS]
        adam.step(model.gradients([texts[i] for i in at], y[at], np.ones(len(at))))
    return model


def stretches(text: Column) -> Column:
    """A binary text, or the stretches that stand for a longer one."""
    room = F.octet_length(text) - STRETCH
    some = [F.substr(text, F.floor(room * k / (STRETCHES - 1)).cast("int") + 1, F.lit(STRETCH)) for k in range(STRETCHES)]
    return F.when(F.octet_length(text) > STRETCHES * STRETCH, F.concat(*some)).otherwise(text)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_DOCS) -> ByteCnn:
    """Fits to at most `rows` labelled documents outside the held-out fold, drawn by hash of their doc_id.

    The driver holds their texts, of which each has a bounded size (`stretches`).
    """
    marked = _scoring.learnable(labels, "quality")
    ids = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = _scoring.texts_of(docs, F.broadcast(ids)).select("doc_id", "y", stretches(F.col("text")).alias("text")).toArrow()
    got = got.sort_by("doc_id")
    return fit(got["text"].to_pylist(), got["y"].to_numpy().astype(np.float64))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, score and predicted.

    Null and empty texts get the score of the empty text; texts of any length are scored whole. Rows that repeat a doc_id
    are scored each by its own text, and one of their texts is learnt from. A null doc_id isn't held out or learnt from; a
    doc_id labelled both ways isn't learnt from. With labels of one kind or none all scores are the same. An empty table
    gives no rows.
    """
    return _scoring.digest(docs, train(docs, labels).score, THRESHOLD)
