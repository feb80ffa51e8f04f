"""Delta-maintained token totals.

Counts of documents enter and leave a ledger as signed rows; a batch of them is summed by source, language and tokenizer
version and written under the batch's id. Totals are additive over batches, so nothing is counted again when documents
are inserted, deleted or revised. A batch's sums are written to a folder of their own; a marker file under the batch's id,
created only if there is none, then names that folder. If there is a marker already (a replay, or another driver that was
faster), the new folder is dropped and the totals stay as they were. Snapshots hold the sums of many batches, so that
totals don't read every batch that was ever made.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import bpe
from gaugeframe.llm._shared import batched, cut, met, only, shared_dir

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_bytes")
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_bytes bigint"
VERSION = "byte_bpe_50k/1"


def counted(docs: DataFrame, tokenizer: str = VERSION, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens, n_bytes, text_hash) of whole texts; a null text has no token or byte."""
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, bpe.SLICE):
                rows = batch.slice(at, bpe.SLICE)
                n = np.array([len(x) // 4 for x in coder.encode(rows.column(3).to_pylist())], np.int64)
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(n), *rows.columns[4:]], ["doc_id", "source", "lang", "n_tokens", "n_bytes", "text_hash"])
        coder.rest()

    text = F.col("text").cast("string")
    size: Column = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = only(docs, "doc_id", "source", "lang", "text").select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.cast("binary").alias("text"), size.alias("n_bytes"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_hash"))
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, lang string, n_tokens bigint, n_bytes bigint, text_hash string"
    return rows.transform(batched, run, out).withColumn("tokenizer", F.lit(tokenizer))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), "n_tokens", "n_bytes")


def deletes(counts: DataFrame) -> DataFrame:
    return inserts(counts).select(*KEYS, *[(-F.col(c)).alias(c) for c in SUMS])


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents whose counts, source, language or tokenizer version changed: the old rows leave, the new ones enter."""
    return deletes(old).unionByName(inserts(new))


class Ledger:
    """Committed batches of signed counts in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in ("data", "batches", "snapshots"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    def _claim(self, path: str, text: str) -> bool:
        """Creates a file with this text; False if there is one. Only one of several callers at once gets True."""
        to, content = self._path(path), text.encode()
        if self._fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then, which isn't atomic
            local, beside = to.toUri().getPath(), f"{to.toUri().getPath()}.{uuid.uuid4().hex}"
            with open(beside, "wb") as f:
                f.write(content)
            try:
                os.link(beside, local)
            except FileExistsError:
                return False
            finally:
                os.unlink(beside)
            return True
        try:
            out = self._fs.create(to, False)
        except Exception as e:  # noqa: BLE001 - the gateway has one class for all of Java's
            if self._fs.exists(to):
                return False
            raise e
        out.write(bytearray(content))
        out.close()
        return True

    def _text(self, path: str) -> str:
        with_bytes = self._fs.open(self._path(path))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(with_bytes)).decode()
        finally:
            with_bytes.close()

    def _listed(self, folder: str) -> list[str]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/{folder}"))]
        return sorted(n for n in names if "." not in n)

    @staticmethod
    def _name(batch: str) -> str:
        """A batch's marker file: its id in hexadecimal, so that any id is a file name."""
        return batch.encode().hex() or "-"

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/batches/{self._name(batch)}"))

    def batches(self) -> list[str]:
        return sorted("" if n == "-" else bytes.fromhex(n).decode() for n in self._listed("batches"))

    def _written(self, sums: DataFrame) -> str:
        name = uuid.uuid4().hex
        sums.coalesce(1).write.parquet(f"{self.root}/data/{name}")
        return name

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds the batch's summed deltas; False, and no effect, if the id was committed before."""
        if self.committed(batch):
            return False
        name = self._written(changes.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS]))
        done = self._claim(f"{self.root}/batches/{self._name(batch)}", name)
        if not done:
            self._fs.delete(self._path(f"{self.root}/data/{name}"), True)
        return done

    def _state(self) -> tuple[list[str], list[str], set[str]]:
        """(folders whose sums make the totals, batches they cover, batches of the snapshot among them)."""
        marks = {n: self._text(f"{self.root}/batches/{n}") for n in self._listed("batches")}
        known = [json.loads(self._text(f"{self.root}/snapshots/{n}")) for n in self._listed("snapshots")]
        best = max(known, key=lambda x: len(x["batches"]), default={"data": None, "batches": []})
        rest = [folder for n, folder in marks.items() if n not in set(best["batches"])]
        return [*([best["data"]] if best["data"] else []), *rest], sorted(marks), set(best["batches"])

    def _sums(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.root}/data/{f}" for f in folders]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])

    def compact(self) -> None:
        """Writes a snapshot of all batches committed so far. Batches stay as they are, so that replays are known."""
        folders, batches, before = self._state()
        if len(batches) > len(before):
            text = json.dumps({"data": self._written(self._sums(folders)), "batches": batches})
            self._claim(f"{self.root}/snapshots/{hashlib.sha256(text.encode()).hexdigest()}", text)

    def totals(self) -> DataFrame:
        """Sums over all committed batches; a key whose documents have all left has no row."""
        return self._sums(self._state()[0]).where("n_docs <> 0 or n_tokens <> 0 or n_bytes <> 0")


def copies(counts: DataFrame) -> DataFrame:
    """counts (a written table) with `copy`: true for all rows of a text but one, that of the smallest doc_id (null last).

    Of rows that repeat this doc_id with the same source and language one stays, and `extra` says how many more there are:
    each stands for 1 + extra rows.
    """
    each = cut(counts.groupBy("doc_id", *KEYS, "n_tokens", "n_bytes", "text_hash").agg((F.count("*") - 1).alias("extra")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("ns"), F.coalesce("lang", F.lit("")).alias("l"), F.col("lang").isNull().alias("nl"))
    stay = cut(each.groupBy("text_hash").agg(F.min(place).alias("stay"), F.count("*").alias("times")))
    marked = met(each, stay, ["text_hash"], each.count())
    return marked.select(*each.columns, (~place.eqNullSafe(F.col("stay"))).alias("copy"))


def maintained(docs: DataFrame) -> DataFrame:
    """The totals after a corpus's usual history, every batch committed twice to no further effect.

    All rows are inserted; exact copies (all but one row of each text, that with the smallest doc_id, a null one last) are
    deleted, rows that repeat a doc_id included; then the counts of what is left are revised to a tokenizer version that
    ends each document with one more token. Null and empty texts are copies of each other without tokens; texts of any
    length count whole. Null sources and languages are keys of their own, other columns play no part, and an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    ledger = Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    counts = cut(counted(docs))
    marked = cut(copies(counts))
    leave = marked.select(*KEYS, (F.col("copy").cast("long") + F.col("extra")).alias("n"), "n_tokens", "n_bytes").where("n > 0")
    leave = leave.select(*KEYS, (-F.col("n")).alias("n_docs"), *[(-F.col("n") * F.col(c)).alias(c) for c in SUMS[1:]])
    left = marked.where("not copy")
    closed = left.withColumn("n_tokens", F.col("n_tokens") + 1).withColumn("tokenizer", F.lit("byte_bpe_50k/2"))
    for _ in range(2):
        ledger.commit("0-insert", inserts(counts))
        ledger.commit("1-delete-copies", leave)
        ledger.compact()
        ledger.commit("2-close-documents", revisions(left, closed))
    return ledger.totals()
