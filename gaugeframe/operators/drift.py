"""Fingerprints of tables and what changed between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def table_fingerprints(tables: DataFrame) -> DataFrame:
    """(table_name, row_count, column_count) with a fingerprint of the three."""
    return tables.withColumn("fingerprint", fingerprint(F.col("table_name"), F.col("row_count").cast("string"), F.col("column_count").cast("string")))


def file_fingerprints(files: DataFrame) -> DataFrame:
    """binaryFile rows: a short hash of path, size and time of change."""
    return files.select("path", F.substring(F.md5(F.concat_ws(":", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))), 1, 12).alias("fingerprint"))


def table_drift(now: DataFrame, before: DataFrame) -> DataFrame:
    """(table_name, status): new, removed, changed or unchanged, by fingerprint."""
    a, b = now.select("table_name", F.col("fingerprint").alias("a")), before.select("table_name", F.col("fingerprint").alias("b"))
    status = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return a.join(b, "table_name", "full_outer").select("table_name", status.alias("status"))


def column_drift(now: DataFrame, before: DataFrame) -> DataFrame:
    """(table_name, name, status, was, is) by inferred type and nullability, for columns that differ."""
    form = lambda df, c: df.select("table_name", "name", F.concat_ws("/", "inferred_type", F.when(F.col("is_nullable"), "null").otherwise("not null")).alias(c))
    x = form(now, "is").join(form(before, "was"), ["table_name", "name"], "full_outer")
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return x.withColumn("status", status).where("status is not null").select("table_name", "name", "status", "was", "is")


def unseen(now: DataFrame, done: DataFrame) -> DataFrame:
    """Tables whose fingerprint isn't among those handled before."""
    return now.join(done.select("table_name", "fingerprint"), ["table_name", "fingerprint"], "left_anti")
