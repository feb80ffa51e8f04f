"""Row samples and row counts; the engine's statistics don't need them, its users may."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.settings import DEFAULT


def hash_sample(df: DataFrame, key: str, k: int = DEFAULT.sample_rows, seed: int = 42) -> DataFrame:
    """k rows drawn by the md5 of seed and key: uniform, and the same on every run (a top-k, no shuffle of the table)."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(k)


def skip_sample(df: DataFrame, key: str, every: int = DEFAULT.skip_interval) -> DataFrame:
    """Each `every`-th row in the order of a key.

    Rows are ranked without a global window: a range partitioning sorts them, and partition sizes give the offsets.
    """
    from pyspark.sql import types as T

    ordered = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("__part", F.spark_partition_id())
    ordered = ordered.persist()
    sizes = sorted((r["__part"], r["count"]) for r in ordered.groupBy("__part").count().collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, T.StructType([T.StructField("__part", T.IntegerType()), T.StructField("__before", T.LongType())]))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1 + F.col("__before")
    x = ordered.join(F.broadcast(offsets), "__part").withColumn("__at", place)
    return x.where(F.col("__at") % every == 0).select(*df.columns)


def estimated_rows(lines: DataFrame, size_bytes: int, probe: int = 1000) -> DataFrame:
    """Rows of a text file from the mean length of its first lines (column `value`, including line ends)."""
    some = lines.limit(probe)
    return some.select((F.lit(size_bytes) / F.avg(F.octet_length("value") + 1)).cast("long").alias("estimated_rows"))


def chunks(names: DataFrame, column: str, size: int = DEFAULT.cluster_tables) -> DataFrame:
    """Names in alphabetical order dealt into chunks of a fixed size."""
    at = F.row_number().over(Window.orderBy(column)) - 1
    return names.withColumn("chunk", F.floor(at / size).cast("long"))


def sample_rows(df: DataFrame, key: str, n: int = DEFAULT.sample_values) -> DataFrame:
    """The first n rows by a key as JSON."""
    return df.orderBy(key).limit(n).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
