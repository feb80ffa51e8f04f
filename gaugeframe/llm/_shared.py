"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch at most; with long texts, Spark's own 10,000 take too much of a Python worker's memory.
BATCH_ROWS = 1024


def batched(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with batches of a bounded number of rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where a local session leaves it unset, one below its warehouse.

    On a cluster no folder of our own would be seen by all, so a session there has to name one.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    found = found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


#: Where this is set when a frame is made, Spark removes the shuffle files of its execution at the end, not when the driver collects its garbage.
REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """For frames that are made and executed once within it: their shuffle files go with the execution."""
    before = spark.conf.get(REMOVE_SHUFFLES, "false")
    spark.conf.set(REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(REMOVE_SHUFFLES, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read on from there: ends its lineage, survives lost executors.

    What was shuffled for it goes from the executors' disks as soon as it is written.
    """
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def dropped(*cuts: DataFrame) -> None:
    """Deletes what `cut` wrote for these frames; nothing that is yet to run may read them."""
    for df in cuts:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; the held-out rows are those with 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, found by position: other names that repeat them in another case don't clash."""
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, and whole rows as a struct `row` with fields by position: no column name can clash."""
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(F.struct(*plain.columns).alias("row"), *[F.col(f"c{i}").alias(n) for i, n in zip(at, names, strict=True)])


def unpacked(rows: DataFrame, df: DataFrame, **changed: Column) -> DataFrame:
    """Rows that `packed` made, as columns named like df's; the changed ones have new values, cast to their type."""
    fields = [changed[n].cast(f.dataType) if n in changed else F.col("row")[f"c{i}"] for i, (n, f) in enumerate(zip(df.columns, df.schema, strict=True))]
    return rows.select(*[c.alias(f"c{i}") for i, c in enumerate(fields)]).toDF(*df.columns)


#: Keys with more than one in so many of all rows are broadcast when rows meet them; so there are fewer than that.
HEAVY_KEYS = 20_000


def met(rows: DataFrame, found: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined with `found`, which has one row for each key and the number of its rows as `times`; both are written tables.

    Of `total` rows, fewer than HEAVY_KEYS keys can have more than one in HEAVY_KEYS each: these few are broadcast, so that
    no task gets all rows of a frequent key; the other keys meet by a shuffle.
    """
    heavy = F.col("times") * HEAVY_KEYS > total
    few = F.broadcast(found.where(heavy))
    near = rows.join(few, on)
    return near.unionByName(rows.join(few.select(*on), on, "left_anti").join(found.where(~heavy), on))
