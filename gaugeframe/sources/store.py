"""Where profiles, relationships, documents and diagrams go."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file, complete or absent: written beside its place and renamed into it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = to.getFileSystem(conf)
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(to):
        fs.delete(to, False)
    if not fs.rename(beside, to):
        raise OSError(f"can't rename to {path}")


def as_json(df: DataFrame) -> DataFrame:
    """(value): each row as JSON with nulls spelled out."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_profile_json(table_profile: DataFrame, path: str) -> None:
    """A table's profile as one JSON file; a profile has as many entries as its table has columns."""
    row = as_json(table_profile).first()
    write_text(table_profile.sparkSession, json.dumps(json.loads(row["value"]), indent=2, ensure_ascii=False) + "\n", path)


def write_relationships_json(found: DataFrame, tables: int, columns: int, path: str) -> None:
    edges = [json.loads(r["value"]) for r in as_json(found.orderBy(F.desc("confidence"), "fk_table", "fk_column", "pk_table", "pk_column")).collect()]
    write_text(found.sparkSession, json.dumps({"tables_analyzed": tables, "columns_analyzed": columns, "candidates": edges}, indent=2) + "\n", path)


class ProfileStore:
    """column_profiles as a Parquet table partitioned by table_name; a table that comes again replaces its partition."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, profiles: DataFrame) -> None:
        profiles.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("table_name").parquet(self.path)

    def get(self, table_name: str | None = None) -> DataFrame:
        all_ = self.spark.read.parquet(self.path)
        return all_ if table_name is None else all_.where(F.col("table_name") == table_name)


class DocumentStore(ProfileStore):
    """Documents (doc_type, table_name, column_name, content, embedding), replaced table by table."""

    def reset(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def enriched_profiles(table_profiles: DataFrame, index: DataFrame) -> DataFrame:
    """Table profiles with their references in both directions nested."""
    nested = index.groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct("direction", "column", "other_table", "other_column", "confidence"))).alias("relationships"))
    return table_profiles.join(nested, "table_name", "left")
