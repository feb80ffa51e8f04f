"""Structural quality flags of columns and their summary per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flagged(profiles: DataFrame) -> DataFrame:
    """column_profiles with `quality_flags`, each flag once.

    Needs table_name, original_name, distinct_count, null_count, is_constant, is_sparse; takes type_flags,
    nulls_normalized and type_conflict into account where they are.
    """
    has = lambda c: c in profiles.columns
    same = F.count("*").over(Window.partitionBy("table_name", "original_name"))
    checks = [
        F.when(same > 1, F.lit("DUPLICATE_COLUMN_NAME")),
        F.when((F.col("distinct_count") == 0) & (F.col("null_count") > 0), F.lit("FULLY_NULL")),
        F.when(F.col("is_constant"), F.lit("CONSTANT_COLUMN")),
        F.when(F.col("is_sparse"), F.lit("HIGH_NULL_RATIO")),
        F.when(F.col("nulls_normalized") > 0, F.lit("NULL_VARIANT_NORMALIZED")) if has("nulls_normalized") else F.lit(None).cast("string"),
        F.when(F.col("type_conflict"), F.lit("TYPE_CONFLICT")) if has("type_conflict") else F.lit(None).cast("string"),
    ]
    own = F.col("type_flags") if has("type_flags") else F.array().cast("array<string>")
    return profiles.withColumn("quality_flags", F.array_distinct(F.concat(own, F.array_compact(F.array(*checks)))))


def summary(profiles: DataFrame, corrupt: DataFrame | None = None) -> DataFrame:
    """Per table: columns, columns with a flag, null-heavy and type-conflict columns, corrupt rows."""
    flag = lambda *f: F.count_if(F.arrays_overlap("quality_flags", F.array(*[F.lit(x) for x in f]))).cast("long")
    out = profiles.groupBy("table_name").agg(
        F.count("*").cast("long").alias("columns_profiled"),
        F.count_if(F.size("quality_flags") > 0).cast("long").alias("columns_with_issues"),
        flag("HIGH_NULL_RATIO", "FULLY_NULL").alias("null_heavy_columns"),
        flag("TYPE_CONFLICT").alias("type_conflict_columns"),
    )
    if corrupt is None:
        return out.withColumn("corrupt_rows_detected", F.lit(0).cast("long"))
    return out.join(corrupt, "table_name", "left").withColumn("corrupt_rows_detected", F.coalesce("corrupt_rows_detected", F.lit(0)).cast("long"))


def low_cardinality_columns(profiles: DataFrame) -> DataFrame:
    return profiles.where("is_low_cardinality").select("table_name", "column", "distinct_count", "inferred_type")


def structural_issues(corrupt_rows: int, encoding: str) -> list[str]:
    """File-level findings: rows with shifted columns, and an encoding that was only a guess."""
    out = [f"COLUMN_SHIFT_ERROR: {corrupt_rows} rows with another number of fields"] if corrupt_rows else []
    return out + (["ENCODING_INCONSISTENCY: read as latin-1"] if encoding == "latin-1" else [])
