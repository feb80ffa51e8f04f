"""The frames behind the charts: projections and pivots of column profiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_FIELDS = ("mean", "median", "std_dev", "variance", "skewness", "kurtosis", "p5", "p25", "p75", "p95", "iqr", "coefficient_of_variation", "outlier_count")


def _share(c: str) -> Column:
    return F.when(F.col("row_count") > 0, F.round(F.col(c) / F.col("row_count"), 4)).otherwise(0.0)


def null_distribution(p: DataFrame) -> DataFrame:
    return p.select("table_name", "name", "null_count", _share("null_count").alias("null_ratio"))


def completeness(p: DataFrame) -> DataFrame:
    return p.select("table_name", "name", F.round(1 - F.when(F.col("row_count") > 0, F.col("null_count") / F.col("row_count")).otherwise(0.0), 4).alias("completeness"))


def type_distribution(p: DataFrame) -> DataFrame:
    return p.groupBy("table_name", "inferred_type").agg(F.count("*").cast("long").alias("columns"))


def cardinality(p: DataFrame) -> DataFrame:
    return p.select("table_name", "name", "distinct_count", "unique_ratio", "cardinality")


def numeric_summary(p: DataFrame) -> DataFrame:
    return p.where(F.col("mean").isNotNull()).select("table_name", "name", *NUMERIC_FIELDS)


def skewness(p: DataFrame) -> DataFrame:
    return p.where(F.col("skewness").isNotNull()).select("table_name", "name", "skewness")


def outlier_summary(p: DataFrame) -> DataFrame:
    return p.where(F.col("outlier_count").isNotNull()).select("table_name", "name", "outlier_count", _share("outlier_count").alias("outlier_ratio"))


def top_values(p: DataFrame) -> DataFrame:
    return p.select("table_name", "name", F.posexplode("top_values").alias("rank", "t")).select("table_name", "name", "rank", "t.value", "t.count")


def string_lengths(p: DataFrame) -> DataFrame:
    return p.where(F.col("length_max").isNotNull()).select("table_name", "name", "avg_length", "length_p10", "length_p50", "length_p90", "length_max")


def overview(p: DataFrame) -> DataFrame:
    return p.groupBy("table_name").agg(F.max("row_count").alias("row_count"), F.count("*").cast("long").alias("columns"), F.sum("null_count").alias("nulls"), F.count_if("is_key_candidate").cast("long").alias("key_candidates"), F.count_if(F.size("quality_flags") > 0).cast("long").alias("columns_with_issues"))


def row_counts(p: DataFrame) -> DataFrame:
    return p.groupBy("table_name").agg(F.max("row_count").alias("row_count"))


def quality_heatmap(p: DataFrame) -> DataFrame:
    return p.select("table_name", F.explode("quality_flags").alias("flag")).groupBy("table_name").pivot("flag").count().fillna(0)


def quality_scorecard(p: DataFrame) -> DataFrame:
    """Six scores of a table from 0 to 1, by definitions of this engine.

    Completeness: cells that aren't null. Uniqueness: the best key's unique ratio. Validity: mean type confidence.
    Consistency: columns without mixed formats or conflicts. Conformity: columns without any flag. Variety: columns that
    aren't constant.
    """
    mixed = F.arrays_overlap("quality_flags", F.array(F.lit("MIXED_DATE_FORMATS"), F.lit("MIXED_TIMEZONES"), F.lit("TYPE_CONFLICT")))
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 4)
    cells = F.sum("row_count")
    return p.groupBy("table_name").agg(
        F.round(F.when(cells > 0, 1 - F.sum("null_count") / cells).otherwise(1.0), 4).alias("completeness"),
        F.max("unique_ratio").alias("uniqueness"), F.round(F.avg("confidence_score"), 4).alias("validity"),
        share(~mixed).alias("consistency"), share(F.size("quality_flags") == 0).alias("conformity"), share(~F.col("is_constant")).alias("variety"),
    )


def relationship_confidence(found: DataFrame) -> DataFrame:
    label = lambda p: F.concat_ws(".", f"{p}_table", f"{p}_column")
    return found.select(F.concat(label("fk"), F.lit(" -> "), label("pk")).alias("relationship"), "confidence")


def column_detail(p: DataFrame, name: str) -> DataFrame:
    return p.where(F.col("name") == name)


def distribution(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, count) of equal-width bins between a numeric column's extremes."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    ends = x.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("a")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    y = x.join(F.broadcast(ends), F.lit(True)).groupBy(at.alias("bin"), "a", "b").agg(F.count("*").cast("long").alias("count"))
    return y.select("bin", F.round(F.col("a") + F.col("bin") * width, 6).alias("low"), F.round(F.col("a") + (F.col("bin") + 1) * width, 6).alias("high"), "count")


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_a, column_b, correlation) of all pairs of numeric columns, in one aggregate."""
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    pairs = list(combinations(names, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double")
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.round(f"c{i}", 4).alias("correlation")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


FRAMES = {f.__name__: f for f in (overview, quality_scorecard, null_distribution, type_distribution, cardinality, completeness, numeric_summary, skewness, outlier_summary, top_values, string_lengths, row_counts, quality_heatmap)}
