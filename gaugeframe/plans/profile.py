"""One table to its column profiles, and column profiles to the table's profile."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.functions.text import flattened, standard_names
from gaugeframe.operators import quality, statistics
from gaugeframe.operators.columns import KEY, raw_counts, report, standardised
from gaugeframe.settings import DEFAULT, Settings

#: The fixed schema of column_profiles; what can't be computed is null, never left out.
_KINDS = {
    T.StringType(): "table_name name original_name declared_type inferred_type cardinality min max semantic_type description",
    T.IntegerType(): "ordinal length_max",
    T.LongType(): "null_count distinct_count outlier_count row_count nulls_normalized",
    T.BooleanType(): "is_distinct_count_exact is_nullable is_constant is_sparse is_key_candidate is_low_cardinality",
    T.ArrayType(T.StringType()): "sample_values format_variants type_flags",
    T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("count", T.LongType())])): "top_values",
}
_ORDER = (
    "table_name ordinal name original_name declared_type inferred_type confidence_score null_count distinct_count is_distinct_count_exact unique_ratio "
    "cardinality is_nullable is_constant is_sparse is_key_candidate is_low_cardinality min max skewness mean median std_dev variance kurtosis p5 p25 p75 "
    "p95 iqr coefficient_of_variation outlier_count avg_length length_p10 length_p50 length_p90 length_max semantic_type description top_values "
    "sample_values row_count format_variants type_flags nulls_normalized"
).split()
_KIND_OF = {c: k for k, names in _KINDS.items() for c in names.split()}
STRUCT = T.StructType([T.StructField(c, _KIND_OF.get(c, T.DoubleType())) for c in _ORDER])
FIELDS = [*[c for c in STRUCT.fieldNames() if c not in ("row_count", "format_variants", "type_flags", "nulls_normalized")], "quality_flags", "row_count", "format_variants"]
#: What a column without any row has.
EMPTY = {
    **dict.fromkeys(STRUCT.fieldNames()), "row_count": 0, "null_count": 0, "distinct_count": 0, "unique_ratio": 0.0, "cardinality": "LOW",
    "inferred_type": "NULL_ONLY", "confidence_score": 1.0, "is_nullable": False, "is_constant": False, "is_sparse": False, "is_key_candidate": False,
    "is_low_cardinality": True, "is_distinct_count_exact": True, "top_values": [], "sample_values": [], "format_variants": [], "type_flags": [], "nulls_normalized": 0,
}


def column_profiles(df: DataFrame, table_name: str, s: Settings = DEFAULT, standardise: bool = True) -> DataFrame:
    """A row for each column of df with the fields above, over all rows.

    Values are counted once; the counts are kept, and types, distinct counts, ranges, percentiles, lengths and top values
    come from them by jobs that run side by side. Each job's result has a few rows for each column of the table, whatever
    the table's size, so the results are put together on the driver and returned as a local frame. All figures are exact
    at every size.
    """
    df = flattened(df)
    spark, declared = df.sparkSession, [f.dataType.simpleString() for f in df.schema]
    raw = raw_counts(df).persist()
    blank = F.trim("value") == ""
    new = standardised(raw, s).withColumnRenamed("new", "to") if standardise else raw.withColumn("to", F.when(~blank, F.col("value")))
    vc = new.groupBy(*KEY, F.col("to").alias("value")).agg(F.sum("cnt").alias("cnt")).persist()
    local = lambda x: spark.createDataFrame(x.collect(), x.schema)
    types = local(statistics.inferred(vc, s))
    basic = statistics.basics(vc, s).join(types, list(KEY), "left").withColumn("is_key_candidate", statistics.key_candidate(s)).collect()
    held = max([r["row_count"] for r in basic], default=0) <= s.exact_distinct_rows

    def quartiles() -> list:
        q = local(statistics.percentiles(vc, types, held))
        return q.join(statistics.outliers(vc, q), list(KEY), "left").collect()

    packed = lambda x, *c: x.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("rank", *c))).alias("x"))
    listed = lambda c: F.transform(c, lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count"))).alias("top_values")

    jobs = [
        quartiles,
        lambda: statistics.ranges(vc, types).collect(),
        lambda: statistics.text_moments(vc, types).collect(),
        lambda: statistics.lengths(vc, types).collect(),
        lambda: packed(statistics.top_values(vc, s), "value", "count").select(*KEY, listed("x")).collect(),
        lambda: packed(statistics.sample_values(vc, s), "value").select(*KEY, F.transform("x", lambda t: t["value"]).alias("sample_values")).collect(),
        *([lambda: report(raw, s).select(*KEY, "nulls_normalized").collect()] if standardise else []),
    ]
    found: dict[int, dict] = {i: dict(EMPTY) for i in range(len(df.columns))}
    with ThreadPoolExecutor(4) as pool:
        for rows in [basic, *pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs)]:
            for r in rows:
                found[r["ordinal"]].update(r.asDict(recursive=True))
    vc.unpersist()
    raw.unpersist()
    for i, (n, o, d) in enumerate(zip(standard_names(df.columns), df.columns, declared, strict=True)):
        found[i] |= {"table_name": table_name, "ordinal": i, "name": n, "original_name": o, "declared_type": d}
    out = quality.flagged(spark.createDataFrame([tuple(x[c] for c in STRUCT.fieldNames()) for x in found.values()], STRUCT))
    return out.select(*FIELDS)


def table_profile(profiles: DataFrame, source_type: str = "file", file_format: str = "parquet", path: str = "", size_bytes: int | None = None, encoding: str = "utf-8", strategy: str = "MEMORY_SAFE", corrupt: int = 0) -> DataFrame:
    """One row for each table: its columns nested, row count and quality summary."""
    columns = F.sort_array(F.collect_list(F.struct("ordinal", *[c for c in profiles.columns if c not in ("ordinal", "table_name", "row_count")]))).alias("columns")
    rows = profiles.groupBy("table_name").agg(F.max("row_count").alias("row_count"), columns)
    summary = quality.summary(profiles).withColumn("corrupt_rows_detected", F.lit(corrupt).cast("long"))
    fields = [c for c in summary.columns if c != "table_name"]
    nested = summary.select("table_name", F.struct(*fields).alias("quality_summary"))
    issues = F.array(*[F.lit(x) for x in quality.structural_issues(corrupt, encoding)]).cast("array<string>")
    fixed = {"source_type": F.lit(source_type), "file_format": F.lit(file_format), "file_path": F.lit(path), "is_row_count_exact": F.lit(True), "encoding": F.lit(encoding), "size_bytes": F.lit(size_bytes).cast("long"), "size_strategy": F.lit(strategy), "corrupt_row_count": F.lit(corrupt).cast("long"), "structural_issues": issues, "standardization_applied": F.lit(True)}
    return rows.join(nested, "table_name").withColumns(fixed)


def light_profiles(vc: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """What relationships need of many tables at once, from value counts whose columns are named `table.column`.

    One row for each column of all tables, computed at once and returned as a local frame.
    """
    vc = vc.persist()
    top = statistics.top_values(vc, s).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("rank", "value", "count"))).alias("x"))
    top = top.select(*KEY, F.transform("x", lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count"))).alias("top_values"))
    x = statistics.basics(vc, s).join(statistics.inferred(vc, s), list(KEY)).join(top, list(KEY), "left")
    x = x.withColumn("is_key_candidate", statistics.key_candidate(s)).withColumn("top_values", F.coalesce("top_values", F.array().cast("array<struct<value:string,count:bigint>>")))
    table = F.substring_index("column", ".", 1)
    x = x.withColumn("table_name", table).withColumn("name", F.substr("column", F.char_length(table) + 2)).withColumn("original_name", F.col("name"))
    x = quality.flagged(x).select("table_name", "ordinal", "name", "column", "inferred_type", "confidence_score", "row_count", "null_count", "distinct_count", "unique_ratio", "cardinality", "is_constant", "is_low_cardinality", "is_key_candidate", "top_values", "quality_flags")
    rows = x.collect()
    vc.unpersist()
    return vc.sparkSession.createDataFrame(rows, x.schema)
