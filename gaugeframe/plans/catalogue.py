"""Registered queries of the profiling operators and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.functions import semantic, text
from gaugeframe.operators import charts, clusters, columns, diagram, drift, quality, relationships, sampling, statistics, vectors
from gaugeframe.plans import enrich, profile
from gaugeframe.settings import AUDIT_COLUMNS, FALSE_TOKENS, NULL_TOKENS, TRUE_TOKENS, TYPE_LABELS
from gaugeframe.sources import delimited, records

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Columns of the tables that are profiled through their text; the kind says how SQL renders them.
TABLES = {
    "region": {"r_regionkey": "t", "r_name": "t"},
    "nation": {"n_nationkey": "t", "n_name": "t", "n_regionkey": "t"},
    "customer": {"c_custkey": "t", "c_name": "t", "c_nationkey": "t", "c_acctbal": "t", "c_mktsegment": "t"},
    "supplier": {"s_suppkey": "t", "s_name": "t", "s_nationkey": "t", "s_acctbal": "t"},
    "part": {"p_partkey": "t", "p_name": "t", "p_brand": "t", "p_type": "t", "p_size": "t", "p_retailprice": "t"},
    "orders": {"o_orderkey": "t", "o_custkey": "t", "o_orderstatus": "t", "o_totalprice": "t", "o_orderdate": "ts", "o_orderpriority": "t"},
    "lineitem": {"l_orderkey": "t", "l_partkey": "t", "l_suppkey": "t", "l_linenumber": "t", "l_quantity": "t", "l_extendedprice": "t", "l_discount": "t", "l_tax": "t", "l_returnflag": "t", "l_linestatus": "t", "l_shipdate": "ts"},
    "labels": {"doc_id": "t", "quality": "t", "toxic": "t"},
}
ALL = tuple(TABLES)
RELATED = ALL[:-1]
EVERY = (*ALL, "events", "documents", "embeddings", "pages", "benchmark", "conversations")


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _literal(v: object) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).upper() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"


def _sql_values(rows: list[tuple], names: str, alias: str = "x") -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS {alias}({names})"


def _in(tokens: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(_literal, tokens)) + ")"


# Value counts of several tables in one frame ------------------------------------------------------------------------


def _counts(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = ALL, wanted: dict[str, list[str]] | None = None) -> DataFrame:
    """Standardised value counts of several tables (of the wanted columns of each, if given); columns are named table.column."""
    frames = []
    for k, t in enumerate(tables):
        x = columns.raw_counts(_read(spark, sf_dir, t).select(*(wanted[t] if wanted else TABLES[t])))
        frames.append(x.select((F.col("ordinal") + 100 * k).alias("ordinal"), F.concat_ws(".", F.lit(t), "column").alias("column"), "value", "cnt"))
    return columns.value_counts(reduce(DataFrame.union, frames))


_ISO = "strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({c}) % 1000000 = 0 THEN '' ELSE strftime({c}, '.%f') END"


def _vc(tables: tuple[str, ...] = ALL) -> str:
    """CTEs up to vc(col, v, cnt): standardised value counts."""
    cells = [f"SELECT '{t}.{c}' AS col, {_ISO.format(c=c) if k == 'ts' else f'CAST({c} AS VARCHAR)'} AS v FROM {t}" for t in tables for c, k in TABLES[t].items()]
    return (
        "WITH lng AS (" + " UNION ALL ".join(cells) + "), raw AS (SELECT col, v, count(*) AS cnt FROM lng GROUP BY col, v), "
        f"b AS (SELECT col, sum(CASE WHEN trim(v) <> '' THEN cnt END) AS f, sum(CASE WHEN lower(trim(v)) IN {_in(TRUE_TOKENS + FALSE_TOKENS)} THEN cnt ELSE 0 END) AS h FROM raw GROUP BY col), "
        f"kn AS (SELECT raw.col, CASE WHEN trim(v) = '' OR lower(trim(v)) IN {_in(NULL_TOKENS)} THEN NULL ELSE trim(v) END AS k, cnt, h >= 0.9 * f AS mostly FROM raw JOIN b USING (col)), "
        f"st AS (SELECT col, CASE WHEN mostly AND lower(k) IN {_in(TRUE_TOKENS)} THEN 'true' WHEN mostly AND lower(k) IN {_in(FALSE_TOKENS)} THEN 'false' ELSE k END AS v, cnt FROM kn), "
        "vc AS (SELECT col, v, CAST(sum(cnt) AS BIGINT) AS cnt FROM st GROUP BY col, v)"
    )


def _plain(c: str = "v") -> str:
    return f"replace({c}, ',', '')"


_INT = "regexp_full_match({p}, '-?(0|[1-9][0-9]*)')"
_FLT = "regexp_full_match({p}, '-?(([0-9]+\\.[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+)')"
_UUID = "regexp_full_match({v}, '[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}')"
_DATE = (
    "CASE WHEN NOT regexp_full_match({v}, '[0-9]{{4}}[-/]?[0-9]{{2}}[-/]?[0-9]{{2}}|[0-9]{{2}}[-/][0-9]{{2}}[-/][0-9]{{4}}') THEN NULL "
    + " ".join(f"WHEN regexp_full_match({{v}}, '{shape}') AND try_strptime({{v}}, '{form}') IS NOT NULL THEN '{label}'" for shape, form, label in (
        ("[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}", "%Y-%m-%d", "YYYY-MM-DD"), ("[0-9]{{8}}", "%Y%m%d", "YYYYMMDD"), ("[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}", "%d/%m/%Y", "DD/MM/YYYY"),
        ("[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}", "%m/%d/%Y", "MM/DD/YYYY"), ("[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}", "%d-%m-%Y", "DD-MM-YYYY"), ("[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}", "%m-%d-%Y", "MM-DD-YYYY")))
    + " END"
)
_STAMP = (
    "CASE WHEN regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{1,2}}(\\.[0-9]{{1,6}})?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?') AND try_strptime(regexp_extract({v}, '^([^T]*T[0-9]+:[0-9]+:[0-9]+)', 1), '%Y-%m-%dT%H:%M:%S') IS NOT NULL "
    "THEN CASE WHEN regexp_matches({v}, '(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') AND regexp_matches({v}, 'T[^+-]*(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') THEN 'aware' ELSE 'naive' END "
    "WHEN regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{1,2}}(\\.[0-9]{{1,6}})?') AND try_strptime(regexp_extract({v}, '^([^.]*)', 1), '%Y-%m-%d %H:%M:%S') IS NOT NULL THEN 'naive' "
    "WHEN regexp_full_match({v}, '[0-9]{{2}}([-/])[0-9]{{2}}[-/][0-9]{{4}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{1,2}}(\\.[0-9]{{1,6}})?') AND substr({v}, 3, 1) = substr({v}, 6, 1) "
    "AND coalesce(try_strptime(replace(regexp_extract({v}, '^([^.]*)', 1), '/', '-'), '%d-%m-%Y %H:%M:%S'), try_strptime(replace(regexp_extract({v}, '^([^.]*)', 1), '/', '-'), '%m-%d-%Y %H:%M:%S')) IS NOT NULL THEN 'naive' END"
)
_TYPES = (
    ", cls AS (SELECT *, " + f"lower(v) IN {_in(TRUE_TOKENS + FALSE_TOKENS)} AS b, " + _DATE.format(v="v") + " AS dl, " + _STAMP.format(v="v") + " AS tk, " + _INT.format(p=_plain()) + " AS i, " + _FLT.format(p=_plain()) + " AS f, " + _UUID.format(v="v") + " AS u FROM vc), "
    "rt AS (SELECT col, sum(cnt) AS n, count(v) AS d, sum(CASE WHEN v IS NULL THEN cnt ELSE 0 END) AS nulls, "
    + ", ".join(f"sum(CASE WHEN {t} THEN cnt ELSE 0 END) / sum(CASE WHEN v IS NOT NULL THEN cnt END) AS r{k}" for k, t in (("b", "b"), ("d", "dl IS NOT NULL"), ("t", "tk IS NOT NULL"), ("i", "i"), ("f", "f"), ("u", "u")))
    + ", count(DISTINCT dl) AS labels, sum(length(v) * cnt) / sum(CASE WHEN v IS NOT NULL THEN cnt END) AS len FROM cls GROUP BY col), "
    "ty AS (SELECT *, CASE WHEN d = 0 THEN 'NULL_ONLY' WHEN rb >= 0.9 THEN 'BOOLEAN' WHEN rd >= 0.9 THEN CASE WHEN labels > 1 THEN 'MIXED_DATE' ELSE 'DATE' END WHEN rt >= 0.9 THEN 'TIMESTAMP' "
    "WHEN ri >= 0.9 THEN 'INTEGER' WHEN rf >= 0.9 THEN 'FLOAT' WHEN ru >= 0.9 THEN 'UUID' WHEN d < 50 THEN 'CATEGORICAL' WHEN len >= 100 THEN 'FREE_TEXT' ELSE 'STRING' END AS kind, "
    "CASE WHEN rb >= 0.9 THEN rb WHEN rd >= 0.9 THEN rd WHEN rt >= 0.9 THEN rt WHEN ri >= 0.9 THEN ri WHEN rf >= 0.9 THEN rf WHEN ru >= 0.9 THEN ru ELSE 1.0 END AS conf FROM rt), "
    "pr AS (SELECT *, d / n AS ratio, d / n >= 0.99 AND nulls = 0 AND kind NOT IN ('FREE_TEXT', 'BOOLEAN', 'NULL_ONLY', 'MIXED_DATE') AS is_key, CASE WHEN d / n > 0.9 THEN 'HIGH' WHEN d / n > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS card FROM ty)"
)


@_query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in EVERY))
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.union, [_read(spark, sf_dir, t).agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t in EVERY])


_NULLED = {"orders": list(TABLES["orders"]), "events": ["event_id", "ts", "user_id", "event_type", "value", "props"]}


@_query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM {t}" for t, cs in _NULLED.items() for c in cs))
def column_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(t: str, cs: list[str]) -> DataFrame:
        counts = _read(spark, sf_dir, t).agg(F.count("*").alias("row_count"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cs])
        return counts.select("row_count", F.inline(F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in cs]))).select("table_name", "column_name", "row_count", "null_count")

    return reduce(DataFrame.union, [one(t, cs) for t, cs in _NULLED.items()])


@_query(_vc() + " SELECT col AS column_name, CAST(sum(cnt) AS BIGINT) AS row_count, CAST(sum(CASE WHEN v IS NULL THEN cnt ELSE 0 END) AS BIGINT) AS null_count, count(v) AS distinct_count, count(v) / sum(cnt) AS unique_ratio, "
        "CASE WHEN count(v) / sum(cnt) > 0.9 THEN 'HIGH' WHEN count(v) / sum(cnt) > 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS cardinality, count(v) = 1 AS is_constant FROM vc GROUP BY col")  # fmt: skip
def column_basic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.basics(_counts(spark, sf_dir)).select(F.col("column").alias("column_name"), "row_count", "null_count", "distinct_count", F.col("ratio").alias("unique_ratio"), "cardinality", "is_constant")


@_query(_vc() + _TYPES + " SELECT col AS column_name, kind AS inferred_type, round(conf, 4) AS confidence_score FROM pr")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.inferred(_counts(spark, sf_dir)).select(F.col("column").alias("column_name"), "inferred_type", F.round("confidence_score", 4).alias("confidence_score"))


@_query(_vc() + _TYPES + " SELECT col AS column_name, is_key AS is_key_candidate FROM pr")
def key_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.light_profiles(_counts(spark, sf_dir)).select(F.col("column").alias("column_name"), "is_key_candidate")


@_query(_vc() + _TYPES + " SELECT split_part(col, '.', 1) AS table_name, card AS cardinality, count(*) AS columns FROM pr GROUP BY 1, 2")
def cardinality_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = statistics.basics(_counts(spark, sf_dir)).withColumn("table_name", F.substring_index("column", ".", 1))
    return x.groupBy("table_name", "cardinality").agg(F.count("*").alias("columns"))


@_query(_vc() + _TYPES + " SELECT split_part(col, '.', 1) AS table_name, split_part(col, '.', 2) AS column_name, d AS distinct_count, kind AS inferred_type FROM pr WHERE card = 'LOW'")
def low_cardinality_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = quality.low_cardinality_columns(profile.light_profiles(_counts(spark, sf_dir)))
    return x.select("table_name", F.substring_index("column", ".", -1).alias("column_name"), "distinct_count", "inferred_type")


_SMALL = ("region", "nation", "customer", "supplier", "part", "orders", "labels")


@_query(_vc(_SMALL) + _TYPES + ", mm AS (SELECT col, min(v) AS a, max(v) AS z, min(TRY_CAST(v AS DOUBLE)) AS na, max(TRY_CAST(v AS DOUBLE)) AS nz FROM vc GROUP BY col) SELECT col AS column_name, "
        "CASE WHEN kind IN ('INTEGER', 'FLOAT') THEN CAST(na AS VARCHAR) WHEN kind NOT IN ('BOOLEAN', 'NULL_ONLY', 'FREE_TEXT') THEN a END AS min, CASE WHEN kind IN ('INTEGER', 'FLOAT') THEN CAST(nz AS VARCHAR) WHEN kind NOT IN ('BOOLEAN', 'NULL_ONLY', 'FREE_TEXT') THEN z END AS max FROM pr JOIN mm USING (col)")  # fmt: skip
def value_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    vc = _counts(spark, sf_dir, _SMALL)
    return statistics.ranges(vc, statistics.inferred(vc)).select(F.col("column").alias("column_name"), "min", "max")


_MOMENTS = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


@_query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(x), 4) AS mean, round(var_samp(x), 4) AS variance, round(stddev_samp(x), 4) AS std_dev, round(sum(power(x - m, 3)) / count(*) / power(var_pop(x), 1.5), 4) AS skewness, round(kurtosis_pop(x), 4) AS kurtosis, "
                           f"round(stddev_samp(x) / abs(avg(x)), 4) AS coefficient_of_variation FROM (SELECT CAST({c} AS DOUBLE) AS x, avg({c}) OVER () AS m FROM lineitem)" for c in _MOMENTS))  # fmt: skip
def numeric_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.moments(_read(spark, sf_dir, "lineitem"), _MOMENTS).select(F.col("column").alias("column_name"), "mean", "variance", "std_dev", "skewness", "kurtosis", "coefficient_of_variation")


_NUMBERS = [("lineitem", c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")] + [("customer", "c_acctbal"), ("orders", "o_totalprice"), ("part", "p_retailprice")]
_Q = "SELECT '{t}.{c}' AS column_name, " + ", ".join(f"quantile_cont(CAST({{c}} AS DOUBLE), {p}) AS {n}" for n, p in (("p5", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95))) + " FROM {t}"


def _numeric(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    wanted: dict[str, list[str]] = {}
    for t, c in _NUMBERS:
        wanted.setdefault(t, []).append(c)
    vc = _counts(spark, sf_dir, tuple(wanted), wanted)
    return vc, statistics.percentiles(vc, statistics.inferred(vc))


@_query("SELECT column_name, round(p5, 4) AS p5, round(p25, 4) AS p25, round(median, 4) AS median, round(p75, 4) AS p75, round(p95, 4) AS p95, round(p75 - p25, 4) AS iqr FROM (" + " UNION ALL ".join(_Q.format(t=t, c=c) for t, c in _NUMBERS) + ")")
def numeric_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numeric(spark, sf_dir)[1].select(F.col("column").alias("column_name"), "p5", "p25", "median", "p75", "p95", "iqr")


@_query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS column_name, count(*) FILTER (WHERE {c} < a - 1.5 * i OR {c} > z + 1.5 * i) AS outlier_count FROM {t}, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS z, round(quantile_cont(CAST({c} AS DOUBLE), 0.75) - quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS i FROM {t})" for t, c in _NUMBERS))
def outlier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vc, q = _numeric(spark, sf_dir)
    return statistics.outliers(vc, q).select(F.col("column").alias("column_name"), "outlier_count")


_TEXTS = {"documents": ["text", "lang", "source"], "part": ["p_name", "p_brand", "p_type"], "conversations": ["role", "text"]}


@_query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS column_name, round(avg(length({c})), 2) AS avg_length, round(quantile_cont(length({c}), 0.1), 2) AS length_p10, round(quantile_cont(length({c}), 0.5), 2) AS length_p50, round(quantile_cont(length({c}), 0.9), 2) AS length_p90, CAST(max(length({c})) AS INTEGER) AS length_max FROM {t}" for t, cs in _TEXTS.items() for c in cs))
def string_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of raw text: what standardising would change is left alone."""
    parts = []
    for t, cs in _TEXTS.items():
        df = _read(spark, sf_dir, t).select(*cs)
        sized = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(f"{t}.{c}").alias("column"), F.col(c).alias("value")) for i, c in enumerate(cs)])))
        parts.append(sized.groupBy("ordinal", "column", "value").agg(F.count("*").alias("cnt")))
    out = reduce(DataFrame.union, [statistics.lengths(p) for p in parts])
    return out.select(F.col("column").alias("column_name"), "avg_length", "length_p10", "length_p50", "length_p90", "length_max")


_TOPPED = ("lineitem", "orders", "customer", "part")


@_query(_vc(_TOPPED) + " SELECT col AS column_name, CAST(r AS INTEGER) AS rank, v AS value, cnt AS count FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY cnt DESC, v) AS r FROM vc WHERE v IS NOT NULL) WHERE r <= 10")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.top_values(_counts(spark, sf_dir, _TOPPED)).select(F.col("column").alias("column_name"), "rank", "value", "count")


@_query(_vc(("part", "supplier")) + " SELECT col AS column_name, CAST(r AS INTEGER) AS rank, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY v) AS r FROM vc WHERE v IS NOT NULL) WHERE r <= 5")
def sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.sample_values(_counts(spark, sf_dir, ("part", "supplier"))).select(F.col("column").alias("column_name"), "rank", "value")


# Samples and counts --------------------------------------------------------------------------------------------------


@_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 1000")
def reservoir_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_sample(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", 1000)


@_query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 100 = 0")
def skip_interval_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.skip_sample(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@_query("SELECT CAST(floor((SELECT sum(strlen(text) + 1) FROM documents) / (SELECT avg(strlen(text) + 1) FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 1000))) AS BIGINT) AS estimated_rows")
def row_count_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    return sampling.estimated_rows(docs.orderBy("doc_id").limit(1000).select(F.col("text").alias("value")), size)


@_query("SELECT table_name, CAST(floor((row_number() OVER (ORDER BY table_name) - 1) / 3) AS BIGINT) AS chunk FROM " + _sql_values([(t,) for t in EVERY], "table_name"))
def table_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.chunks(_values(spark, [(t,) for t in EVERY], "table_name string"), "table_name", 3)


_SIZES = [(n,) for n in (0, 1, 100 * 1024**2 - 1, 100 * 1024**2, 2 * 1024**3 - 1, 2 * 1024**3, 10**12)]


@_query("SELECT size_bytes, CASE WHEN size_bytes < 104857600 THEN 'MEMORY_SAFE' WHEN size_bytes < 2147483648 THEN 'LAZY_SCAN' ELSE 'STREAM_ONLY' END AS size_strategy FROM " + _sql_values(_SIZES, "size_bytes").replace("(0)", "(CAST(0 AS BIGINT))", 1))
def size_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeframe.sources.intake import size_strategy

    return _values(spark, [(n, size_strategy(n)) for (n,) in _SIZES], "size_bytes bigint, size_strategy string")


# Literal fixtures ------------------------------------------------------------------------------------------------------

_DATES = [(v,) for v in ("2024-01-15", "20240115", "15/01/2024", "12/31/2024", "01/02/2024", "2024/01/15", "15-01-2024", "12-31-2024", "2024-02-30", "2024-1-5", "hello", "42", "99999999")]


@_query("SELECT value, " + _DATE.format(v="value") + " AS label FROM " + _sql_values(_DATES, "value"))
def infer_date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, _DATES, "value string").select("value", semantic.date_label(F.col("value")).alias("label"))


_STAMPS = [(v,) for v in ("2024-01-15T10:00:00Z", "2024-01-15T10:00:00", "2024-01-15 10:00:00.25", "2024-01-15 10:00", "2024-01-15T10:00:00+0200", "2024-01-15T10:00:00.5+02:00", "15/01/2024 10:11:12", "12/31/2024 10:11:12.5", "12-31-2024 10:11:12", "2024-02-30 10:00:00", "2024-01-15T25:00:00", "2024-01-15", "x")]


@_query("SELECT value, " + _STAMP.format(v="value") + " AS kind FROM " + _sql_values(_STAMPS, "value"))
def infer_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, _STAMPS, "value string").select("value", semantic.timestamp_kind(F.col("value")).alias("kind"))


_EDGES = [(v,) for v in ("007", "1,000", "3.14", ".5", "1e10", "+5", "-0", "0", "-12", "12.", "1.5e-3", "abc", "1,2,3", "--1")]


@_query("SELECT value, " + _INT.format(p=_plain("value")) + " AS is_integer, " + _FLT.format(p=_plain("value")) + " AS is_float FROM " + _sql_values(_EDGES, "value"))
def infer_numeric_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _values(spark, _EDGES, "value string").select("value", semantic.is_integer(v).alias("is_integer"), semantic.is_float(v).alias("is_float"))


_UUIDS = [(v,) for v in ("123e4567-e89b-12d3-a456-426614174000", "123E4567-E89B-12D3-A456-426614174000", "123e4567e89b12d3a456426614174000", "123e4567-e89b-12d3-a456-42661417400g", "")]


@_query("SELECT value, " + _UUID.format(v="value") + " AS is_uuid FROM " + _sql_values(_UUIDS, "value"))
def infer_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, _UUIDS, "value string").select("value", semantic.is_uuid(F.col("value")).alias("is_uuid"))


_NAMES = [(0, "First Name"), (1, "Order #ID (2024)"), (2, "1st_column"), (3, "!!!"), (4, "__name__"), (5, "A"), (6, "a "), (7, " A"), (8, "Total--Amount"), (9, "first_name")]
_NORM = "trim(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9_]', '_', 'g'), '_{2,}', '_', 'g'), '_')"


@_query(f"WITH n AS (SELECT ordinal, name, {_NORM} AS c FROM {_sql_values(_NAMES, 'ordinal, name')}), m AS (SELECT ordinal, name, CASE WHEN c = '' THEN 'unnamed' WHEN regexp_matches(c, '^[0-9]') THEN 'col_' || c ELSE c END AS s FROM n) "
        "SELECT ordinal, name, CASE WHEN r = 1 THEN s ELSE s || '_' || r END AS standard_name FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY ordinal) AS r FROM m)")  # fmt: skip
def standardize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    x = _values(spark, _NAMES, "ordinal int, name string").withColumn("s", text.standard_name_of(F.col("name")))
    r = F.row_number().over(Window.partitionBy("s").orderBy("ordinal"))
    return x.select("ordinal", "name", F.when(r == 1, F.col("s")).otherwise(F.concat_ws("_", "s", r.cast("string"))).alias("standard_name"))


_CELLS = [("a", v) for v in (" x ", "NULL", "n/a", "", "  ", "0", "hello", "-", "--", ".", "missing", "Undefined", None)]
_CELLS += [("b", v) for v in ("yes", "No", "Y", "n", "T", "f", "1", "0", "TRUE", "false", "NA")]
_CELLS += [("c", v) for v in ("$1,234.56", "€500", "85.5%", "1,000,000", "$ales", "$-50", "12", "%", "£ 7")]
_CELLS += [("d", v) for v in ("yes", "maybe", "no", "other")]
_CLEAN = (
    f"WITH x AS (SELECT c, v, trim(v) AS cut FROM {_sql_values(_CELLS, 'c, v', 'y')}), b AS (SELECT c, sum(CASE WHEN lower(cut) IN {_in(TRUE_TOKENS + FALSE_TOKENS)} THEN 1 ELSE 0 END) >= 0.9 * sum(CASE WHEN cut <> '' THEN 1 ELSE 0 END) AS mostly FROM x GROUP BY c), "
    f"k AS (SELECT x.*, mostly, CASE WHEN cut = '' OR lower(cut) IN {_in(NULL_TOKENS)} THEN NULL ELSE cut END AS known FROM x JOIN b USING (c)), "
    f"t AS (SELECT *, CASE WHEN mostly AND lower(known) IN {_in(TRUE_TOKENS)} THEN 'true' WHEN mostly AND lower(known) IN {_in(FALSE_TOKENS)} THEN 'false' ELSE known END AS truth FROM k), "
    "s AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(truth, '^[$€£¥]', ''), '%$', ''), '([0-9]),([0-9]{3})', '\\1\\2', 'g'), '([0-9]),([0-9]{3})', '\\1\\2', 'g')) AS num FROM t), "
    "z AS (SELECT *, CASE WHEN regexp_matches(num, '[0-9]') THEN num ELSE truth END AS new FROM s)"
)


def _raw_cells(spark: SparkSession) -> DataFrame:
    x = _values(spark, [(ord(c) - 97, c, v) for c, v in _CELLS], "ordinal int, column string, value string")
    return x.groupBy("ordinal", "column", "value").agg(F.count("*").alias("cnt"))


@_query(_CLEAN + " SELECT c AS column_name, v AS value, new AS standard FROM z")
def standardize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.standardised(_raw_cells(spark)).select(F.col("column").alias("column_name"), "value", F.col("new").alias("standard"))


@_query(_CLEAN + " SELECT c AS column_name, count(*) FILTER (WHERE v IS NOT NULL AND known IS NULL) AS nulls_normalized, count(*) FILTER (WHERE v <> cut) AS whitespace_trimmed, count(*) FILTER (WHERE truth <> known) AS booleans_normalized, count(*) FILTER (WHERE new <> truth) AS numerics_cleaned FROM z GROUP BY c")
def standardization_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.report(_raw_cells(spark)).select(F.col("column").alias("column_name"), "nulls_normalized", "whitespace_trimmed", "booleans_normalized", "numerics_cleaned")


# Quality ---------------------------------------------------------------------------------------------------------------


def _flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with an empty, a constant, a sparse, a sentinel-filled and a doubly named column."""
    key = F.col("o_orderkey")
    x = _read(spark, sf_dir, "orders").select(key.alias("id"), F.lit(None).cast("string").alias("empty"), F.lit("x").alias("same"), F.when(key % 10 == 0, key).alias("sparse"), F.when(key % 2 == 0, "n/a").otherwise("v").alias("filled"), F.col("o_orderstatus").alias("p"), F.col("o_orderpriority").alias("q"))
    return x.toDF("id", "empty", "same", "sparse", "filled", "twin", "twin")


_FLAGS = [("empty", "FULLY_NULL"), ("empty", "HIGH_NULL_RATIO"), ("same", "CONSTANT_COLUMN"), ("sparse", "HIGH_NULL_RATIO"), ("filled", "NULL_VARIANT_NORMALIZED"), ("filled", "CONSTANT_COLUMN"), ("twin", "DUPLICATE_COLUMN_NAME"), ("twin_2", "DUPLICATE_COLUMN_NAME")]
_FLAG_SQL = (
    "WITH x AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey END AS sparse, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'v' END AS filled FROM orders), "
    "c AS (SELECT count(*) AS n, count(sparse) AS s, count(DISTINCT sparse) AS sd, count(filled) AS f, count(DISTINCT filled) AS fd FROM x), f AS ("
    "SELECT 'empty' AS name, 'FULLY_NULL' AS flag FROM c WHERE n > 0 UNION ALL SELECT 'empty', 'HIGH_NULL_RATIO' FROM c WHERE n > 0 UNION ALL SELECT 'same', 'CONSTANT_COLUMN' FROM c WHERE n > 0 "
    "UNION ALL SELECT 'sparse', 'HIGH_NULL_RATIO' FROM c WHERE (n - s) / n > 0.7 UNION ALL SELECT 'filled', 'CONSTANT_COLUMN' FROM c WHERE fd = 1 UNION ALL SELECT 'filled', 'NULL_VARIANT_NORMALIZED' FROM c WHERE f < n "
    "UNION ALL SELECT 'twin', 'DUPLICATE_COLUMN_NAME' UNION ALL SELECT 'twin_2', 'DUPLICATE_COLUMN_NAME')"
)


@_query(_FLAG_SQL + " SELECT name, flag FROM f")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profiles(_flawed(spark, sf_dir), "orders").select("name", F.explode("quality_flags").alias("flag"))


@_query(_FLAG_SQL + " SELECT 'orders' AS table_name, CAST(7 AS BIGINT) AS columns_profiled, count(DISTINCT name) AS columns_with_issues, count(DISTINCT CASE WHEN flag IN ('HIGH_NULL_RATIO', 'FULLY_NULL') THEN name END) AS null_heavy_columns, CAST(0 AS BIGINT) AS type_conflict_columns, CAST(0 AS BIGINT) AS corrupt_rows_detected FROM f")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summary(profile.column_profiles(_flawed(spark, sf_dir), "orders"))


# Relationships -----------------------------------------------------------------------------------------------------------

_PAIRS = _vc(RELATED) + _TYPES + (
    ", tp AS (SELECT col, list(v ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY cnt DESC, v) AS r FROM vc WHERE v IS NOT NULL) WHERE r <= 10 GROUP BY col), "
    "pp AS (SELECT split_part(col, '.', 1) AS t, split_part(col, '.', 2) AS c, kind, nulls, n, d, round(ratio, 4) AS ur, is_key, top FROM pr LEFT JOIN tp USING (col) WHERE kind NOT IN ('FREE_TEXT', 'BOOLEAN', 'NULL_ONLY')), "
    "ids AS (SELECT *, lower(c) LIKE '%id' OR lower(c) IN ('id', 'key', 'code') AS idn FROM pp), "
    "j AS (SELECT f.t AS fk_table, f.c AS fk_column, p.t AS pk_table, p.c AS pk_column, "
    "CASE WHEN length(rtrim(p.t, 's')) >= 3 AND f.c = p.t || '_' || p.c THEN 50 WHEN length(rtrim(p.t, 's')) >= 3 AND f.c = rtrim(p.t, 's') || '_' || p.c THEN 45 WHEN f.c = p.c THEN 40 WHEN length(rtrim(p.t, 's')) >= 3 AND f.c LIKE '%\\_' || p.c ESCAPE '\\' AND contains(f.c, rtrim(p.t, 's')) THEN 35 ELSE 0 END AS ns, "
    "CASE WHEN f.kind = p.kind THEN 20 WHEN f.kind IN ('INTEGER', 'FLOAT') AND p.kind IN ('INTEGER', 'FLOAT') THEN 10 WHEN f.kind IN ('STRING', 'INTEGER', 'UUID') AND p.kind IN ('STRING', 'INTEGER', 'UUID') THEN 5 ELSE 0 END AS ts, "
    "CASE WHEN p.is_key THEN 20 WHEN p.ur >= 0.95 THEN 15 WHEN p.idn AND p.nulls = 0 AND p.d > 1 THEN 10 ELSE 0 END + CASE WHEN f.d <= p.d THEN 5 ELSE 0 END AS cs, len(list_intersect(f.top, p.top)) / len(f.top) AS ov, f.d AS fk_distinct_count, p.d AS pk_distinct_count "
    "FROM ids f JOIN ids p ON f.t <> p.t AND NOT f.is_key AND (p.is_key OR (p.ur >= 0.95 AND p.nulls = 0) OR (p.idn AND p.nulls = 0 AND p.d > 1))), "
    "sc AS (SELECT *, least(100, ns + ts + cs + CASE WHEN ov >= 0.8 THEN 15 WHEN ov >= 0.5 THEN 10 ELSE 0 END) AS score FROM j WHERE ns > 0 OR ts > 0)"
)


@_query(_PAIRS + " SELECT fk_table, fk_column, pk_table, pk_column, CAST(score AS INTEGER) AS score_pct, fk_distinct_count, pk_distinct_count, round(ov, 4) AS overlap FROM sc")
def fk_pairs_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = relationships.pairs(profile.light_profiles(_counts(spark, sf_dir, RELATED)))
    return x.select("fk_table", "fk_column", "pk_table", "pk_column", "score_pct", "fk_distinct_count", "pk_distinct_count", F.round("top_value_overlap_pct", 4).alias("overlap"))


@_query(_PAIRS + " SELECT fk_table, fk_column, pk_table, pk_column, score / 100 AS confidence FROM sc WHERE score >= 50")
def fk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships.candidates(profile.light_profiles(_counts(spark, sf_dir, RELATED))).select("fk_table", "fk_column", "pk_table", "pk_column", "confidence")


_LINKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("labels", "doc_id", "documents", "doc_id"), ("lineitem", "l_partkey", "supplier", "s_suppkey")]


@_query(" UNION ALL ".join(f"SELECT '{a}.{b}' AS fk, '{c}.{d}' AS pk, count(DISTINCT {a}.{b}) AS fk_values, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM {c} AS q WHERE q.{d} = {a}.{b}) THEN {a}.{b} END) AS found_values, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM {c} AS q WHERE q.{d} = {a}.{b})) AS orphan_rows FROM {a}" for a, b, c, d in _LINKS))
def fk_exact_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda a, b, c, d: relationships.containment(_read(spark, sf_dir, a), b, _read(spark, sf_dir, c), d).select(F.lit(f"{a}.{b}").alias("fk"), F.lit(f"{c}.{d}").alias("pk"), "fk_values", "found_values", "orphan_rows")
    return reduce(DataFrame.union, [one(*x) for x in _LINKS])


_EDGE = [
    ("orders", "customer_id", "customers", "id", 1.0), ("orders", "customer_id", "people", "id", 0.7), ("visit", "person_id", "person", "person_id", 0.8), ("visit", "person_id", "observation", "person_id", 0.8),
    ("person", "person_id", "visit", "person_id", 0.75), ("orders", "lasteditedby", "people", "id", 0.6), ("items", "CreatedBy", "people", "id", 0.55), ("items", "order_id", "orders", "order_id", 0.65),
]
_EDGE_NAMES = "fk_table, fk_column, pk_table, pk_column, confidence"
_BEST = (
    "WITH e AS (SELECT fk_table, fk_column, pk_table, pk_column, CAST(confidence AS DOUBLE) AS confidence FROM {v}), w AS (SELECT * FROM e WHERE {where}), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY fk_table, fk_column ORDER BY confidence DESC, (replace(replace(lower(fk_column), '_id', ''), 'id', '') = lower(pk_table)) DESC, pk_table, pk_column) AS r FROM w), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY least(fk_table || '.' || fk_column, pk_table || '.' || pk_column), greatest(fk_table || '.' || fk_column, pk_table || '.' || pk_column) ORDER BY confidence DESC, fk_table, fk_column) AS q FROM b WHERE r = 1), "
    "best AS (SELECT fk_table, fk_column, pk_table, pk_column, confidence FROM o WHERE q = 1)"
)
_EV = _sql_values(_EDGE, _EDGE_NAMES)
_DOMAIN = _BEST.format(v=_EV, where=f"lower(fk_column) NOT IN {_in(AUDIT_COLUMNS)} AND confidence >= 0.7")


def _edges(spark: SparkSession) -> DataFrame:
    return _values(spark, _EDGE, "fk_table string, fk_column string, pk_table string, pk_column string, confidence double")


@_query(_BEST.format(v=_EV, where="TRUE") + " SELECT * FROM best")
def fk_best_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships.best_edges(_edges(spark))


@_query(_DOMAIN + " SELECT '    ' || pk_table || ' ||--o{ ' || fk_table || ' : \"' || fk_column || ' -> ' || pk_column || '\"' AS line FROM best")
def er_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagram.edge_lines(relationships.domain_edges(_edges(spark))).select("line")


_MARKED = [("orders", 0, "order_id", "INTEGER", True), ("orders", 1, "customer_id", "INTEGER", False), ("orders", 2, "note", "FREE_TEXT", False), ("customers", 0, "id", "INTEGER", True), ("customers", 1, "when at", "TIMESTAMP", False), ("other", 0, "x", "STRING", True)]
_LABEL_SQL = "CASE inferred_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_LABELS.items()) + " ELSE 'string' END"


@_query(_DOMAIN + f", p AS (SELECT * FROM {_sql_values(_MARKED, 'table_name, ordinal, name, inferred_type, is_key_candidate', 'y')}), l AS (SELECT table_name, ordinal, {_LABEL_SQL} || ' ' || regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') || CASE WHEN EXISTS (SELECT 1 FROM best WHERE fk_table = table_name AND fk_column = name) THEN ' FK' WHEN is_key_candidate THEN ' PK' ELSE '' END AS line "
        "FROM p WHERE EXISTS (SELECT 1 FROM best WHERE fk_table = table_name OR pk_table = table_name)) SELECT table_name, '    ' || table_name || ' {' || chr(10) || string_agg('        ' || line, chr(10) ORDER BY ordinal) || chr(10) || '    }' AS block FROM l GROUP BY table_name")  # fmt: skip
def er_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _values(spark, _MARKED, "table_name string, ordinal int, name string, inferred_type string, is_key_candidate boolean")
    return diagram.entities(p, relationships.domain_edges(_edges(spark)))


@_query(_BEST.format(v=_EV, where=f"lower(fk_column) IN {_in(AUDIT_COLUMNS)} AND confidence >= 0.5") + " SELECT pk_table || '.' || pk_column AS pk, count(*) AS tables, string_agg(fk_table || '.' || fk_column, ', ' ORDER BY fk_table || '.' || fk_column) AS \"references\" FROM best GROUP BY 1")
def audit_fk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships.audit_summary(relationships.audit_edges(_edges(spark)))


@_query(f"SELECT {_EDGE_NAMES.replace('confidence', 'CAST(confidence AS DOUBLE) AS confidence')}, CASE WHEN fk_table = 'orders' THEN 'outgoing' ELSE 'incoming' END AS direction, CASE WHEN fk_table = 'orders' THEN pk_table ELSE fk_table END AS related_table FROM {_EV} WHERE fk_table = 'orders' OR pk_table = 'orders'")
def table_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships.of_table(_edges(spark), "orders")


_INDEX = f"SELECT fk_table AS table_name, 'outgoing' AS direction, fk_column AS \"column\", pk_table AS other_table, pk_column AS other_column, CAST(confidence AS DOUBLE) AS confidence FROM {_EV} UNION ALL SELECT pk_table, 'incoming', pk_column, fk_table, fk_column, CAST(confidence AS DOUBLE) FROM {_EV}"


@_query(_INDEX)
def enriched_relationship_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relationships.edge_index(_edges(spark))


@_query(f"WITH i AS ({_INDEX}), l AS (SELECT *, CASE WHEN direction = 'outgoing' THEN '    ' || \"column\" || ' -> ' || other_table || '.' || other_column ELSE '    ' || other_table || '.' || other_column || ' -> ' || \"column\" END || printf(' (confidence=%.2f)', confidence) AS line FROM i), "
        "g AS (SELECT table_name, count(*) FILTER (WHERE direction = 'outgoing') AS o, count(*) FILTER (WHERE direction = 'incoming') AS n, string_agg(line, chr(10) ORDER BY confidence DESC, line) FILTER (WHERE direction = 'outgoing') AS ol, string_agg(line, chr(10) ORDER BY confidence DESC, line) FILTER (WHERE direction = 'incoming') AS il FROM l GROUP BY table_name) "
        "SELECT table_name, o AS outgoing_count, n AS incoming_count, 'Table ' || table_name || ' relationships:' || CASE WHEN o > 0 THEN chr(10) || '  Outgoing FKs (' || o || '):' || chr(10) || ol ELSE '' END || CASE WHEN n > 0 THEN chr(10) || '  Incoming FKs (' || n || '):' || chr(10) || il ELSE '' END AS content FROM g")  # fmt: skip
def relationship_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.relationship_documents(_edges(spark))


@_query(f"SELECT fk_table || '.' || fk_column || ' -> ' || pk_table || '.' || pk_column AS relationship, CAST(confidence AS DOUBLE) AS confidence FROM {_EV}")
def chart_relationship_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.relationship_confidence(_edges(spark))


# Drift, nested data, text files ----------------------------------------------------------------------------------------

_SHAPE = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({len(TABLES[t])} AS BIGINT) AS column_count FROM {t}" for t in RELATED)
_PRINT = "substr(sha256(table_name || ':' || CAST(row_count AS VARCHAR) || ':' || CAST(column_count AS VARCHAR)), 1, 16)"
_BEFORE = [("region", 5, 2), ("nation", 24, 3), ("gone", 7, 1)]


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t: _read(spark, sf_dir, t).agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count", F.lit(len(TABLES[t])).cast("long").alias("column_count"))
    return drift.table_fingerprints(reduce(DataFrame.union, [one(t) for t in RELATED]))


@_query(f"SELECT *, {_PRINT} AS fingerprint FROM ({_SHAPE})")
def table_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shapes(spark, sf_dir)


@_query(f"WITH a AS (SELECT table_name, {_PRINT} AS f FROM ({_SHAPE})), b AS (SELECT table_name, {_PRINT} AS f FROM {_sql_values(_BEFORE, 'table_name, row_count, column_count')}) "
        "SELECT coalesce(a.table_name, b.table_name) AS table_name, CASE WHEN b.f IS NULL THEN 'new' WHEN a.f IS NULL THEN 'removed' WHEN a.f <> b.f THEN 'changed' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.table_name = b.table_name")  # fmt: skip
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = drift.table_fingerprints(_values(spark, _BEFORE, "table_name string, row_count long, column_count long"))
    return drift.table_drift(_shapes(spark, sf_dir), before)


_OLD = [("t", "a", "INTEGER", False), ("t", "b", "STRING", False), ("t", "c", "DATE", True)]
_NEW = [("t", "a", "INTEGER", False), ("t", "b", "STRING", True), ("t", "d", "FLOAT", False)]
_FORM = "inferred_type || '/' || CASE WHEN is_nullable THEN 'null' ELSE 'not null' END"


@_query(f"WITH a AS (SELECT table_name, name, {_FORM} AS f FROM {_sql_values(_NEW, 'table_name, name, inferred_type, is_nullable')}), b AS (SELECT table_name, name, {_FORM} AS f FROM {_sql_values(_OLD, 'table_name, name, inferred_type, is_nullable')}) SELECT * FROM (SELECT coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.name, b.name) AS name, "
        "CASE WHEN b.f IS NULL THEN 'new' WHEN a.f IS NULL THEN 'removed' WHEN a.f <> b.f THEN 'changed' END AS status, b.f AS was, a.f AS \"is\" FROM a FULL JOIN b ON a.table_name = b.table_name AND a.name = b.name) WHERE status IS NOT NULL")  # fmt: skip
def column_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = lambda rows: _values(spark, rows, "table_name string, name string, inferred_type string, is_nullable boolean")
    return drift.column_drift(frame(_NEW), frame(_OLD))


@_query("SELECT event_id, user_id AS who_id, event_type AS who_act_type, '[' || user_id || ',' || event_id || ']' AS who_pair FROM events")
def flatten_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _read(spark, sf_dir, "events").select("event_id", F.struct(F.col("user_id").alias("id"), F.struct(F.col("event_type").alias("type")).alias("act"), F.array("user_id", "event_id").alias("pair")).alias("who"))
    return text.flattened(nested)


@_query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return records.flat(x)


@_query("SELECT key, count(*) AS occurrences, round(count(*) / (SELECT count(*) FROM events), 4) AS occurrence_ratio FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def json_key_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.key_occurrence(_read(spark, sf_dir, "events").select(F.col("props").alias("value"))).select("key", "occurrences", "occurrence_ratio")


_JSON = [('{"id": 1, "value": 42, "email": "a"}',), ('{"id": 2, "value": "text"}',), ('{"id": 3, "value": true, "email": null}',), ("not json",), ('{"id": 4, "email": "b"}',)]
_JSON_KIND = "CASE json_type(j, '$.\"' || key || '\"') WHEN 'UBIGINT' THEN 'n' WHEN 'BIGINT' THEN 'n' WHEN 'DOUBLE' THEN 'd' WHEN 'VARCHAR' THEN 's' WHEN 'BOOLEAN' THEN 'b' END"


@_query(f"WITH x AS (SELECT value AS j FROM {_sql_values(_JSON, 'value')} WHERE json_valid(value)), k AS (SELECT j, unnest(json_keys(j)) AS key FROM x) SELECT key, count(*) AS occurrences, round(count(*) / (SELECT count(*) FROM x), 4) AS occurrence_ratio, count(DISTINCT {_JSON_KIND}) > 1 AS type_conflict FROM k GROUP BY key")
def json_type_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.key_occurrence(_values(spark, _JSON, "value string")).select("key", "occurrences", "occurrence_ratio", "type_conflict")


@_query("SELECT l_orderkey, l_linenumber, '[' || l_partkey || ',' || l_suppkey || ']' AS pair FROM lineitem")
def array_stringify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.flattened(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_partkey", "l_suppkey").alias("pair")))


_LINES = [("id,name,note",), ("1,Alice,x;y",), ("2,Bob,z",), ("3,Carol,a;b;c",), ("4,Dave",), ("",)]
_COUNT = "length(value) - length(replace(value, '{d}', ''))"


@_query(" UNION ALL ".join(f"SELECT {d} AS delimiter, round(avg(n) / (1 + var_pop(n)), 4) AS score FROM (SELECT length(value) - length(replace(value, {d}, '')) AS n FROM {_sql_values(_LINES, 'value')} WHERE trim(value) <> '')" for d in ("','", "chr(9)", "'|'", "';'")))
def csv_delimiter_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.delimiter_scores(_values(spark, _LINES, "value string"))


@_query(f"SELECT round(1 - max(c) / sum(c), 4) AS corruption_ratio FROM (SELECT {_COUNT.format(d=',')} AS n, count(*) AS c FROM {_sql_values(_LINES, 'value')} WHERE trim(value) <> '' GROUP BY 1)")
def csv_corruption_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.corruption_ratio(_values(spark, _LINES, "value string"), ",")


# Vectors and clusters ----------------------------------------------------------------------------------------------------

NEAR = 0.4


def _columns_as_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.concat(F.lit("t"), F.col("label").cast("string")).alias("table_name"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("column_name"), "embedding")


_VEC = "WITH e AS (SELECT 't' || label AS t, lpad(CAST(vec_id AS VARCHAR), 12, '0') AS c, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.t AS ta, a.c AS ca, b.t AS tb, b.c AS cb, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON (a.t, a.c) < (b.t, b.c) AND list_cosine_similarity(a.v, b.v) >= 0.4)"
_NEAR = _VEC + ", d AS (SELECT * FROM p WHERE ta <> tb UNION ALL SELECT tb, cb, ta, ca, s FROM p WHERE ta <> tb), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ta, ca ORDER BY s DESC, tb, cb) AS r FROM d) WHERE r <= 5), u AS (SELECT DISTINCT CASE WHEN (ta, ca) < (tb, cb) THEN ta ELSE tb END AS ta, CASE WHEN (ta, ca) < (tb, cb) THEN ca ELSE cb END AS ca, CASE WHEN (ta, ca) < (tb, cb) THEN tb ELSE ta END AS tb, CASE WHEN (ta, ca) < (tb, cb) THEN cb ELSE ca END AS cb, round(s, 6) AS s FROM n)"


@_query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT lpad(CAST(vec_id AS VARCHAR), 12, '0') AS column_name, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)) DESC, vec_id LIMIT 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _read(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]
    return vectors.search(_columns_as_vectors(spark, sf_dir), list(first), 10).select("column_name", F.round("similarity", 6).alias("similarity"))


def _rounded(c: str, digits: int) -> Column:
    """A double rounded the way SQL does: the scaled double, halves away from zero."""
    scaled = F.col(c) * 10.0**digits
    return F.signum(scaled) * F.floor(F.abs(scaled) + 0.5).cast("double") / 10.0**digits


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.neighbours(_columns_as_vectors(spark, sf_dir), threshold=NEAR).withColumn("similarity", _rounded("similarity", 6))


@_query(_NEAR + " SELECT ta AS table_a, ca AS column_a, tb AS table_b, cb AS column_b, round(s, 4) AS similarity FROM u")
def column_affinity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors.column_pairs(_near(spark, sf_dir))
    return x.select(F.col("a.table_name").alias("table_a"), F.col("a.column_name").alias("column_a"), F.col("b.table_name").alias("table_b"), F.col("b.column_name").alias("column_b"), _rounded("similarity", 4).alias("similarity"))


@_query(_NEAR + " SELECT ta AS table_a, tb AS table_b, round(sum(s), 3) AS affinity FROM (SELECT least(ta, tb) AS ta, greatest(ta, tb) AS tb, s FROM u) GROUP BY ta, tb")
def affinity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = vectors.affinity(_near(spark, sf_dir))
    return x.select("table_a", "table_b", F.round("affinity", 3).alias("affinity"))


@_query(_VEC.replace("WITH e", "WITH RECURSIVE e") + ", g AS (SELECT ta || '.' || ca AS x, tb || '.' || cb AS y FROM p UNION ALL SELECT tb || '.' || cb, ta || '.' || ca FROM p), w AS (SELECT DISTINCT x, x AS z FROM g UNION SELECT w.x, g.y FROM w JOIN g ON w.z = g.x), l AS (SELECT x, min(z) AS cluster FROM w GROUP BY x), "
        "k AS (SELECT cluster FROM l GROUP BY cluster HAVING count(DISTINCT split_part(x, '.', 1)) > 1) SELECT cluster, split_part(x, '.', 1) AS table_name, split_part(x, '.', 2) AS column_name FROM l WHERE cluster IN (SELECT cluster FROM k)")  # fmt: skip
def dbscan_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.column_clusters(_columns_as_vectors(spark, sf_dir), NEAR)


_MEMBERS = [("c1", "customers", "id", "PK"), ("c1", "orders", "customer_id", ""), ("c1", "visits", "customer", ""), ("c2", "orders", "status", ""), ("c2", "visits", "state", ""), ("c3", "a", "id", ""), ("c3", "b", "id", "")]
_KNOWN = [("customers", "id", True, 1.0, 0, 100, "INTEGER"), ("orders", "customer_id", False, 0.5, 0, 90, "INTEGER"), ("visits", "customer", False, 0.3, 4, 120, "STRING"), ("orders", "status", False, 0.01, 0, 3, "CATEGORICAL"), ("visits", "state", False, 0.02, 0, 4, "CATEGORICAL"), ("a", "id", True, 1.0, 0, 50, "INTEGER"), ("b", "id", True, 1.0, 0, 60, "INTEGER")]
_CLUSTERED = (
    f"WITH m AS (SELECT * FROM {_sql_values(_MEMBERS, 'cluster, t, c, role')}), p AS (SELECT * FROM {_sql_values(_KNOWN, 't, c, k, ur, nulls, d, kind', 'y')}), s AS (SELECT m.*, k, ur, nulls, d, kind, CASE WHEN upper(role) = 'PK' THEN 0.5 ELSE 0 END + CASE WHEN k THEN 0.4 ELSE 0 END + ur * 0.3 - CASE WHEN nulls > 0 THEN 0.1 ELSE 0 END AS score FROM m JOIN p USING (t, c)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, t, c) AS r FROM s), a AS (SELECT * FROM r WHERE r = 1), b AS (SELECT * FROM r WHERE r = 2), "
    "g AS (SELECT a.* FROM a LEFT JOIN b USING (cluster) WHERE a.score >= 0.2 AND NOT coalesce(a.score >= 0.7 AND b.score >= 0.7 AND a.t <> b.t AND a.ur >= 0.95 AND b.ur >= 0.95, FALSE)), "
    "f AS (SELECT r.cluster, r.t AS fk_table, r.c AS fk_column, g.t AS pk_table, g.c AS pk_column, least(100, 50 + CASE WHEN g.k THEN 15 ELSE 0 END + CASE WHEN g.d > 0 AND r.d <= g.d THEN 10 ELSE 0 END + CASE WHEN r.kind = g.kind THEN 10 ELSE 0 END + CASE WHEN contains(lower(r.c), rtrim(lower(g.t), 's')) THEN 10 ELSE 0 END) / 100 AS confidence FROM r JOIN g USING (cluster) WHERE r.r > 1 AND r.t <> g.t)"
)


def _members(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    m = _values(spark, _MEMBERS, "cluster string, table_name string, column_name string, role string")
    return m, _values(spark, _KNOWN, "table_name string, name string, is_key_candidate boolean, unique_ratio double, null_count long, distinct_count long, inferred_type string")


@_query(_CLUSTERED + " SELECT cluster, fk_table, fk_column, pk_table, pk_column, confidence FROM f")
def derived_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.derived(*_members(spark))


@_query(_CLUSTERED + ", n AS (SELECT cluster, pk_table, pk_column, string_agg(fk_table || '.' || fk_column, ', ' ORDER BY confidence DESC, fk_table || '.' || fk_column) AS l FROM f GROUP BY 1, 2, 3), h AS (SELECT cluster, string_agg(DISTINCT t, ', ' ORDER BY t) AS ts, string_agg(DISTINCT c, ', ' ORDER BY c) AS cs, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS ks FROM s GROUP BY cluster) "
        "SELECT h.cluster, CASE WHEN n.l IS NOT NULL THEN 'pk_fk' ELSE 'shared_attribute' END AS cluster_type, CASE WHEN n.l IS NOT NULL THEN upper(substr(rtrim(pk_table, 's'), 1, 1)) || substr(rtrim(pk_table, 's'), 2) || ' identifier cluster. ' || pk_table || '.' || pk_column || ' is the PK (' || CASE WHEN p.k THEN 'key_candidate=True, ' ELSE '' END || CAST(round(p.ur * 100) AS INTEGER) || '% distinct). FK references: ' || l || '.' "
        "ELSE 'Shared attribute domain across [' || ts || ']. Columns [' || cs || '] represent the same concept (' || ks || ') but are not FK relationships.' END AS summary FROM h LEFT JOIN n USING (cluster) LEFT JOIN p ON p.t = n.pk_table AND p.c = n.pk_column")  # fmt: skip
def cluster_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, known = _members(spark)
    return clusters.summaries(m, clusters.derived(m, known), known)


# Texts and charts ----------------------------------------------------------------------------------------------------------


@_query(_vc(("orders",)) + _TYPES + " SELECT split_part(col, '.', 2) AS name, CAST(CASE WHEN is_key THEN 0 WHEN lower(split_part(col, '.', 2)) LIKE '%id' THEN 1 WHEN d = 1 THEN 2 ELSE 3 END AS INTEGER) AS priority FROM pr")
def column_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.light_profiles(_counts(spark, sf_dir, ("orders",))).select("name", enrich.column_priority().alias("priority"))


@_query(" UNION ALL ".join(f"SELECT 'Table {t} has ' || count(*) || ' rows and {len(cs)} columns. Columns: {', '.join(cs)}.' AS summary, '{t}' AS table_name FROM {t}" for t, cs in TABLES.items()))
def table_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.fallback_summaries(profile.light_profiles(_counts(spark, sf_dir))).select("table_name", "summary")


@_query(" UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 4) AS correlation FROM lineitem" for i, a in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax")) for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i + 1 :]))
def pairwise_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.correlations(_read(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@_query("SELECT bin, round(a + bin * (z - a) / 20, 6) AS low, round(a + (bin + 1) * (z - a) / 20, 6) AS high, count(*) AS count FROM (SELECT CAST(least(floor((l_quantity - a) / ((z - a) / 20)), 19) AS INTEGER) AS bin, a, z FROM lineitem, (SELECT min(l_quantity) AS a, max(l_quantity) AS z FROM lineitem)) GROUP BY bin, a, z")
def chart_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.distribution(_read(spark, sf_dir, "lineitem"), "l_quantity")


def _light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.light_profiles(_counts(spark, sf_dir))


@_query(_vc() + _TYPES + " SELECT split_part(col, '.', 1) AS table_name, split_part(col, '.', 2) AS name, CAST(nulls AS BIGINT) AS null_count, round(nulls / n, 4) AS null_ratio FROM pr")
def chart_null_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.null_distribution(_light(spark, sf_dir))


@_query(_vc() + _TYPES + " SELECT split_part(col, '.', 1) AS table_name, split_part(col, '.', 2) AS name, round(1 - nulls / n, 4) AS completeness FROM pr")
def chart_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.completeness(_light(spark, sf_dir))


@_query(_vc() + _TYPES + " SELECT split_part(col, '.', 1) AS table_name, kind AS inferred_type, count(*) AS columns FROM pr GROUP BY 1, 2")
def chart_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.type_distribution(_light(spark, sf_dir))


@_query(_vc() + _TYPES + " SELECT split_part(col, '.', 1) AS table_name, CAST(max(n) AS BIGINT) AS row_count, count(*) AS columns, CAST(sum(nulls) AS BIGINT) AS nulls, count(*) FILTER (WHERE is_key) AS key_candidates, count(*) FILTER (WHERE d = 1) AS columns_with_issues FROM pr GROUP BY 1")
def chart_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.overview(_light(spark, sf_dir))


@_query(_vc() + _TYPES + " SELECT split_part(col, '.', 1) AS table_name, round(1 - sum(nulls) / sum(n), 4) AS completeness, max(round(ratio, 4)) AS uniqueness, round(avg(conf), 4) AS validity, CAST(1 AS DOUBLE) AS consistency, round(count(*) FILTER (WHERE d <> 1) / count(*), 4) AS conformity, round(count(*) FILTER (WHERE d <> 1) / count(*), 4) AS variety FROM pr GROUP BY 1")
def chart_quality_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.quality_scorecard(_light(spark, sf_dir))


@_query(_FLAG_SQL + " SELECT 'orders' AS table_name, " + ", ".join(f"count(*) FILTER (WHERE flag = '{x}') AS {x}" for x in sorted({f for _, f in _FLAGS})) + " FROM f")
def chart_quality_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.quality_heatmap(profile.column_profiles(_flawed(spark, sf_dir), "orders"))


@_query()
def column_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole profile of a table (no SQL twin: its parts have theirs)."""
    return profile.column_profiles(_read(spark, sf_dir, "lineitem"), "lineitem")


@_query()
def table_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_profile(profile.column_profiles(_read(spark, sf_dir, "orders"), "orders"), path=f"{sf_dir}/orders.parquet")


@_query()
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.context_lines(profile.column_profiles(_read(spark, sf_dir, "customer"), "customer"))
