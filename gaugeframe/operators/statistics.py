"""Statistics of columns, each as one aggregate over counted values (or over rows, for moments)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.functions import semantic as M
from gaugeframe.operators.columns import KEY
from gaugeframe.settings import DEFAULT, LENGTH_TYPES, NO_RANGE, NOT_A_KEY, NUMERIC, Settings

SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


def weighted(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, F.col("cnt"))), F.lit(0)).cast("long")


def counts(vc: DataFrame) -> DataFrame:
    """rows, null_count and distinct_count per column."""
    return vc.groupBy(*KEY).agg(F.sum("cnt").cast("long").alias("row_count"), weighted(F.col("value").isNull()).alias("null_count"), F.count("value").cast("long").alias("distinct_count"))


def inferred(vc: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """inferred_type, confidence_score, format_variants and flags per column, from one pass over its counted values."""
    label, stamp = F.col("__label"), F.col("__stamp")
    x = vc.withColumn("__label", M.date_label(F.col("value"))).withColumn("__stamp", M.timestamp_kind(F.col("value")))
    share = lambda c: weighted(c) / F.sum(F.when(F.col("value").isNotNull(), F.col("cnt")))
    per = x.groupBy(*KEY).agg(
        F.count("value").alias("d"),
        share(M.is_bool(F.col("value"))).alias("b"), share(label.isNotNull()).alias("dt"), share(stamp.isNotNull()).alias("ts"),
        share(M.is_integer(F.col("value"))).alias("i"), share(M.is_float(F.col("value"))).alias("f"), share(M.is_uuid(F.col("value"))).alias("u"),
        F.sort_array(F.collect_set(label)).alias("labels"), weighted(stamp == "aware").alias("aware"), weighted(stamp == "naive").alias("naive"),
        (F.sum(F.char_length(F.col("value")) * F.col("cnt")) / F.sum(F.when(F.col("value").isNotNull(), F.col("cnt")))).alias("length"),
        weighted(F.col("value").isNotNull() & M.number(F.col("value")).isNull()).alias("not_numbers"),
    )
    ok = lambda c: F.col(c) >= s.match_threshold
    mixed = F.size("labels") > 1
    kind = (
        F.when(F.col("d") == 0, "NULL_ONLY").when(ok("b"), "BOOLEAN").when(ok("dt"), F.when(mixed, "MIXED_DATE").otherwise("DATE"))
        .when(ok("ts"), "TIMESTAMP").when(ok("i"), "INTEGER").when(ok("f"), "FLOAT").when(ok("u"), "UUID")
        .when(F.col("d") < s.categorical_max_distinct, "CATEGORICAL").when(F.col("length") >= s.free_text_min_length, "FREE_TEXT").otherwise("STRING")
    )
    sure = F.when(ok("b"), F.col("b")).when(ok("dt"), F.col("dt")).when(ok("ts"), F.col("ts")).when(ok("i"), F.col("i")).when(ok("f"), F.col("f")).when(ok("u"), F.col("u")).otherwise(1.0)
    out = per.withColumn("inferred_type", kind).withColumn("confidence_score", sure.cast("double"))
    is_a = lambda t: F.col("inferred_type") == t
    flags = F.array_compact(F.array(F.when(is_a("MIXED_DATE"), F.lit("MIXED_DATE_FORMATS")), F.when(is_a("TIMESTAMP") & (F.col("aware") > 0) & (F.col("naive") > 0), F.lit("MIXED_TIMEZONES"))))
    variants = F.when(is_a("MIXED_DATE"), F.col("labels")).otherwise(F.array().cast("array<string>"))
    numeric = F.col("inferred_type").isin(*NUMERIC) & (F.col("not_numbers") == 0)
    return out.select(*KEY, "inferred_type", "confidence_score", variants.alias("format_variants"), flags.alias("type_flags"), numeric.alias("is_numeric"))


def basics(vc: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Counts, ratio, cardinality and the flags of a column; needs no type."""
    c = counts(vc)
    rows, d, nulls = F.col("row_count"), F.col("distinct_count"), F.col("null_count")
    ratio = F.when(rows > 0, d / rows).otherwise(0.0)
    size = F.when(ratio > s.high_cardinality, "HIGH").when(ratio > s.low_cardinality, "MEDIUM").otherwise("LOW")
    return c.select(
        *KEY, "row_count", "null_count", "distinct_count", F.lit(True).alias("is_distinct_count_exact"),
        ratio.alias("ratio"), F.round(ratio, 4).alias("unique_ratio"), size.alias("cardinality"), (nulls > 0).alias("is_nullable"),
        (d == 1).alias("is_constant"), (nulls / F.greatest(rows, F.lit(1)) > s.sparse_ratio).alias("is_sparse"), (size == "LOW").alias("is_low_cardinality"),
    )


def key_candidate(s: Settings = DEFAULT) -> Column:
    return (F.col("ratio") >= s.key_ratio) & (F.col("null_count") == 0) & ~F.col("inferred_type").isin(*NOT_A_KEY)


def ranges(vc: DataFrame, types: DataFrame) -> DataFrame:
    """min and max as text: by value for numbers, by bytes for other text, none for types without an order."""
    from gaugeframe.functions.text import float_text

    x = vc.join(F.broadcast(types.select(*KEY, "inferred_type", "is_numeric")), list(KEY))
    num = M.number(F.col("value"))
    per = x.groupBy(*KEY, "inferred_type", "is_numeric").agg(F.min(num).alias("a"), F.max(num).alias("b"), F.min("value").alias("low"), F.max("value").alias("high"))
    pick = lambda n, t: F.when(F.col("is_numeric"), float_text(F.col(n))).when(~F.col("inferred_type").isin(*NO_RANGE), F.col(t))
    return per.select(*KEY, pick("a", "low").alias("min"), pick("b", "high").alias("max"))


def _rounded(c: Column) -> Column:
    return F.round(c, 4)


def moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """mean, variance, std_dev, skewness, kurtosis and coefficient_of_variation of numeric-typed columns, in one pass.

    Population skewness, excess population kurtosis, sample variance; null under three values, skewness zero and
    kurtosis null without spread.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and (columns is None or f.name in columns)]
    if not names:
        return df.sparkSession.createDataFrame([], "ordinal int, column string, mean double, variance double, std_dev double, skewness double, kurtosis double, coefficient_of_variation double")
    at = {n: i for i, n in enumerate(df.columns)}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    cell = lambda n: F.col(f"c{at[n]}").cast("double")
    packed = [F.struct(F.count(cell(n)).alias("n"), F.avg(cell(n)).alias("m"), F.var_samp(cell(n)).alias("v"), F.stddev_pop(cell(n)).alias("p"), F.skewness(cell(n)).alias("s"), F.kurtosis(cell(n)).alias("k")).alias(f"x{at[n]}") for n in names]
    one = plain.agg(*packed)
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(at[n]).alias("ordinal"), F.lit(n).alias("column"), F.col(f"x{at[n]}").alias("x")) for n in names])))
    enough = lambda c, n=3: F.when(F.col("x.n") >= n, c)
    m, v = F.col("x.m"), F.col("x.v")
    return rows.select(
        *KEY, enough(_rounded(m)).alias("mean"), enough(_rounded(v)).alias("variance"), enough(_rounded(F.sqrt(v))).alias("std_dev"),
        enough(F.when(F.col("x.p") == 0, 0.0).otherwise(_rounded(F.col("x.s")))).alias("skewness"),
        enough(F.when(F.col("x.p") > 0, _rounded(F.col("x.k"))), 4).alias("kurtosis"),
        enough(F.when(m != 0, _rounded(F.sqrt(v) / F.abs(m)))).alias("coefficient_of_variation"),
    )


def text_moments(vc: DataFrame, numeric: DataFrame) -> DataFrame:
    """moments() from counted text: deviations from each column's mean, weighted by counts (two passes, no power sums)."""
    x = vc.join(F.broadcast(numeric.where("is_numeric").select(*KEY)), list(KEY)).where(F.col("value").isNotNull()).withColumn("x", M.number(F.col("value")))
    mean = x.groupBy(*KEY).agg(F.sum("cnt").alias("n"), (F.sum(F.col("x") * F.col("cnt")) / F.sum("cnt")).alias("m"))
    d = F.col("x") - F.col("m")
    power = lambda k: F.sum(F.pow(d, F.lit(k)) * F.col("cnt"))
    y = x.join(F.broadcast(mean), list(KEY)).groupBy(*KEY, "n", "m").agg(power(2).alias("s2"), power(3).alias("s3"), power(4).alias("s4"))
    n, m = F.col("n"), F.col("m")
    pop, v = F.col("s2") / n, F.try_divide(F.col("s2"), n - 1)
    enough = lambda c, k=3: F.when(n >= k, c)
    return y.select(
        *KEY, enough(_rounded(m)).alias("mean"), enough(_rounded(v)).alias("variance"), enough(_rounded(F.sqrt(v))).alias("std_dev"),
        enough(F.when(pop == 0, 0.0).otherwise(_rounded(F.try_divide(F.col("s3") / n, F.pow(pop, F.lit(1.5)))))).alias("skewness"),
        enough(F.when(pop > 0, _rounded(F.try_divide(F.col("s4") / n, pop * pop) - 3)), 4).alias("kurtosis"),
        enough(F.when(m != 0, _rounded(F.sqrt(v) / F.abs(m)))).alias("coefficient_of_variation"),
    )


def _ranked(x: DataFrame) -> DataFrame:
    """(n, p) of SHARES per column as F.percentile has them, by sorted counts: no task holds all values of a column."""
    once = x.groupBy(*KEY, "x").agg(F.sum("cnt").alias("c"))
    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = once.repartitionByRange(parts, *KEY, "x").withColumn("part", F.spark_partition_id()).persist()
    sums = dealt.groupBy(*KEY, "part").agg(F.sum("c").alias("s")).collect()
    before, total = [], {}
    for r in sorted(sums, key=lambda r: r["part"]):
        key = (r["ordinal"], r["column"])
        before.append((*key, r["part"], total.get(key, 0)))
        total[key] = total.get(key, 0) + r["s"]
    spark, fields = x.sparkSession, dealt.select(*KEY, "part").schema
    heads = spark.createDataFrame(before, T.StructType([*fields, T.StructField("before", T.LongType())]))
    sizes = spark.createDataFrame([(*k, n) for k, n in total.items()], T.StructType([*fields[:2], T.StructField("n", T.LongType())]))
    share = F.posexplode(F.array(*[F.lit(p) for p in SHARES])).alias("k", "share")
    asked = sizes.select(*KEY, "n", share).withColumn("at", F.col("share") * (F.col("n") - 1))
    own = Window.partitionBy("part", *KEY).orderBy("x")
    ends = dealt.join(F.broadcast(heads), [*KEY, "part"]).withColumn("end", F.col("before") + F.sum("c").over(own)).withColumn("start", F.col("end") - F.col("c"))
    holds = lambda f: (F.col("start") <= f("at")) & (f("at") < F.col("end"))
    met = ends.join(F.broadcast(asked), list(KEY)).where(holds(F.floor) | holds(F.ceil))
    per = met.groupBy(*KEY, "n", "k", "at").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    low, high = F.floor("at"), F.ceil("at")
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((high - F.col("at")) * F.col("a") + (F.col("at") - low) * F.col("b"))
    out = per.groupBy(*KEY, "n").agg(F.sort_array(F.collect_list(F.struct("k", value.alias("v")))).alias("p"))
    rows = out.select(*KEY, "n", F.transform("p", lambda t: t["v"]).alias("p"))
    found = spark.createDataFrame(rows.collect(), rows.schema)
    dealt.unpersist()
    return found


def percentiles(vc: DataFrame, numeric: DataFrame, held: bool = True) -> DataFrame:
    """p5, p25, median, p75, p95 and iqr by linear interpolation, from counted values; exact either way.

    If held, a column's distinct values are held at once; the caller says no above exact_distinct_rows.
    """
    x = vc.join(F.broadcast(numeric.where("is_numeric").select(*KEY)), list(KEY)).where(F.col("value").isNotNull()).withColumn("x", M.number(F.col("value")))
    if held:
        per = x.groupBy(*KEY).agg(F.sum("cnt").alias("n"), F.percentile("x", F.array(*[F.lit(p) for p in SHARES]), F.col("cnt")).alias("p"))
    else:
        per = _ranked(x)
    at = lambda k: F.when(F.col("n") >= 3, F.col("p")[k])
    low, high = at(1), at(3)
    return per.select(
        *KEY, _rounded(at(0)).alias("p5"), _rounded(low).alias("p25"), _rounded(at(2)).alias("median"), _rounded(high).alias("p75"), _rounded(at(4)).alias("p95"),
        _rounded(high - low).alias("iqr"), (low - 1.5 * _rounded(high - low)).alias("low_fence"), (high + 1.5 * _rounded(high - low)).alias("high_fence"),
    )


def outliers(vc: DataFrame, fences: DataFrame) -> DataFrame:
    """Values beyond one and a half interquartile ranges from the quartiles."""
    x = vc.where(F.col("value").isNotNull()).join(F.broadcast(fences.where("low_fence is not null").select(*KEY, "low_fence", "high_fence")), list(KEY))
    num = M.number(F.col("value"))
    return x.groupBy(*KEY).agg(weighted((num < F.col("low_fence")) | (num > F.col("high_fence"))).alias("outlier_count"))


def lengths(vc: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """avg_length of all columns; deciles and maximum of the lengths of textual ones."""
    size = F.char_length(F.col("value"))
    x = vc.where(F.col("value").isNotNull()).groupBy(*KEY, size.alias("size")).agg(F.sum("cnt").alias("cnt"))
    per = x.groupBy(*KEY).agg((F.sum(F.col("size") * F.col("cnt")) / F.sum("cnt")).alias("mean"), F.percentile("size", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), F.col("cnt")).alias("p"), F.max("size").alias("most"))
    textual = F.lit(True)
    if types is not None:
        per, textual = per.join(F.broadcast(types.select(*KEY, "inferred_type")), list(KEY)), F.col("inferred_type").isin(*LENGTH_TYPES)
    at = lambda k: F.when(textual, F.round(F.col("p")[k], 2))
    return per.select(*KEY, F.round("mean", 2).alias("avg_length"), at(0).alias("length_p10"), at(1).alias("length_p50"), at(2).alias("length_p90"), F.when(textual, F.col("most")).alias("length_max"))


def top_values(vc: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(ordinal, column, rank, value, count): the most frequent values, ties by value."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("cnt"), "value")
    ranked = vc.where(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.top_values)
    return ranked.select(*KEY, "rank", "value", F.col("cnt").cast("long").alias("count"))


def sample_values(vc: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(ordinal, column, rank, value): the smallest distinct values, the same on every run."""
    order = Window.partitionBy(*KEY).orderBy("value")
    return vc.where(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.sample_values).select(*KEY, "rank", "value")
