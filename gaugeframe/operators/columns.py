"""The long form of a table, and the counts of its standardised values: the frame all value statistics come from.

A table is unpivoted and aggregated to (ordinal, column, value, cnt) once. What follows (distinct counts, type ratios,
lengths, percentiles, top values) works on these counts with weights, so a low-cardinality column costs next to nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.functions import text as X
from gaugeframe.settings import DEFAULT, Settings

KEY = ("ordinal", "column")


def long_form(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ordinal, column, value): each cell as canonical text; names with dots or repeats are safe."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    wanted = [i for i, n in enumerate(names) if columns is None or n in columns]
    cells = [F.struct(F.lit(i).alias("ordinal"), F.lit(names[i]).alias("column"), X.as_text(F.col(f"c{i}"), plain.schema[i].dataType).alias("value")) for i in wanted]
    return plain.select(F.inline(F.array(*cells)))


def raw_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ordinal, column, value, cnt) of a table's cells as canonical text, null values in a row of their own.

    Cells are counted as what they are, whole numbers as longs, one aggregate for each kind of column; only distinct values
    are rendered as text. Minus zero counts as zero.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    kinds: dict[str, tuple[T.DataType, list[Column]]] = {}
    for i, f in enumerate(plain.schema):
        if columns is None or names[i] in columns:
            kind, cell = f.dataType, F.col(f"c{i}")
            if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
                kind, cell = T.LongType(), cell.cast("long")
            elif not isinstance(kind, (T.LongType, T.DoubleType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)):
                kind, cell = T.StringType(), X.as_text(cell, kind)
            kinds.setdefault(kind.simpleString(), (kind, []))[1].append(F.struct(F.lit(i).alias("ordinal"), cell.alias("value")))
    if not kinds:
        return df.sparkSession.createDataFrame([], "ordinal int, column string, value string, cnt bigint")
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("ordinal") + 1).alias("column")
    parts = [
        plain.select(F.inline(F.array(*cells))).groupBy("ordinal", "value").agg(F.count("*").alias("cnt")).select("ordinal", named, X.as_text(F.col("value"), kind).alias("value"), "cnt")
        for kind, cells in kinds.values()
    ]
    return reduce(DataFrame.union, parts)


def value_counts(raw: DataFrame, standardise: bool = True, s: Settings = DEFAULT) -> DataFrame:
    """Counted values, standardised if asked, and counted together where that makes them equal."""
    if not standardise:
        return raw.withColumn("value", F.when(X.trimmed(F.col("value")) != "", F.col("value"))).groupBy(*KEY, "value").agg(F.sum("cnt").alias("cnt"))
    return standardised(raw, s).groupBy(*KEY, F.col("new").alias("value")).agg(F.sum("cnt").alias("cnt"))


def standardised(raw: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds `new`, the standard form of each counted value, and the forms on the way (`cut`, `known`, `truth`)."""
    cut = X.trimmed(F.col("value"))
    full = F.coalesce(F.when(cut != "", F.col("cnt")), F.lit(0))
    hit = F.coalesce(F.when((cut != "") & X.is_bool(cut), F.col("cnt")), F.lit(0))
    per = raw.groupBy(*KEY).agg(F.sum(full).alias("__full"), F.sum(hit).alias("__hits"))  # as many rows as columns
    mostly = per.where((F.col("__full") > 0) & (F.col("__hits") >= s.match_threshold * F.col("__full"))).select(*KEY, F.lit(True).alias("__mostly"))
    known = X.without_null_tokens(F.col("value"))
    truth: Column = F.when(F.col("__mostly"), X.bool_text(F.col("known"))).otherwise(F.col("known"))
    out = raw.join(F.broadcast(mostly), list(KEY), "left").withColumn("cut", cut).withColumn("known", known).withColumn("truth", truth)
    return out.withColumn("new", X.numeric_text(F.col("truth"))).drop("__mostly")


def report(raw: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Per column how many cells standardising changed, by cause."""
    x = standardised(raw, s)
    changed = lambda c: F.sum(F.when(c, F.col("cnt")).otherwise(0)).cast("long")
    return x.groupBy(*KEY).agg(
        changed(F.col("value").isNotNull() & F.col("known").isNull()).alias("nulls_normalized"),
        changed(F.col("value") != F.col("cut")).alias("whitespace_trimmed"),
        changed(F.col("truth") != F.col("known")).alias("booleans_normalized"),
        changed(F.col("new") != F.col("truth")).alias("numerics_cleaned"),
    )


def renamed(df: DataFrame) -> DataFrame:
    """df with standard column names."""
    return df.toDF(*X.standard_names(df.columns))
