"""Foreign-key candidates between tables, scored from column profiles.

Scores are integer hundredths until the output. The pairing is a theta join of two profile tables, whose sizes are the
numbers of columns of a database, not of rows; the key side is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.settings import AUDIT_COLUMNS, DEFAULT, ID_TYPES, NOT_RELATED, NUMERIC, Settings

BROKEN = ("FULLY_NULL", "STRUCTURAL_CORRUPTION")
#: Columns of all profiled tables up to which the key side of the pairing is broadcast.
BROADCAST_COLUMNS = 200_000


def id_named(c: Column) -> Column:
    low = F.lower(c)
    return low.endswith("id") | low.isin("id", "key", "code")


def _sound() -> Column:
    return ~F.arrays_overlap("quality_flags", F.array(*[F.lit(x) for x in BROKEN])) & ~F.col("inferred_type").isin(*NOT_RELATED)


def key_columns(profiles: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Columns that may be referenced: unique, nearly so, or named like an id."""
    clean = F.col("null_count") == 0
    unique = F.col("is_key_candidate") | (F.col("unique_ratio") >= s.near_key_ratio) & clean
    return profiles.where(_sound() & (unique | id_named(F.col("name")) & clean & (F.col("distinct_count") > 1)))


def reference_columns(profiles: DataFrame) -> DataFrame:
    """Columns that may reference: sound and not themselves keys."""
    return profiles.where(_sound() & ~F.col("is_key_candidate"))


def _side(df: DataFrame, p: str) -> DataFrame:
    top = F.transform("top_values", lambda t: t["value"]).alias(f"{p}_top")
    return df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("table_name", "name", "inferred_type", "null_count", "row_count", "distinct_count", "unique_ratio", "is_key_candidate")], top)


def _name(s: Settings) -> tuple[Column, Column]:
    fk, pk, table = F.col("fk_name"), F.col("pk_name"), F.col("pk_table_name")
    stem = F.rtrim(table, F.lit("s"))
    long = F.char_length(stem) >= s.min_stem
    cases = [
        (long & (fk == F.concat_ws("_", table, pk)), 50, "name:direct_prefix"),
        (long & (fk == F.concat_ws("_", stem, pk)), 45, "name:singular_prefix"),
        (fk == pk, 40, "name:exact"),
        (long & fk.endswith(F.concat(F.lit("_"), pk)) & fk.contains(stem), 35, "name:embedded"),
    ]
    score, why = F, F
    for test, points, code in cases:
        score, why = score.when(test, points), why.when(test, code)
    return score.otherwise(0), why


def _kind() -> tuple[Column, Column]:
    a, b = F.col("fk_inferred_type"), F.col("pk_inferred_type")
    numeric, ids = a.isin(*NUMERIC) & b.isin(*NUMERIC), a.isin(*ID_TYPES) & b.isin(*ID_TYPES)
    score = F.when(a == b, 20).when(numeric, 10).when(ids, 5).otherwise(0)
    return score, F.when(a == b, "type:exact").when(numeric, "type:numeric_compat").when(ids, "type:string_compat")


def pairs(profiles: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Every pair of a reference and a key column of different tables with a name hint or compatible types, with scores."""
    keys = _side(key_columns(profiles, s), "pk")
    if keys.limit(BROADCAST_COLUMNS + 1).count() <= BROADCAST_COLUMNS:
        keys = F.broadcast(keys)
    (name, name_code), (kind, kind_code) = _name(s), _kind()
    x = _side(reference_columns(profiles), "fk").join(keys, (F.col("fk_table_name") != F.col("pk_table_name")) & ((name > 0) | (kind > 0)))
    near, soft = F.col("pk_unique_ratio") >= s.near_key_ratio, id_named(F.col("pk_name")) & (F.col("pk_null_count") == 0) & (F.col("pk_distinct_count") > 1)
    unique = F.when(F.col("pk_is_key_candidate"), 20).when(near, 15).when(soft, 10).otherwise(0)
    unique_code = F.when(F.col("pk_is_key_candidate"), "pk:key_candidate").when(near, "pk:high_unique").when(soft, "pk:soft_id")
    subset = F.col("fk_distinct_count") <= F.col("pk_distinct_count")
    overlap = F.when((F.size("fk_top") > 0) & (F.size("pk_top") > 0), F.size(F.array_intersect("fk_top", "pk_top")) / F.size(F.array_distinct("fk_top")))
    shared = F.when(overlap >= 0.8, 15).when(overlap >= 0.5, 10).otherwise(0)
    codes = F.array_compact(F.array(name_code, kind_code, unique_code, F.when(subset, "cardinality:fk_subset"), F.when(overlap >= 0.8, "overlap:high").when(overlap >= 0.5, "overlap:medium")))
    score = F.least(F.lit(100), name + kind + unique + F.when(subset, 5).otherwise(0) + shared)
    return x.select(
        F.col("fk_table_name").alias("fk_table"), F.col("fk_name").alias("fk_column"), F.col("pk_table_name").alias("pk_table"), F.col("pk_name").alias("pk_column"),
        score.cast("int").alias("score_pct"), codes.alias("evidence"),
        F.when(F.col("fk_row_count") > 0, F.round(F.col("fk_null_count") / F.col("fk_row_count"), 4)).otherwise(0.0).alias("fk_null_ratio"),
        "fk_distinct_count", "pk_distinct_count", overlap.alias("top_value_overlap_pct"),
    )


def candidates(profiles: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Pairs that reach the threshold, with confidence from 0 to 1."""
    x = pairs(profiles, s).where(F.col("score_pct") >= s.fk_min_percent).withColumn("confidence", F.col("score_pct") / 100)
    return x.select("fk_table", "fk_column", "pk_table", "pk_column", "confidence", "evidence", "fk_null_ratio", "fk_distinct_count", "pk_distinct_count", "top_value_overlap_pct")


def containment(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Exact containment of a reference column: distinct values, those found in the key, rows without a parent."""
    values = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("v")).agg(F.count("*").alias("rows"))
    keys = parent.select(F.col(pk).alias("v")).where("v is not null").distinct().withColumn("found", F.lit(True))
    x = values.join(keys, "v", "left")
    found = F.coalesce("found", F.lit(False))
    return x.agg(F.count("*").cast("long").alias("fk_values"), F.count_if(found).cast("long").alias("found_values"), F.coalesce(F.sum(F.when(~found, F.col("rows"))), F.lit(0)).cast("long").alias("orphan_rows"))


def is_audit(c: Column) -> Column:
    return F.lower(c).isin(*AUDIT_COLUMNS)


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge for each reference column, ties to the table its name stems from, and one of two opposite edges."""
    stem = F.replace(F.replace(F.lower("fk_column"), F.lit("_id"), F.lit("")), F.lit("id"), F.lit(""))
    own = Window.partitionBy("fk_table", "fk_column").orderBy(F.desc("confidence"), F.desc((stem == F.lower("pk_table")).cast("int")), "pk_table", "pk_column")
    best = edges.withColumn("r", F.row_number().over(own)).where("r = 1").drop("r")
    end = lambda p: F.struct(F.col(f"{p}_table").alias("t"), F.col(f"{p}_column").alias("c"))
    a, b = end("fk"), end("pk")
    both = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(F.desc("confidence"), "fk_table", "fk_column")
    return best.withColumn("r", F.row_number().over(both)).where("r = 1").drop("r")


def domain_edges(found: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return best_edges(found.where(~is_audit(F.col("fk_column")) & (F.col("confidence") * 100 >= s.diagram_min_percent)))


def audit_edges(found: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return best_edges(found.where(is_audit(F.col("fk_column")) & (F.col("confidence") * 100 >= s.fk_min_percent)))


def audit_summary(edges: DataFrame) -> DataFrame:
    key = F.concat_ws(".", "pk_table", "pk_column").alias("pk")
    return edges.groupBy(key).agg(F.count("*").cast("long").alias("tables"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(".", "fk_table", "fk_column"))), ", ").alias("references"))


def of_table(found: DataFrame, table: str) -> DataFrame:
    """Edges that touch a table, with their direction seen from it and the table at the other end."""
    out = F.col("fk_table") == table
    x = found.where(out | (F.col("pk_table") == table))
    return x.withColumn("direction", F.when(out, "outgoing").otherwise("incoming")).withColumn("related_table", F.when(out, F.col("pk_table")).otherwise(F.col("fk_table")))


def edge_index(found: DataFrame) -> DataFrame:
    """Each edge from both ends: (table_name, direction, column, other_table, other_column, confidence)."""
    side = lambda a, b, d: found.select(F.col(f"{a}_table").alias("table_name"), F.lit(d).alias("direction"), F.col(f"{a}_column").alias("column"), F.col(f"{b}_table").alias("other_table"), F.col(f"{b}_column").alias("other_column"), "confidence")
    return side("fk", "pk", "outgoing").unionByName(side("pk", "fk", "incoming"))
