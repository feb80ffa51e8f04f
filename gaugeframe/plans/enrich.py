"""Texts about tables and columns, from templates; a language model can be plugged in as a callable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators.relationships import edge_index


def column_priority() -> Column:
    """0 for keys, 1 for names that look like references, 2 for columns with a flag, 3 for the rest."""
    return F.when(F.col("is_key_candidate"), 0).when(F.lower("name").endswith("id"), 1).when(F.size("quality_flags") > 0, 2).otherwise(3)


def _listed(c: Column, n: int) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.slice(c, 1, n), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def context_lines(p: DataFrame) -> DataFrame:
    """(table_name, ordinal, priority, line): full lines for columns up to priority 2, short ones for the rest."""
    pri = column_priority()
    said = lambda c: F.when(c, "True").otherwise("False")
    flags = F.when(F.size("quality_flags") > 0, F.array_join("quality_flags", ", ")).otherwise("none")
    samples = F.when(F.size("sample_values") > 0, F.concat(F.lit(", samples="), _listed(F.col("sample_values"), 5))).otherwise("")
    top = F.when(F.size("top_values") > 0, F.concat(F.lit(", top_values="), _listed(F.transform("top_values", lambda t: t["value"]), 3))).otherwise("")
    full = F.concat(F.lit("  - "), "name", F.lit(": type="), "inferred_type", F.lit(", nulls="), "null_count", F.lit(", distinct="), "distinct_count", F.lit(", key_candidate="), said(F.col("is_key_candidate")), F.lit(", quality=["), flags, F.lit("]"), samples, top)
    few = F.when(F.size("sample_values") > 0, F.concat(F.lit(", samples="), _listed(F.col("sample_values"), 3))).otherwise("")
    short = F.concat(F.lit("  - "), "name", F.lit(": "), "inferred_type", F.when(F.col("null_count") > 0, F.concat(F.lit(", nulls="), "null_count")).otherwise(""), F.lit(", distinct="), "distinct_count", few)
    return p.select("table_name", "ordinal", pri.alias("priority"), F.when(pri <= 2, full).otherwise(short).alias("line"))


def table_contexts(p: DataFrame) -> DataFrame:
    """(table_name, context): a table's header and its columns by priority."""
    rows = p.groupBy("table_name").agg(F.max("row_count").alias("n"), F.count("*").alias("c"))
    body = context_lines(p).groupBy("table_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("priority", "ordinal", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return rows.join(body, "table_name").select("table_name", F.concat(F.lit("Table: "), "table_name", F.lit("\nRows: "), "n", F.lit(", Columns: "), "c", F.lit("\n"), "body").alias("context"))


def fallback_summaries(p: DataFrame) -> DataFrame:
    """(table_name, summary) without a model."""
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]), ", ")
    x = p.groupBy("table_name").agg(F.max("row_count").alias("n"), F.count("*").alias("c"), names.alias("names"))
    return x.select("table_name", F.concat(F.lit("Table "), "table_name", F.lit(" has "), "n", F.lit(" rows and "), "c", F.lit(" columns. Columns: "), "names", F.lit(".")).alias("summary"))


def summaries(p: DataFrame, model: Callable[[str], str] | None = None) -> DataFrame:
    """(table_name, summary): by the model where one is given and answers, else by the template."""
    plain = fallback_summaries(p)
    if model is None:
        return plain
    answer = F.udf(lambda text: _asked(model, text), "string")  # a call to a service for each table, not for each row
    told = table_contexts(p).select("table_name", answer("context").alias("told"))
    return plain.join(told, "table_name").select("table_name", F.coalesce("told", "summary").alias("summary"))


def _asked(model: Callable[[str], str], text: str) -> str | None:
    try:
        return model(text)
    except Exception:
        return None


def column_documents(p: DataFrame) -> DataFrame:
    """(doc_type, table_name, column_name, content): the text that a column is embedded by."""
    role = F.when(F.col("is_key_candidate"), "PK").otherwise("regular")
    top = F.when(F.size("top_values") > 0, F.concat(F.lit("top_values=["), F.array_join(F.slice(F.transform("top_values", lambda t: t["value"]), 1, 3), ", "), F.lit("]")))
    some = F.when(F.size("sample_values") > 0, F.concat(F.lit("samples=["), F.array_join(F.slice("sample_values", 1, 5), ", "), F.lit("]")))
    extra = F.concat_ws("; ", F.concat(F.lit("distinct="), "distinct_count"), F.when(F.col("is_key_candidate"), "key_candidate=True"), F.concat(F.lit("cardinality="), "cardinality"), some, top)
    desc = F.coalesce("description", F.concat(F.lit("Column '"), "name", F.lit("' of type "), "inferred_type"))
    text = F.concat(F.lit("Table: "), "table_name", F.lit(", Column: "), "name", F.lit(", Type: "), "inferred_type", F.lit(", Role: "), role, F.lit(". "), desc, F.lit(" | "), extra)
    return p.select(F.lit("column_description").alias("doc_type"), "table_name", F.col("name").alias("column_name"), text.alias("content"))


def relationship_documents(found: DataFrame, most: int = 20) -> DataFrame:
    """(table_name, outgoing_count, incoming_count, content): a table's references in both directions, the surest first."""
    e = edge_index(found)
    sure = F.format_string("%.2f", F.col("confidence"))
    out = F.concat(F.lit("    "), "column", F.lit(" -> "), "other_table", F.lit("."), "other_column", F.lit(" (confidence="), sure, F.lit(")"))
    into = F.concat(F.lit("    "), "other_table", F.lit("."), "other_column", F.lit(" -> "), "column", F.lit(" (confidence="), sure, F.lit(")"))
    line = F.when(F.col("direction") == "outgoing", out).otherwise(into)
    packed = lambda d: F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct((-F.col("confidence")).alias("c"), line.alias("l")))))
    x = e.groupBy("table_name").agg(packed("outgoing").alias("o"), packed("incoming").alias("i"))
    part = lambda c, title: F.when(F.size(c) > 0, F.concat_ws("\n", F.concat(F.lit(f"  {title} ("), F.size(c).cast("string"), F.lit("):")), F.array_join(F.transform(F.slice(c, 1, most), lambda v: v["l"]), "\n"), F.when(F.size(c) > most, F.concat(F.lit("    ... and "), (F.size(c) - most).cast("string"), F.lit(" more")))))
    text = F.concat_ws("\n", F.concat(F.lit("Table "), "table_name", F.lit(" relationships:")), part("o", "Outgoing FKs"), part("i", "Incoming FKs"))
    return x.select("table_name", F.size("o").cast("long").alias("outgoing_count"), F.size("i").cast("long").alias("incoming_count"), text.alias("content"))
