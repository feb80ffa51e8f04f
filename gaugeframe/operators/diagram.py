"""Entity-relationship diagrams as text, built from profiles and edges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.operators import relationships
from gaugeframe.settings import DEFAULT, TYPE_LABELS, Settings


def safe(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def type_label(c: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair])
    return F.coalesce(F.element_at(labels, c), F.lit("string"))


def entity_lines(profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """(table_name, ordinal, line) of the columns of tables that an edge touches, marked PK or FK."""
    tables = edges.select(F.col("fk_table").alias("table_name")).union(edges.select("pk_table")).distinct()
    refs = edges.select(F.col("fk_table").alias("table_name"), F.col("fk_column").alias("name")).distinct().withColumn("is_fk", F.lit(True))
    x = profiles.join(tables, "table_name", "left_semi").join(refs, ["table_name", "name"], "left")
    mark = F.when(F.col("is_fk"), " FK").when(F.col("is_key_candidate"), " PK").otherwise("")
    return x.select("table_name", "ordinal", F.concat(type_label(F.col("inferred_type")), F.lit(" "), safe(F.col("name")), mark).alias("line"))


def entities(profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """(table_name, block): each touched table's block."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "line"))), lambda x: F.concat(F.lit("        "), x["line"]))
    body = entity_lines(profiles, edges).groupBy("table_name").agg(F.array_join(lines, "\n").alias("body"))
    return body.select("table_name", F.concat(F.lit("    "), safe(F.col("table_name")), F.lit(" {\n"), "body", F.lit("\n    }")).alias("block"))


def edge_lines(edges: DataFrame) -> DataFrame:
    """(confidence, pk_table, line): one line for each edge."""
    line = F.concat(F.lit("    "), safe(F.col("pk_table")), F.lit(" ||--o{ "), safe(F.col("fk_table")), F.lit(' : "'), "fk_column", F.lit(" -> "), "pk_column", F.lit('"'))
    return edges.select("confidence", "pk_table", line.alias("line"))


def diagram(profiles: DataFrame, found: DataFrame, s: Settings = DEFAULT) -> str:
    """The whole diagram; audit references are listed below it. Sizes are those of a schema, so it is put together here."""
    edges, audit = relationships.domain_edges(found, s).persist(), relationships.audit_edges(found, s)
    blocks = [r["block"] for r in entities(profiles, edges).orderBy("table_name").collect()]
    arrows = [r["line"] for r in edge_lines(edges).orderBy(F.desc("confidence"), "pk_table", "line").collect()]
    out = ["```mermaid", "erDiagram", *blocks, "", *arrows, "```"]
    notes = relationships.audit_summary(audit).orderBy("pk").collect()
    if notes:
        out += ["", "### Audit FK Relationships", ""]
    for r in notes:
        out += [f"**{r['pk']}** ← {r['tables']} tables:", *[f"  - `{x}`" for x in r["references"].split(", ")], ""]
    return "\n".join(out) + "\n"


def last_diagram(markdown: str) -> str | None:
    """The last erDiagram block of some markdown."""
    found = re.findall(r"```(?:mermaid)?\s*(erDiagram.*?)```", markdown, re.S)
    return found[-1].strip() if found else None


def last_diagram_of(c: Column) -> Column:
    found = F.regexp_extract_all(c, F.lit("(?s)```(?:mermaid)?\\s*(erDiagram.*?)```"), 1)
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))
