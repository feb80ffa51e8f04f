"""JSON files: shape, union schema with occurrences and type conflicts, and rows with nested keys flattened."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.settings import DEFAULT, Settings
from gaugeframe.sources.intake import Intake


def depth(value: object) -> int:
    """Levels of objects within a value: 0 for a scalar, 1 for an object of scalars."""
    if isinstance(value, dict):
        return 1 + max(map(depth, value.values()), default=0)
    if isinstance(value, list):
        return max(map(depth, value), default=0)
    return 0


def shape(x: Intake) -> str:
    """SINGLE_OBJECT, ARRAY_OF_OBJECTS, NDJSON or DEEP_NESTED, from the window."""
    text = x.head.decode(x.encoding, errors="replace").lstrip("\ufeff \t\r\n")
    found = []
    for line in text.splitlines():
        try:
            found.append(json.loads(line))
        except ValueError:
            break
    if text.startswith("["):
        kind = "ARRAY_OF_OBJECTS"
    elif len(found) > 1 and all(isinstance(f, dict) for f in found):
        kind = "NDJSON"
    else:
        kind = "SINGLE_OBJECT"
    try:
        found = [json.loads(text)]
    except ValueError:
        pass
    return "DEEP_NESTED" if found and max(map(depth, found)) > DEFAULT.json_max_depth - 1 else kind


def key_occurrence(lines: DataFrame) -> DataFrame:
    """Of records as JSON text (column `value`): (key, occurrences, occurrence_ratio, types, type_conflict).

    Lines that aren't JSON objects don't count as records. A null value is no type.
    """
    parsed = lines.select(F.try_parse_json("value").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    total = parsed.agg(F.count("*").alias("total"))
    each = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer())).select("key", F.schema_of_variant("value").alias("kind"))
    simple = F.regexp_extract("kind", "^([A-Z]+)", 1)
    per = each.groupBy("key").agg(F.count("*").cast("long").alias("occurrences"), F.sort_array(F.collect_set(F.when(simple != "VOID", simple))).alias("types"))
    x = per.join(F.broadcast(total), F.lit(True))
    return x.select("key", "occurrences", F.round(F.col("occurrences") / F.col("total"), 4).alias("occurrence_ratio"), F.array_join("types", ",").alias("types"), (F.size("types") > 1).alias("type_conflict"))


def _flat(schema: T.StructType, at: tuple[str, ...], most: int) -> list[tuple[tuple[str, ...], bool]]:
    out = []
    for f in schema:
        path = (*at, f.name)
        if isinstance(f.dataType, T.StructType) and len(path) < most:
            out += _flat(f.dataType, path, most)
        else:
            out.append((path, isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))))
    return out


def flat(df: DataFrame, most: int = DEFAULT.json_max_depth) -> DataFrame:
    """Nested keys as columns joined with `_` down to a depth; what is deeper, and lists, as JSON text."""
    cells = []
    for path, complex_ in _flat(df.schema, (), most):
        c = F.col(".".join(f"`{p}`" for p in path))
        cells.append((F.to_json(c) if complex_ else c).alias("_".join(path)))
    return df.select(*cells)


def read_json(spark: SparkSession, path: str, x: Intake, unwrap: bool = False, s: Settings = DEFAULT) -> DataFrame:
    """Records as rows; malformed lines are skipped. A wrapper object is one row unless unwrap asks for its first list."""
    kind = shape(x)
    text = x.head.decode(x.encoding, errors="replace").lstrip("\ufeff \t\r\n")
    by_line = kind == "NDJSON" or (kind == "DEEP_NESTED" and not text.startswith("[") and len(text.splitlines()) > 1 and text.splitlines()[0].rstrip().endswith("}"))
    reader = spark.read.option("mode", "DROPMALFORMED").option("primitivesAsString", False).option("samplingRatio", 1.0)
    df = reader.option("multiLine", not by_line).json(path)
    if unwrap or kind == "DEEP_NESTED":
        lists = [f for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        if lists and not text.startswith("[") and not by_line:
            df = df.select(F.inline(lists[0].name))
    return flat(df, s.json_max_depth)
