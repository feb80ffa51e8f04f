"""Values as canonical text, and text brought to a standard form: column expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.settings import FALSE_TOKENS, NULL_TOKENS, TRUE_TOKENS

_EDGES = "^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$"


def float_text(c: Column) -> Column:
    """A double in its shortest decimal form; an exponent only below 1e-4 and from 1e16."""
    size, plain = F.abs(c), c.cast("string")
    trimmed = lambda d: F.regexp_replace(F.regexp_replace(d.cast("string"), "0+$", ""), "\\.$", ".0")
    mantissa = F.regexp_replace(F.substring_index(plain, "E", 1), "\\.0$", "")
    power = F.substring_index(plain, "E", -1).cast("int")
    exponent = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (
        F.when((size < 1e-4) & (size > 0) | (size >= 1e16) & (size < float("inf")), exponent)
        .when((size >= 1e7) & (size < 1e16), trimmed(c.cast("decimal(38,10)")))
        .when((size < 1e-3) & (size > 0), trimmed(c.cast("decimal(38,25)")))
        .otherwise(plain)
    )


def time_text(c: Column) -> Column:
    """ISO 8601 with a T; microseconds only if there are some."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def as_text(c: Column, kind: T.DataType) -> Column:
    """The one text form that all statistics over values use."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float_text(c.cast("double") if isinstance(kind, T.DoubleType) else c.cast("string").cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return time_text(c)
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def leaves(schema: T.StructType, at: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.StructField]]:
    """Paths of the fields that are not structs; lists and maps count as leaves."""
    out = []
    for f in schema:
        out += leaves(f.dataType, (*at, f.name)) if isinstance(f.dataType, T.StructType) else [((*at, f.name), f)]
    return out


def flattened(df: DataFrame) -> DataFrame:
    """Structs opened into columns named by their path joined with `_`; lists and maps as JSON text.

    Columns are reached by position, so names may repeat or hold dots.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    cells, out = [], []
    for path, f in leaves(plain.schema):
        c = F.col(".".join(f"`{p}`" for p in path))
        cells.append(F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else c)
        out.append("_".join([names[int(path[0][1:])], *path[1:]]))
    return plain.select(*[c.alias(f"x{i}") for i, c in enumerate(cells)]).toDF(*out)


def standard_name(name: str) -> str:
    """Snake case: lower case, other characters to single underscores, none at the ends, no digit first, never empty."""
    out = re.sub(r"_{2,}", "_", re.sub(r"[^a-z0-9_]", "_", name.strip().lower())).strip("_")
    return "unnamed" if not out else f"col_{out}" if out[0].isdigit() else out


def standard_names(names: list[str]) -> list[str]:
    """standard_name of each, later ones that collide numbered from _2 on."""
    seen: dict[str, int] = {}
    out = []
    for n in map(standard_name, names):
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def standard_name_of(c: Column) -> Column:
    """standard_name as a column expression."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_]", "_"), "_{2,}", "_")
    clean = F.btrim(clean, F.lit("_"))
    return F.when(clean == "", "unnamed").when(clean.rlike("^[0-9]"), F.concat(F.lit("col_"), clean)).otherwise(clean)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def without_null_tokens(c: Column) -> Column:
    """Trimmed text; null where nothing or a token for a missing value is left."""
    t = trimmed(c)
    return F.when((t != "") & ~F.lower(t).isin(*NULL_TOKENS), t)


def is_bool(c: Column) -> Column:
    return F.lower(c).isin(*TRUE_TOKENS, *FALSE_TOKENS)


def bool_text(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin(*TRUE_TOKENS), "true").when(low.isin(*FALSE_TOKENS), "false").otherwise(c)


def numeric_text(c: Column) -> Column:
    """Without a currency sign before, a percent sign behind and commas between groups, if a digit is left."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^[$€£¥]", ""), "%$", ""), "(?<=[0-9]),(?=[0-9]{3})", "")
    out = trimmed(out)
    return F.when(out.rlike("[0-9]"), out).otherwise(c)
