"""What a text value looks like: one boolean (or label) expression for each semantic type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeframe.functions.text import is_bool
from gaugeframe.settings import DATE_FORMATS

INTEGER = "^-?(?:0|[1-9][0-9]*)$"
FLOAT = "^-?(?:(?:[0-9]+\\.[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[0-9]+[eE][+-]?[0-9]+)$"
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
DATE_SHAPE = "^[0-9]{4}[-/]?[0-9]{2}[-/]?[0-9]{2}$|^[0-9]{2}[-/][0-9]{2}[-/][0-9]{4}$"
_TIME = "([0-9]{2}):([0-9]{2}):([0-9]{1,2})(?:\\.[0-9]{1,6})?"
_YEAR_FIRST = f"^([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})(?:T{_TIME}(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?| {_TIME})$"
_YEAR_LAST = f"^([0-9]{{2}})([-/])([0-9]{{2}})\\2([0-9]{{4}}) {_TIME}$"


def without_commas(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def is_integer(c: Column) -> Column:
    return without_commas(c).rlike(INTEGER)


def is_float(c: Column) -> Column:
    return without_commas(c).rlike(FLOAT)


def is_uuid(c: Column) -> Column:
    return c.rlike(UUID)


def date_label(c: Column) -> Column:
    """Label of the first date format that the value has, else null."""
    tried = [F.when(F.try_to_timestamp(c, F.lit(pattern)).isNotNull(), label) for pattern, label in DATE_FORMATS]
    return F.when(c.rlike(DATE_SHAPE), F.coalesce(*tried))


def _moment(date: Column, shape: str, first: int) -> Column:
    part = lambda k: F.regexp_extract(date, shape, k)
    return F.concat_ws(":", part(first), part(first + 1), F.lpad(part(first + 2), 2, "0"))


def timestamp_kind(c: Column) -> Column:
    """'aware' or 'naive' for a point in time to the second, with or without an offset; else null."""
    exists = lambda day, time: F.try_to_timestamp(F.concat_ws(" ", day, time), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    has_t = F.substring(c, 11, 1) == "T"
    iso = exists(F.substring(c, 1, 10), F.when(has_t, _moment(c, _YEAR_FIRST, 4)).otherwise(_moment(c, _YEAR_FIRST, 8)))
    a, b, year = F.substring(c, 1, 2), F.substring(c, 4, 2), F.substring(c, 7, 4)
    time = _moment(c, _YEAR_LAST, 5)
    other = exists(F.concat_ws("-", year, b, a), time) | exists(F.concat_ws("-", year, a, b), time)
    aware = F.regexp_extract(c, _YEAR_FIRST, 7) != ""
    return F.when(c.rlike(_YEAR_FIRST), F.when(iso, F.when(aware, "aware").otherwise("naive"))).when(c.rlike(_YEAR_LAST), F.when(other, "naive"))


def number(c: Column) -> Column:
    """The value as a double if it is written as a number, else null."""
    plain = without_commas(c)
    written = plain.rlike("^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?$")
    return F.when(written, plain.try_cast("double"))


__all__ = ["is_bool", "is_integer", "is_float", "is_uuid", "date_label", "timestamp_kind", "number", "without_commas"]
