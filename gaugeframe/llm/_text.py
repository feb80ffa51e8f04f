"""Column expressions over words and lines; JVM-side only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: space and U+0009 to U+000D.
BLANK = " \t\n\x0b\x0c\r"
#: The same within a line.
LINE_BLANK = BLANK.replace("\n", "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it (also within lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANK, " " * len(BLANK))
    return F.array_remove(F.split(spaced, " "), "")


def lines(text: Column) -> Column:
    """The lines between line feeds; none for null."""
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(LINE_BLANK)) != ""
