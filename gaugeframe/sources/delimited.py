"""Delimited text: structure from the first lines, then Spark's reader (or archive entries read in tasks)."""

from __future__ import annotations

import csv
import io
import zipfile
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.settings import DEFAULT, Settings
from gaugeframe.sources.intake import CorruptFile, Intake, entries, examined


def delimiter_scores(lines: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(delimiter, score) over lines (column `value`): mean occurrences a line, less the more they vary."""
    one = lines.where(F.trim("value") != "").select(F.inline(F.array(*[F.struct(F.lit(d).alias("delimiter"), (F.length("value") - F.length(F.replace("value", F.lit(d), F.lit("")))).alias("n")) for d in s.csv_delimiters])))
    per = one.groupBy("delimiter").agg(F.avg("n").alias("mean"), F.var_pop("n").alias("spread"))
    return per.select("delimiter", F.round(F.col("mean") / (1 + F.col("spread")), 4).alias("score"))


def best_delimiter(lines: list[str], hint: str | None = None, s: Settings = DEFAULT) -> str:
    some = [x for x in lines[:20] if x.strip()]
    if hint in s.csv_delimiters and any(hint in x for x in some):
        return hint
    scores = {}
    for d in s.csv_delimiters:
        n = [x.count(d) for x in some]
        if any(n):
            mean = sum(n) / len(n)
            scores[d] = mean / (1 + sum((k - mean) ** 2 for k in n) / len(n))
    return max(scores, key=scores.get, default=",")


def corruption_ratio(lines: DataFrame, sep: str) -> DataFrame:
    """(corruption_ratio): share of lines (column `value`) whose number of fields isn't the usual one; no quotes."""
    n = lines.where(F.trim("value") != "").select((F.length("value") - F.length(F.replace("value", F.lit(sep), F.lit(""))) + 1).alias("n"))
    per = n.groupBy("n").agg(F.count("*").alias("cnt"))
    return per.agg(F.round(1 - F.max("cnt") / F.sum("cnt"), 4).alias("corruption_ratio"))


def corruption(rows: list[list[str]]) -> float:
    sizes = Counter(map(len, rows))
    return 1 - max(sizes.values()) / len(rows) if rows else 0.0


def is_number(x: str) -> bool:
    try:
        float(x.strip().replace(",", ""))
    except ValueError:
        return False
    return True


def header_of(rows: list[list[str]]) -> tuple[list[str], bool]:
    """Column names and whether the first row holds them: all its cells filled, none a number. Repeats are numbered."""
    if not rows:
        return [], False
    first = rows[0]
    if not all(c.strip() and not is_number(c) for c in first):
        return [f"column_{i + 1}" for i in range(len(first))], False
    seen: Counter = Counter()
    out = []
    for c in (x.strip() for x in first):
        seen[c] += 1
        out.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    return out, True


def structure(x: Intake, s: Settings = DEFAULT) -> tuple[str, list[str], bool]:
    """(delimiter, names, has a header) from the intake window; CorruptFile if too many rows are ragged."""
    text = x.head.decode(x.encoding, errors="replace").removeprefix("\ufeff")
    lines = text.splitlines(keepends=True)[: s.csv_probe_rows + 5]
    sep = best_delimiter([x.rstrip("\r\n") for x in lines], x.delimiter, s)
    rows = [r for r in csv.reader(lines, delimiter=sep) if r]
    if len(x.head) >= 8192 and len(rows) > 1:
        rows = rows[:-1]  # the window may have cut the last one
    if corruption(rows) > s.corruption_threshold:
        raise CorruptFile(f"{x.path}: {corruption(rows):.0%} of the first rows have another number of fields")
    names, has = header_of(rows)
    return sep, names, has


def read_delimited(spark: SparkSession, path: str, x: Intake | None = None, s: Settings = DEFAULT) -> DataFrame:
    """All rows as text columns. Short rows are filled with nulls, surplus fields dropped, as in a lenient reader.

    A file is split between tasks unless a quote is open at the end of one of its first lines, or its encoding has no
    single byte for a line's end: such a file is read record by record.
    """
    x = x or examined(spark, path, s)
    sep, names, has = structure(x, s)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if x.compression == "zip":
        return _from_archive(spark, path, sep, names, has, x.encoding)
    code = {"utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1", "utf-16-le": "UTF-16", "utf-16-be": "UTF-16"}.get(x.encoding, x.encoding.upper())
    first = x.head.decode(x.encoding, errors="replace").split("\n")
    whole = x.encoding.startswith("utf-16") or any(line.count('"') % 2 for line in first[:-1])
    reader = spark.read.schema(schema).option("sep", sep).option("header", has).option("encoding", code).option("enforceSchema", True)
    return reader.option("quote", '"').option("escape", '"').option("multiLine", whole).option("mode", "PERMISSIVE").csv(path)


def corrupt_rows(spark: SparkSession, path: str, sep: str, width: int) -> Column | DataFrame:
    """(corrupt_rows_detected) of a plain file: lines with another number of fields, quoted fields considered."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    bare = F.regexp_replace("value", '"[^"]*"', "")
    n = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    return lines.agg(F.count_if(n != width).cast("long").alias("corrupt_rows_detected"))


def _from_archive(spark: SparkSession, path: str, sep: str, names: list[str], has: bool, code: str) -> DataFrame:
    """Rows of all entries of a zip, in the order of their names; each archive is read by one task."""
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for entry in entries(z):
                        rows = csv.reader(io.TextIOWrapper(z.open(entry), code, errors="replace", newline=""), delimiter=sep)
                        if has:
                            next(rows, None)
                        held = []
                        for r in rows:
                            if r:
                                held.append([*r[:width], *[None] * (width - len(r))])
                            if len(held) >= 10_000:
                                yield _batch(held, width)
                                held = []
                        if held:
                            yield _batch(held, width)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"c{i} string" for i in range(width))).toDF(*names)


def _batch(rows: list[list], width: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(width)], [f"c{i}" for i in range(width)])
