"""Workbooks (xlsx) and embedded databases (SQLite, DuckDB files): each file is parsed by one task from its bytes."""

from __future__ import annotations

import io
import os
import re
import sqlite3
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.sources.delimited import header_of

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats of spreadsheets that show dates.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _number(text: str, is_date: bool) -> str:
    x = float(text)
    if is_date:
        return (datetime(1899, 12, 30) + timedelta(days=x)).isoformat()
    return str(int(x)) if x.is_integer() else str(x)


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet of an xlsx as text; empty rows are skipped."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ET.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{{{_NS['m']}}}numFmt")}
            used = [int(x.get("numFmtId", 0)) for x in styles.findall("m:cellXfs/m:xf", _NS)]
            dates = [i in _DATE_FORMATS or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^]]*\]', "", own.get(i, "")))) for i in used]
        first = ET.fromstring(z.read("xl/workbook.xml")).find("m:sheets/m:sheet", _NS).get(_REL)
        target = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}[first]
        for row in ET.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{{{_NS['m']}}}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.findall("m:c", _NS)):
                at = _column(c.get("r")) if c.get("r") else k
                kind, v = c.get("t"), c.find("m:v", _NS)
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif v is None or v.text is None:
                    continue
                elif kind == "s":
                    cells[at] = shared[int(v.text)]
                elif kind == "b":
                    cells[at] = "true" if v.text == "1" else "false"
                elif kind in ("str", "e", "d"):
                    cells[at] = v.text
                else:
                    style = int(c.get("s", 0))
                    cells[at] = _number(v.text, style < len(dates) and dates[style])
            if any(x not in (None, "") for x in cells.values()):
                yield [cells.get(i) for i in range(max(cells) + 1)]


def sqlite_tables(content: bytes) -> dict[str, tuple[list[str], list[str]]]:
    """Tables of a SQLite file with their columns and declared types."""
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    names = [r[0] for r in db.execute("select name from sqlite_master where type = 'table' and name not like 'sqlite_%' order by name")]
    return {n: tuple(zip(*[(r[1], r[2]) for r in db.execute(f"pragma table_info({_quoted(n)})")], strict=True)) for n in names}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return str(v).lower()
    return v.hex() if isinstance(v, bytes) else v.isoformat() if hasattr(v, "isoformat") else str(v)


def sqlite_rows(content: bytes, table: str) -> Iterator[list[str | None]]:
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    for r in db.execute(f"select * from {_quoted(table)}"):
        yield [_text(v) for v in r]


def duckdb_call(content: bytes, sql: str) -> Iterator[tuple]:
    import duckdb

    with tempfile.TemporaryDirectory() as d:
        path = os.path.join(d, "x.duckdb")
        with open(path, "wb") as f:
            f.write(content)
        with duckdb.connect(path, read_only=True) as db:
            got = db.execute(sql)
            while rows := got.fetchmany(10_000):
                yield from rows


def duckdb_tables(content: bytes) -> dict[str, tuple[list[str], list[str]]]:
    out: dict[str, list] = {}
    for t, c, k in duckdb_call(content, "select table_name, column_name, data_type from information_schema.columns where table_schema = 'main' order by table_name, ordinal_position"):
        out.setdefault(t, []).append((c, k))
    return {t: tuple(zip(*x, strict=True)) for t, x in out.items()}


def duckdb_rows(content: bytes, table: str) -> Iterator[list[str | None]]:
    for r in duckdb_call(content, f"select * from {_quoted(table)}"):
        yield [_text(v) for v in r]


def frame(spark: SparkSession, path: str, names: list[str], rows: Callable[[bytes], Iterator[list]], skip: int = 0) -> DataFrame:
    """Rows that a parser finds in the bytes of each file at the path."""
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda held: pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in held], pa.string()) for i in range(width)], [f"c{i}" for i in range(width)])
        for batch in batches:
            for content in batch.column(0).to_pylist():
                held = []
                for k, r in enumerate(rows(content)):
                    if k >= skip:
                        held.append(r)
                    if len(held) >= 10_000:
                        yield out(held)
                        held = []
                if held:
                    yield out(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"c{i} string" for i in range(width))).toDF(*names)


def content_of(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select(F.col("content")).first()[0])


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of an xlsx; the older binary form isn't read."""
    if not zipfile.is_zipfile(io.BytesIO(content := content_of(spark, path))):
        raise NotImplementedError("only xlsx workbooks are read")
    first = [r for _, r in zip(range(5), sheet_rows(content), strict=False)]
    names, has = header_of([[c or "" for c in r] for r in first])
    return frame(spark, path, names, sheet_rows, int(has))


def read_database(spark: SparkSession, path: str, kind: str) -> dict[str, DataFrame]:
    """Every table of an embedded database file."""
    tables, rows = (sqlite_tables, sqlite_rows) if kind == "SQLITE" else (duckdb_tables, duckdb_rows)
    found = tables(content_of(spark, path))
    return {t: frame(spark, path, list(columns), lambda content, t=t: rows(content, t)) for t, (columns, _) in found.items()}
