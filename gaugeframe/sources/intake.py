"""What a file is: compression, byte order mark, encoding, delimiter, format, size strategy. Content decides, not names."""

from __future__ import annotations

import gzip
import io
import json
import struct
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gaugeframe.settings import DEFAULT, Settings
from gaugeframe.sources.files import listed, opened

WINDOW = 8192
SCANNED = (".csv", ".tsv", ".txt", ".gz", ".zip", ".parquet", ".json", ".jsonl", ".ndjson", ".xlsx", ".xls", ".db", ".sqlite", ".sqlite3", ".duckdb")


class EmptyFile(ValueError):
    pass


class CorruptFile(ValueError):
    pass


@dataclass
class Intake:
    path: str
    size_bytes: int
    compression: str | None
    bom: str | None
    encoding: str
    delimiter: str | None
    head: bytes
    file_format: str = "UNKNOWN"
    size_strategy: str = "MEMORY_SAFE"


def compression(head: bytes) -> str | None:
    return "gz" if head[:2] == b"\x1f\x8b" else "zip" if head[:4] == b"PK\x03\x04" else None


def bom(head: bytes) -> str | None:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if head.startswith(mark):
            return name
    return None


def encoding(head: bytes) -> str:
    """The mark's encoding, else UTF-8 if the window decodes (a character cut at its end aside), else Latin-1."""
    if found := bom(head):
        return found
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(head) - 3:
            return "latin-1"
    return "utf-8"


def delimiter(text: str, s: Settings = DEFAULT) -> str | None:
    """The candidate that most of the first ten lines have, most often."""
    lines = [x for x in text.splitlines()[:10] if x.strip()]
    seen = {d: sum(x.count(d) for x in lines) for d in s.csv_delimiters if lines and sum(d in x for x in lines) * 2 > len(lines)}
    return max(seen, key=seen.get) if seen else None


def inflated(raw: io.BufferedIOBase, kind: str | None) -> bytes:
    """The first bytes of the content behind the compression."""
    if kind == "gz":
        with gzip.GzipFile(fileobj=raw) as f:
            return f.read(WINDOW)
    if kind == "zip":
        with zipfile.ZipFile(raw) as z:
            names = entries(z)
            return z.open(names[0]).read(WINDOW) if names else b""
    return raw.read(WINDOW)


def entries(z: zipfile.ZipFile) -> list[str]:
    """Data files of an archive, by name; hidden ones and resource forks aren't."""
    return sorted(n for n in z.namelist() if not n.endswith("/") and "__MACOSX" not in n and not n.rsplit("/", 1)[-1].startswith("."))


def classified(raw: io.BufferedIOBase, size: int, head: bytes, kind: str | None, content: bytes, text: str) -> str:
    raw.seek(max(0, size - 4))
    if head[:4] == b"PAR1" and raw.read(4) == b"PAR1":
        return "PARQUET"
    if head[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return "EXCEL"
    if kind == "zip":
        raw.seek(0)
        with zipfile.ZipFile(raw) as z:
            if any(n.startswith("xl/") for n in z.namelist()):
                return "EXCEL"
    if head[:16] == b"SQLite format 3\x00":
        return "SQLITE"
    if head[8:12] == b"DUCK":
        return "DUCKDB"
    start = text.lstrip("\ufeff \t\r\n")
    if start[:1] in ("{", "["):
        try:
            json.loads(start.splitlines()[0])
            return "JSON"
        except ValueError:
            if start[1:].lstrip()[:1] in ('"', "{", "}", "[", "]"):
                return "JSON"
    if b"\x00" in content and not bom(content):
        return "UNKNOWN"
    return "CSV" if start else "UNKNOWN"


def effective_size(raw: io.BufferedIOBase, size: int, kind: str | None) -> int:
    """Bytes behind the compression: entries of a zip, the trailer of a gz (five times its size if that is 0)."""
    if kind == "zip":
        raw.seek(0)
        with zipfile.ZipFile(raw) as z:
            return sum(i.file_size for i in z.infolist())
    if kind == "gz":
        raw.seek(max(0, size - 4))
        return struct.unpack("<I", raw.read(4).rjust(4, b"\0"))[0] or 5 * size
    return size


def size_strategy(n: int, s: Settings = DEFAULT) -> str:
    return "MEMORY_SAFE" if n < s.memory_safe_bytes else "LAZY_SCAN" if n < s.lazy_scan_bytes else "STREAM_ONLY"


def examined(spark: SparkSession, path: str, s: Settings = DEFAULT) -> Intake:
    """Intake of one file; EmptyFile if it has no byte, CorruptFile if its compression can't be read."""
    with opened(spark, path) as raw:
        size = raw.raw.size
        if not size:
            raise EmptyFile(path)
        head = raw.read(WINDOW)
        kind = compression(head)
        raw.seek(0)
        try:
            content = inflated(raw, kind)
            code = encoding(content)
            text = content.decode(code, errors="replace")
            form = classified(raw, size, head, kind, content, text)
            inside = effective_size(raw, size, kind)
        except (zipfile.BadZipFile, OSError, EOFError) as e:
            raise CorruptFile(f"{path}: {e}") from e
    return Intake(path, size, kind, bom(content), code, delimiter(text, s), content, form, size_strategy(inside, s))


def supported_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes, file_format, encoding, compression, size_strategy) of a directory's files that can be profiled."""
    rows = []
    for file, _ in listed(spark, path):
        if file.lower().endswith(SCANNED):
            try:
                x = examined(spark, file)
            except (EmptyFile, CorruptFile):
                continue
            rows.append((file, x.size_bytes, x.file_format, x.encoding, x.compression, x.size_strategy))
    return spark.createDataFrame(rows, "path string, size_bytes long, file_format string, encoding string, compression string, size_strategy string")
