"""Line dedup by content-defined chunks, in DataFrame operations only.

Every line is hashed; a rolling (cyclic polynomial) hash runs over two lines at a time. Chunks begin where the rolling
hash is least among its neighbours, so that boundaries depend on nearby lines alone and survive insertions elsewhere. A
chunk holds the two lines of its boundary at least, and reaches one line further to either side where that is repeated
too. Of any three consecutive lines that two documents share, both choose the same boundary: a repeated run of three lines
or more is covered without a gap, whatever surrounds it, as boundaries are two lines apart at most.

A chunk that occurred before, in another document or in the same one, is removed. Chunks are equal if their lines' hashes
are, one by one; the lines of all repeated chunks are then compared byte by byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm._shared import cut, met, only, packed, unpacked
from gaugeframe.llm._text import bind, has_word, lines

KEY = ("doc_id", "th")
#: What a chunk is compared by: the hashes of its two or three lines (two: the third is 0 and n is 2).
CHUNK = ["n", "x", "y", "z"]


def _turn(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def boundaries(line: Column) -> Column:
    """array<struct(at, before, a, b, after, words)> of an array of lines: where chunks begin (from 0), and the lines there.

    a and b are the hashes of the boundary's lines, before and after those of the lines around them (null at the ends of
    the text); bits 0 to 3 of `words` tell which of the four lines has a word.
    """
    hashed = lambda l: F.transform(l, lambda x: F.struct(F.xxhash64(x).alias("h"), has_word(x).cast("int").alias("w")))  # noqa: E731, E741

    def rolled(s: Column) -> Column:
        value = lambda x, i: F.xxhash64(_turn(x["h"], 1).bitwiseXOR(F.get(s, i + 1)["h"]))
        return F.slice(F.transform(s, value), 1, F.greatest(F.size(s) - 1, F.lit(0)))

    def chosen(s: Column, r: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            low = F.coalesce(F.get(r, i - 1) >= x, F.lit(False)) | F.coalesce(F.get(r, i + 1) > x, F.lit(False)) | (F.size(r) == 1)
            at = lambda k: F.get(s, i + k)
            words = F.coalesce(at(-1)["w"], F.lit(0)) + at(0)["w"] * 2 + at(1)["w"] * 4 + F.coalesce(at(2)["w"], F.lit(0)) * 8
            found = F.struct(i.alias("at"), at(-1)["h"].alias("before"), at(0)["h"].alias("a"), at(1)["h"].alias("b"), at(2)["h"].alias("after"), words.alias("words"))
            return F.when(low & (words > 0), found)

        return F.filter(F.transform(r, one), lambda x: x.isNotNull())

    return bind(hashed(line), lambda s: bind(rolled(s), lambda r: chosen(s, r)))


def boundary_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, at, before, a, b, after, words) of each boundary; th is the hash of the document's text."""
    text = F.col("text").cast("string")
    of_line = only(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("th"), lines(text).alias("l"))
    return of_line.select(*KEY, F.explode(boundaries(F.col("l"))).alias("c")).select(*KEY, "c.*")


def chunk_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, th, at, n, x, y, z): the chunks with a word at some boundaries, their first lines and sizes."""
    zero = F.lit(0).cast("long")

    def chunk(shift: int, n: int, x: str, y: str, z: str | None, words: int) -> Column:
        has = F.col("words").bitwiseAND(words) > 0
        fields = F.struct((F.col("at") + shift).alias("at"), F.lit(n).alias("n"), F.col(x).alias("x"), F.col(y).alias("y"), (F.col(z) if z else zero).alias("z"))
        return F.when(has & F.col(x).isNotNull() & (F.col(z).isNotNull() if z else F.lit(True)), fields)

    three = F.array(chunk(0, 2, "a", "b", None, 6), chunk(-1, 3, "before", "a", "b", 7), chunk(0, 3, "a", "b", "after", 14))
    return rows.select(*KEY, F.explode(F.array_compact(three)).alias("c")).select(*KEY, "c.*")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, th, at, n, is_first) of every occurrence of the chunks that occur more than once, by their lines' hashes."""
    rows = cut(boundary_rows(docs))
    pairs = cut(rows.groupBy("a", "b").agg(F.count("*").alias("times")).where("times > 1"))
    each = cut(chunk_rows(met(rows, pairs, ["a", "b"], rows.count()).drop("times")))
    place = F.struct(*KEY, "at")
    found = each.groupBy(*CHUNK).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("times"))
    found = cut(found.where("first <> last").select(*CHUNK, "first", "times"))
    return met(each, found, CHUNK, each.count()).select(*KEY, "at", "n", place.eqNullSafe(F.col("first")).alias("is_first"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, spans): the chunks (at, n) to remove from each document that has some.

    A document keeps its chunks if one of its lines differs in its bytes from another line with the same hash.
    """
    found = cut(repeated_chunks(docs))
    wanted = found.groupBy(*KEY).agg(F.collect_set(F.struct("at", "n", "is_first")).alias("spans"))
    text = F.col("text").cast("string")
    base = only(docs, "doc_id", "text").select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    here = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("h"))
    with_text = base.join(wanted, here).select(*KEY, "spans", lines(F.col("text")).alias("l"))
    inside = lambda i, s: F.exists(s, lambda c: (i >= c["at"]) & (i < c["at"] + c["n"]))
    compared = with_text.select(F.explode(F.filter("l", lambda x, i: inside(i, F.col("spans")))).alias("line"))
    compared = compared.groupBy(F.xxhash64("line").alias("h")).agg(F.min("line").alias("low"), F.max("line").alias("high"))
    differ = cut(compared.where("low <> high").select("h"))
    gone = found.where("not is_first")
    if differ.limit(1).count():  # hashes that clash: documents that hold one keep what it may touch
        own = with_text.select(F.col("doc_id").alias("id"), F.col("th").alias("t"), F.explode(F.transform("l", lambda x: F.xxhash64(x))).alias("h"))
        unsure = own.join(differ, "h").select("id", "t").distinct()
        gone = gone.join(unsure, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("t")), "left_anti")
    return gone.groupBy(*KEY).agg(F.collect_set(F.struct("at", "n")).alias("spans"))


def _deduped(docs: DataFrame) -> DataFrame:
    """Packed rows of docs with `kept` (the text that is left), `l` (its lines before) and `lost` (a boolean for each)."""
    spans = removed_lines(docs).withColumnsRenamed({"doc_id": "id", "th": "h"})
    rows = packed(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("h")), "left")
    return joined.select("row", "doc_id", "text", "spans")


def _counted(rows: DataFrame) -> DataFrame:
    lost = lambda i: F.exists("spans", lambda s: (i >= s["at"]) & (i < s["at"] + s["n"]))
    left = F.filter("l", lambda x, i: ~F.coalesce(lost(i), F.lit(False)))
    rows = rows.withColumn("l", lines(F.col("text"))).withColumn("left", F.when(F.col("spans").isNull(), F.col("l")).otherwise(left))
    n, now = F.size("l").cast("long"), F.size("left").cast("long")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join("left", "\n"))
    return rows.select("row", "doc_id", text.alias("text"), n.alias("n_lines"), (n - now).alias("n_removed_lines"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_removed_chunks"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without repeated chunks in `text`, and `n_lines`, `n_removed_lines`, `n_removed_chunks` (long).

    The first occurrence (smallest doc_id, null before all, then text hash, then line) stays. Rows with the same doc_id
    and text are one document and lose the same lines. Null texts stay null, with no lines; the empty text has one line
    and no chunk. A text of any length is handled whole. All columns pass, whatever their names; one that is called like
    a count stands beside it.
    """
    out = _counted(_deduped(docs))
    counts = ["n_lines", "n_removed_lines", "n_removed_chunks"]
    fields = [F.col("text").cast(f.dataType) if n == "text" else F.col("row")[f"c{i}"] for i, (n, f) in enumerate(zip(docs.columns, docs.schema, strict=True))]
    return out.select(*[c.alias(f"c{i}") for i, c in enumerate(fields)], *counts).toDF(*docs.columns, *counts)


def digest(docs: DataFrame) -> DataFrame:
    """Per document what dedup_lines left: counts, and SHA-256 of the text (null: of the empty text)."""
    out = _counted(_deduped(only(docs, "doc_id", "text")))
    n = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", n.alias("n_kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated chunks removed and n_chars brought up to date; documents that this leaves without a word go.

    Rows, nulls and names as in dedup_lines. Documents that lose nothing stay, empty ones included.
    """
    out = _counted(_deduped(docs))
    gone = (F.col("n_removed_lines") > 0) & ~has_word(F.regexp_replace("text", "\n", " "))
    kept = out.where(~F.coalesce(gone, F.lit(False)))
    size = F.when(F.col("n_removed_lines") > 0, F.char_length("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(size, F.col("row")[f"c{docs.columns.index('n_chars')}"])
    return unpacked(kept, docs, **changed)
