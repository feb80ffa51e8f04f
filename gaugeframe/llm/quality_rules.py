"""Quality rules with a cross-document line filter, in DataFrame operations only.

Lines are normalised (case, blanks at the ends and runs of blanks) and hashed. For each host the documents that have a
line are counted. Lines over the host's limit are boilerplate: they are removed, and a document that loses more than
half of its words, or that fails a base rule, is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.llm._shared import cut, only, packed, unpacked
from gaugeframe.llm._text import LINE_BLANK, bind, has_word, lines, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT, MIN_KEPT_PERCENT = 50, 50, 50
#: A line is frequent if more documents of its host have it than both of these allow.
LINE_DOCS, LINE_SHARE = 20, 0.001
#: Frequent lines that are broadcast at most (24 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000


def repeated_words(found: Column) -> Column:
    """Words covered by three-word windows that occur twice or more.

    Window hashes give up their lowest bits to the window's position, so that one primitive sort puts windows that may be
    equal side by side. These few are then sorted by their words, which decide.
    """
    last = lambda w: F.size(w) - 2
    hashes = lambda w: F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, last(w))

    def covered(h: Column) -> Column:
        bits = F.ceil(F.log2(F.size(h) + F.lit(2))).cast("int")
        return bind(bits, lambda b: bind(packed(h, b), lambda s: bind(bind(bind(alike(s, b), written), repeats), spans)))

    def packed(h: Column, b: Column) -> Column:
        high = lambda x: F.call_function("shiftleft", F.call_function("shiftright", x, b), b)
        return F.sort_array(F.transform(h, lambda x, i: high(x).bitwiseOR(i.cast("long"))))

    def alike(s: Column, b: Column) -> Column:
        high = lambda x: F.call_function("shiftright", x, b)
        same = lambda x, j: F.coalesce(high(x) == high(F.get(s, j)), F.lit(False))
        position = F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1
        return F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x.bitwiseAND(position))

    def written(at: Column) -> Column:
        window = lambda p: F.concat_ws(" ", F.slice(found, p.cast("int") + 1, 3))
        return F.sort_array(F.transform(at, lambda p: F.struct(window(p).alias("w"), p.alias("p"))))

    def repeats(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x["w"] == F.get(s, j)["w"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["p"]))

    def spans(at: Column) -> Column:
        three = F.lit(3).cast("long")
        steps = F.transform(at, lambda x, k: F.least(three, x - F.coalesce(F.get(at, k - 1), x - 3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(found) < 4, F.lit(0).cast("long")).otherwise(bind(found, lambda w: bind(hashes(w), covered)))


def normalised(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(LINE_BLANK)), "[ \\t\\x0B\\f\\r]+", " "))


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: a row number, its host, the base metrics, and a (hash, words) pair for each line with a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = only(docs, "doc_id", host, "text").toDF("doc_id", "host", "text").select("doc_id", "host", text.alias("text"))
    split = split.select("doc_id", "host", words(F.col("text")).alias("w"), F.filter(lines(F.col("text")), has_word).alias("l"))
    glued = F.array_join("w", "")
    split = split.select("*", F.char_length(glued).alias("word_chars"), F.char_length(F.translate(glued, SYMBOLS, "")).alias("plain"))
    return split.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.col("word_chars").cast("long"),
        (F.col("word_chars") - F.col("plain")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.transform("l", lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.size(words(x)).alias("n"))).alias("lines"),
    )


def frequent_lines(rows: DataFrame, docs_limit: int = LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """(host, h) of the lines that more distinct documents of the host have than docs_limit and share of its documents.

    Rows that repeat a doc_id are one document; rows without a doc_id aren't counted.
    """
    named = rows.where("doc_id is not null")
    of_host = named.select("host", "doc_id").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    one = named.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"), "doc_id").distinct()
    often = one.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > docs_limit)
    return often.join(of_host.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.col("docs") * share).select("host", "h")


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few enough rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def judged(docs: DataFrame, host: str = "source") -> DataFrame:
    """Per document: the base metrics, base_failed, n_frequent_lines, n_kept_words and the verdict `kept`.

    Null and empty texts have no word and fail the base rule; texts of any length are measured whole. Every row is judged,
    those that repeat a doc_id each by its own text, but they count as one document for the frequency of a line. A null
    host is a host of its own. Other columns play no part. An empty table gives no rows.
    """
    rows = cut(measured(docs, host))
    often = _small(cut(frequent_lines(rows)))
    each = rows.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.h", "x.n")
    often = often.select(F.col("host").alias("__host"), F.col("h").alias("__h"))
    hit = each.join(often, (F.col("h") == F.col("__h")) & F.col("host").eqNullSafe(F.col("__host")), "left_semi")
    lost = hit.groupBy("row").agg(F.count("*").alias("n_frequent_lines"), F.sum("n").alias("lost"))
    out = rows.drop("lines").join(lost, "row", "left")
    n, left = F.col("n_words"), F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEATED_PERCENT)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (left * 100 >= n * MIN_KEPT_PERCENT)).alias("kept"),
        F.coalesce("n_frequent_lines", F.lit(0)).cast("long").alias("n_frequent_lines"), left.cast("long").alias("n_kept_words"),
    )


def without_lines(docs: DataFrame, often: DataFrame, host: str = "source") -> DataFrame:
    """docs with the frequent lines (host, h) taken out of `text`; other columns, whatever their names, and lines stay.

    Each document meets only the frequent lines that it has. Rows that repeat a doc_id, host and text are treated alike.
    """
    rows = packed(docs, "doc_id", host, "text").toDF("row", "doc_id", "of", "text").withColumn("text", F.col("text").cast("string"))
    hashes = F.array_distinct(F.transform(F.filter(lines(F.col("text")), has_word), lambda x: F.xxhash64(normalised(x))))
    each = rows.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.col("of").alias("own"), F.explode(hashes).alias("line"))
    many = _small(often.select("host", "h"))
    hits = each.join(many, (F.col("line") == F.col("h")) & F.col("own").eqNullSafe(F.col("host")), "left_semi")
    hits = hits.groupBy("id", "th", "own").agg(F.collect_set("line").alias("hits"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("th")) & F.col("of").eqNullSafe(F.col("own"))
    kept = F.array_join(F.filter(lines(F.col("text")), lambda x: ~F.array_contains("hits", F.xxhash64(normalised(x))) | ~has_word(x)), "\n")
    joined = rows.join(hits, same, "left")
    return unpacked(joined, docs, text=F.when(F.col("hits").isNull(), F.col("text")).otherwise(kept))
