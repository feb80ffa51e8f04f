"""The stages on small tables, each against what it promises, and the whole."""

import corpus_pipeline
from gaugeframe.llm import nnpu, simhash, suffix_dedup

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    clean = stage["toxicity"](spark, docs, DATA).cache()
    good = {r["doc_id"] for r in nnpu.digest(docs, labels).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in clean.collect()} == good and clean.columns == docs.columns
    lined = stage["line_dedup"](spark, clean, DATA).cache()
    assert lined.columns == docs.columns and {r["doc_id"] for r in lined.collect()} <= good
    alone = stage["simhash_near_dedup"](spark, lined, DATA).cache()
    groups = {r["component_id"] for r in simhash.near_duplicates(lined).collect()}
    assert sorted(r["doc_id"] for r in alone.collect()) == sorted(groups)
    cut = stage["suffix_array_dedup"](spark, alone, DATA).cache()
    lost = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.digest(alone).collect()}
    was = {r["doc_id"]: r["text"] for r in alone.collect()}
    for r in cut.collect():
        assert r["n_chars"] == len(r["text"]) and (r["text"] == was[r["doc_id"]]) == (not lost[r["doc_id"]])
    assert all(lost[d] for d in set(was) - {r["doc_id"] for r in cut.collect()})
    packed = stage["packing"](spark, cut, DATA)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in cut.collect()}


def test_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100


def test_every_text_is_kept_once_or_accounted_for(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(80))
    long = " ".join(f"v{i}" for i in range(150_000))  # a text of 1 MB
    rows = [(1, own(1)), (1, own(1)), (2, own(1)), (3, own(3)), (None, own(4)), (5, ""), (6, None), (7, long), (7, long), (8, own(8))]
    extra = "n_lines long, __spans string, __key string, __stay string, __toxicity double"
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "a", "b", "c", 0.5) for d, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        docs = out.cache()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:4]) for r in docs.collect()) == sorted([(1, "w1x0"), (3, "w3x0"), (0, "w4x0"), (5, ""), (7, "v0 v"), (8, "w8x0")])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert pieces.select("doc_id").distinct().count() == 6


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0
        docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
