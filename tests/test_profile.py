"""Profiles of small literal tables whose statistics are known."""

import statistics as st

import pytest
from pyspark.sql import functions as F

from gaugeframe import api
from gaugeframe.functions import text
from gaugeframe.operators import charts, clusters, diagram, quality, relationships, sampling
from gaugeframe.plans import enrich, profile
from gaugeframe.settings import Settings


def columns(df, name="t"):
    return {r["name"]: r for r in profile.column_profiles(df, name).collect()}


def test_numbers(spark):
    x = columns(spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 100)], "v int"))["v"]
    assert (x["inferred_type"], x["mean"], x["median"], x["p25"], x["p75"], x["iqr"], x["outlier_count"]) == ("INTEGER", 22.0, 3.0, 2.0, 4.0, 2.0, 1)
    assert x["variance"] == pytest.approx(st.variance([1, 2, 3, 4, 100])) and (x["min"], x["max"]) == ("1.0", "100.0")


def test_two_values_have_no_numeric_statistics(spark):
    x = columns(spark.createDataFrame([(5,), (7,)], "v int"))["v"]
    assert x["mean"] is None and x["p25"] is None and x["min"] == "5.0"


def test_text_numbers_with_one_word(spark):
    x = columns(spark.createDataFrame([(str(v),) for v in range(11, 20)] + [("word",)], "v string"))["v"]
    assert x["inferred_type"] == "INTEGER" and x["confidence_score"] == 0.9 and x["mean"] is None and x["max"] == "word"


def test_nulls_sentinels_and_booleans(spark):
    x = columns(spark.createDataFrame([("yes", "a"), ("no", "N/A"), ("Y", " "), ("n", None)], "b string, s string"))
    assert x["b"]["inferred_type"] == "BOOLEAN" and x["b"]["distinct_count"] == 2 and x["b"]["min"] is None
    assert x["s"]["null_count"] == 3 and "NULL_VARIANT_NORMALIZED" in x["s"]["quality_flags"] and x["s"]["is_sparse"]


def test_mixed_dates_and_timezones(spark):
    rows = [("2024-01-15", "2024-01-15T10:00:00Z"), ("15/01/2024", "2024-01-15T10:00:00")]
    x = columns(spark.createDataFrame(rows, "d string, t string"))
    assert x["d"]["inferred_type"] == "MIXED_DATE" and x["d"]["format_variants"] == ["DD/MM/YYYY", "YYYY-MM-DD"]
    assert x["t"]["inferred_type"] == "TIMESTAMP" and "MIXED_TIMEZONES" in x["t"]["quality_flags"]


def test_empty_table_and_odd_names(spark):
    x = columns(spark.createDataFrame([], "`a.b` int, `First Name` string"))
    assert set(x) == {"a_b", "first_name"} and all(r["inferred_type"] == "NULL_ONLY" and r["row_count"] == 0 for r in x.values())


def test_nested_columns(spark):
    df = spark.sql("select named_struct('street', 's', 'geo', named_struct('zip', 1)) as loc, array(1, 2) as tags")
    assert text.flattened(df).columns == ["loc_street", "loc_geo_zip", "tags"]
    assert columns(df)["tags"]["sample_values"] == ["[1,2]"]


@pytest.mark.parametrize("value, want", [(1e-5, "1e-05"), (1e10, "10000000000.0"), (0.0005, "0.0005"), (1e16, "1e+16"), (3.5, "3.5"), (-2e7, "-20000000.0"), (123456789.25, "123456789.25")])
def test_floats_are_written_shortest(spark, value, want):
    assert spark.createDataFrame([(value,)], "x double").select(text.float_text(F.col("x"))).first()[0] == want == repr(value)


def test_names():
    assert text.standard_names(["First Name", "1st", "!!!", "A", "a", " A "]) == ["first_name", "col_1st", "unnamed", "a", "a_2", "a_3"]


def test_references_and_diagram(spark):
    customers = spark.range(1, 101).select("id", F.concat(F.lit("name "), "id").alias("name"))
    orders = spark.range(200).select(F.col("id").alias("order_id"), (F.col("id") % 100 + 1).alias("customer_id"))
    p = profile.column_profiles(customers, "customers").unionByName(profile.column_profiles(orders, "orders"))
    found = relationships.candidates(p)
    best = found.orderBy(F.desc("confidence")).first()
    assert (best["fk_table"], best["fk_column"], best["pk_table"], best["pk_column"]) == ("orders", "customer_id", "customers", "id") and best["confidence"] >= 0.7
    drawn = diagram.diagram(p, found)
    assert 'customers ||--o{ orders : "customer_id -> id"' in drawn and "int customer_id FK" in drawn
    assert diagram.last_diagram(drawn).startswith("erDiagram")
    assert enrich.summaries(p, lambda text: "told " + text.splitlines()[0]).where("table_name = 'orders'").first()["summary"] == "told Table: orders"
    for name, frame in charts.FRAMES.items():
        assert frame(p).count() >= (0 if name == "quality_heatmap" else 1)
    assert quality.summary(p).count() == 2 and api.get_table_relationships(found, "orders").count() >= 1


def test_enrichment_runs_end_to_end(spark):
    a = spark.range(50).select("id", F.lit("x").alias("kind"))
    p = profile.column_profiles(a, "things").unionByName(profile.column_profiles(a, "others"))
    out = api.enrich_relationships(p)
    assert out["documents"].count() == 4 and "erDiagram" in out["diagram"]
    assert api.query_knowledge_base(out["documents"], "table things column kind", 1).first()["table_name"] == "things"


def test_component_labels(spark):
    n = 40
    edges = [((str(i).zfill(3),), (str(i + 1).zfill(3),)) for i in range(n) if i != 20]
    df = spark.createDataFrame(edges, "a struct<n:string>, b struct<n:string>")
    got = {r["node"]["n"]: r["label"]["n"] for r in clusters.components(df).collect()}
    assert set(got.values()) == {"000", "021"} and got["020"] == "000" and got["040"] == "021"


def test_table_clusters(spark):
    names = [f"t{i:02d}" for i in range(20)]
    assert clusters.table_clusters(names, spark.createDataFrame([], "table_a string, table_b string, affinity double")) == {0: names[:15], 1: names[15:]}
    near = spark.createDataFrame([(a, b, 1.0 if (i < 10) == (j < 10) else 0.01) for i, a in enumerate(names) for j, b in enumerate(names) if a < b], "table_a string, table_b string, affinity double")
    assert sorted(clusters.table_clusters(names, near).values()) == [names[:10], names[10:]]
    assigned = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "cluster int, table_name string")
    full = clusters.with_missing(assigned, spark.createDataFrame([("a",), ("d",)], "table_name string"))
    assert sorted(map(tuple, full.collect())) == [(0, "a"), (0, "b"), (1, "c"), (1, "d")]


def test_samples(spark):
    df = spark.range(1000)
    assert sampling.hash_sample(df, "id", 10).collect() == sampling.hash_sample(df.repartition(7), "id", 10).collect()
    assert sorted(r[0] for r in sampling.skip_sample(df, "id", 100).collect()) == list(range(0, 1000, 100))


def test_large_tables_stay_exact(spark):
    df = spark.range(2000).select("id", (F.col("id") % 7).alias("few"), F.when(F.col("id") % 4 == 0, "n/a").otherwise("v").alias("s"))
    small = columns(df)
    large = {r["name"]: r for r in profile.column_profiles(df, "t", Settings(exact_distinct_rows=100)).collect()}
    for c in small:
        for f in ("inferred_type", "null_count", "row_count", "min", "max", "mean", "skewness", "avg_length", "is_key_candidate", "quality_flags"):
            assert small[c][f] == large[c][f], (c, f)
        assert large[c]["is_distinct_count_exact"] and large[c]["distinct_count"] == small[c]["distinct_count"]
    assert large["few"]["top_values"][0]["count"] == 286 and abs(large["id"]["median"] - 999.5) <= 2 and large["s"]["sample_values"] == ["v"]


def test_large_tables_have_the_figures_of_small_ones(spark):
    df = spark.range(30_000).select("id", (F.col("id") * 37 % 101 / 4).alias("few"), F.concat(F.lit("k"), F.col("id") % 20_000).alias("s"), F.when(F.col("id") % 3 == 0, F.col("id") * F.col("id")).alias("gaps"))
    small = {r["name"]: r.asDict(recursive=True) for r in profile.column_profiles(df, "t", Settings()).collect()}
    large = {r["name"]: r.asDict(recursive=True) for r in profile.column_profiles(df, "t", Settings(exact_distinct_rows=100)).collect()}
    for x in [*small.values(), *large.values()]:
        del x["is_distinct_count_exact"]
    assert large == small and large["id"]["distinct_count"] == 30_000 and large["id"]["is_key_candidate"] and large["s"]["sample_values"] == ["k0", "k1", "k10", "k100", "k1000"]
