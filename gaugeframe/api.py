"""The library's entry points."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.operators import charts, clusters, diagram, drift, quality, relationships, sampling, vectors
from gaugeframe.plans import enrich, profile
from gaugeframe.settings import DEFAULT, Settings
from gaugeframe.sources import delimited, intake, records, remote, store, workbooks
from gaugeframe.sources.files import listed

log = logging.getLogger(__name__)
METRICS: dict[str, list[float]] = {}


@contextmanager
def measured(name: str):
    begin = time.perf_counter()
    try:
        yield
    finally:
        METRICS.setdefault(name, []).append(time.perf_counter() - begin)


def table_name(path: str) -> str:
    base = path.rstrip("/").rsplit("/", 1)[-1]
    for ending in (".gz", ".zip", *intake.SCANNED):
        base = base[: -len(ending)] if base.lower().endswith(ending) else base
    return base


def read_file(spark: SparkSession, path: str, s: Settings = DEFAULT) -> tuple[DataFrame, str, str]:
    """(rows, format, encoding) of any supported file, or of a directory of Parquet files."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path), "PARQUET", "utf-8"
    x = intake.examined(spark, path, s)
    if x.file_format == "PARQUET":
        return spark.read.parquet(path), "PARQUET", "utf-8"
    if x.file_format == "CSV":
        return delimited.read_delimited(spark, path, x, s), "CSV", x.encoding
    if x.file_format == "JSON":
        return records.read_json(spark, path, x, s=s), "JSON", x.encoding
    if x.file_format == "EXCEL":
        return workbooks.read_workbook(spark, path), "EXCEL", "utf-8"
    raise ValueError(f"{path}: {'profile_database reads it' if x.file_format in ('SQLITE', 'DUCKDB') else 'unknown format'}")


def profile_frame(df: DataFrame, name: str, s: Settings = DEFAULT) -> DataFrame:
    return profile.column_profiles(df, name, s)


def profile_file(spark: SparkSession, path: str, s: Settings = DEFAULT, output: str | None = None) -> DataFrame:
    """column_profiles of one file; with output, its nested profile is written there as JSON."""
    with measured("profile_file"):
        df, form, code = read_file(spark, path, s)
        out = profile_frame(df, table_name(path), s)
        if output:
            store.write_profile_json(profile.table_profile(out, file_format=form, path=path, encoding=code), output)
    return out


def profile_directory(spark: SparkSession, path: str, s: Settings = DEFAULT) -> DataFrame:
    """column_profiles of every supported file in a directory; files that can't be read are logged and left out."""
    found = []
    for file, _ in listed(spark, path):
        if file.lower().endswith(intake.SCANNED):
            try:
                found.append(profile_file(spark, file, s))
            except Exception as e:  # noqa: BLE001 - one broken file doesn't end the run; Spark's errors share no narrower class
                log.warning("left out: %s: %s", file, str(e).split("\n")[0])
    if not found:
        raise ValueError(f"no file in {path} can be profiled")
    return reduce(DataFrame.unionByName, found)


def profile_database(spark: SparkSession, path: str, s: Settings = DEFAULT) -> DataFrame:
    """column_profiles of every table of a SQLite or DuckDB file."""
    kind = intake.examined(spark, path, s).file_format
    if kind not in ("SQLITE", "DUCKDB"):
        raise ValueError(f"{path} is no database file")
    return reduce(DataFrame.unionByName, [profile_frame(df, t, s) for t, df in workbooks.read_database(spark, path, kind).items()])


def profile_remote(spark: SparkSession, uri: str, connections: remote.Connections | None = None, connection: str | None = None, s: Settings = DEFAULT) -> DataFrame:
    source = remote.parsed(uri, connection)
    return profile_frame((connections or remote.Connections()).open(spark, uri, connection), source.table or table_name(source.path), s)


def run(spark: SparkSession, path: str, s: Settings = DEFAULT) -> DataFrame:
    """column_profiles of whatever the path is: a file, a database, a directory or a remote address."""
    if remote.is_remote(path):
        return profile_remote(spark, path, s=s)
    if path.rstrip("/").endswith(".parquet"):
        return profile_file(spark, path, s)
    files = listed(spark, path)
    if len(files) == 1 and files[0][0].endswith(path.rstrip("/")):
        kind = intake.examined(spark, path, s).file_format
        return profile_database(spark, path, s) if kind in ("SQLITE", "DUCKDB") else profile_file(spark, path, s)
    return profile_directory(spark, path, s)


def detect_relationships(profiles: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return relationships.candidates(profiles, s)


analyze_relationships = detect_relationships


def enrich_relationships(profiles: DataFrame, s: Settings = DEFAULT, model=None) -> dict[str, DataFrame | str]:
    """Detected and cluster-derived relationships, summaries and the diagram of profiled tables."""
    found = detect_relationships(profiles, s)
    documents = vectors.embedded(enrich.column_documents(profiles))
    members = clusters.column_clusters(documents, s.affinity)
    implied = clusters.derived(members, profiles)
    return {
        "candidates": found, "documents": documents, "clusters": members, "derived": implied,
        "cluster_summaries": clusters.summaries(members, implied, profiles), "table_summaries": enrich.summaries(profiles, model),
        "relationship_documents": enrich.relationship_documents(found), "diagram": diagram.diagram(profiles, found, s),
    }


def get_quality_summary(profiles: DataFrame) -> DataFrame:
    return quality.summary(profiles)


def get_table_relationships(found: DataFrame, table: str) -> DataFrame:
    return relationships.of_table(found, table)


def compare_profiles(now: DataFrame, before: DataFrame) -> DataFrame:
    return drift.column_drift(now, before)


def query_knowledge_base(documents: DataFrame, question: str, k: int = DEFAULT.neighbours, doc_type: str | None = None) -> DataFrame:
    """The documents nearest to a question, both embedded by the same hashing."""
    asked = vectors.embedded(documents.sparkSession.createDataFrame([(question,)], "content string")).first()["embedding"]
    return vectors.search(documents, list(asked), k, doc_type)


def visualize_profile(profiles: DataFrame, chart: str) -> DataFrame:
    """The frame behind a chart, by name."""
    return charts.FRAMES[chart](profiles)


def list_supported_files(spark: SparkSession, path: str) -> DataFrame:
    return intake.supported_files(spark, path)


def sample(df: DataFrame, key: str, k: int = DEFAULT.sample_rows) -> DataFrame:
    return sampling.hash_sample(df, key, k)


def low_cardinality_columns(profiles: DataFrame) -> DataFrame:
    return quality.low_cardinality_columns(profiles.withColumn("column", F.col("name")))
