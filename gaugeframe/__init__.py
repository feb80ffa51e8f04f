"""Spark-first profiling engine: column statistics, semantic types, quality flags and table relationships."""
