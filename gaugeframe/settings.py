"""Every threshold and vocabulary of the engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    memory_safe_bytes: int = 100 * 1024**2
    lazy_scan_bytes: int = 2 * 1024**3
    csv_probe_rows: int = 100
    csv_delimiters: tuple[str, ...] = (",", "\t", "|", ";")
    corruption_threshold: float = 0.05
    sample_rows: int = 10_000
    skip_interval: int = 100
    match_threshold: float = 0.90
    categorical_max_distinct: int = 50
    free_text_min_length: float = 100.0
    json_schema_records: int = 1_000
    json_max_depth: int = 3
    top_values: int = 10
    sample_values: int = 5
    exact_distinct_rows: int = 1_000_000
    sparse_ratio: float = 0.70
    high_cardinality: float = 0.90
    low_cardinality: float = 0.10
    key_ratio: float = 0.99
    near_key_ratio: float = 0.95
    fk_min_percent: int = 50
    diagram_min_percent: int = 70
    min_stem: int = 3
    affinity: float = 0.65
    neighbours: int = 5
    cluster_tables: int = 15


DEFAULT = Settings()

# Tokens that stand for a missing value, compared in lower case after trimming.
NULL_TOKENS = ("null", "none", "na", "n/a", "nan", "nil", "-", "--", ".", "missing", "undefined")
# Tokens of a truth value and what they become.
TRUE_TOKENS = ("true", "yes", "y", "t", "1")
FALSE_TOKENS = ("false", "no", "n", "f", "0")
# Date formats in the order they are tried, as (Spark pattern, label).
DATE_FORMATS = (
    ("yyyy-MM-dd", "YYYY-MM-DD"),
    ("yyyyMMdd", "YYYYMMDD"),
    ("dd/MM/yyyy", "DD/MM/YYYY"),
    ("MM/dd/yyyy", "MM/DD/YYYY"),
    ("dd-MM-yyyy", "DD-MM-YYYY"),
    ("MM-dd-yyyy", "MM-DD-YYYY"),
)
# Names of foreign keys that only record who changed a row.
AUDIT_COLUMNS = ("lasteditedby", "last_edited_by", "createdby", "created_by", "modifiedby", "modified_by", "updatedby", "updated_by")
# Type names in diagrams.
TYPE_LABELS = {
    "INTEGER": "int", "FLOAT": "float", "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "timestamp", "UUID": "uuid",
    "STRING": "string", "FREE_TEXT": "text", "CATEGORICAL": "categorical", "MIXED_DATE": "mixed_date", "NULL_ONLY": "null",
}

NUMERIC = ("INTEGER", "FLOAT")
NO_RANGE = ("NULL_ONLY", "BOOLEAN", "FREE_TEXT")
NOT_A_KEY = ("FREE_TEXT", "BOOLEAN", "NULL_ONLY", "MIXED_DATE")
NOT_RELATED = ("FREE_TEXT", "BOOLEAN", "NULL_ONLY")
LENGTH_TYPES = ("STRING", "CATEGORICAL", "UUID", "FREE_TEXT", "MIXED_DATE")
ID_TYPES = ("STRING", "INTEGER", "UUID")
