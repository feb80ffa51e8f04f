"""Remote sources: addresses, credentials, and the Spark reader that opens them."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

REMOTE = ("s3", "gs", "abfss", "snowflake", "postgresql", "postgres")
FORMATS = {".parquet": "parquet", ".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".orc": "orc"}
# The environment variables that the sources' own tools read.
ENVIRONMENT = {
    "s3": {"access_key": "AWS_ACCESS_KEY_ID", "secret_key": "AWS_SECRET_ACCESS_KEY", "region": "AWS_DEFAULT_REGION"},
    "gs": {"key_file": "GOOGLE_APPLICATION_CREDENTIALS"},
    "abfss": {"account_key": "AZURE_STORAGE_KEY"},
    "postgresql": {"user": "PGUSER", "password": "PGPASSWORD"},
    "snowflake": {"user": "SNOWFLAKE_USER", "password": "SNOWFLAKE_PASSWORD"},
}


@dataclass
class Source:
    """Where some data is. For databases: host, database, schema and table; for stores: bucket (or container) and path."""

    scheme: str
    host: str
    path: str
    raw: str
    connection: str | None = None
    database: str | None = None
    schema: str | None = None
    table: str | None = None
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    port: int | None = None
    params: dict = field(default_factory=dict)

    @property
    def is_remote(self) -> bool:
        return self.scheme != "file"

    @property
    def is_directory(self) -> bool:
        """A place with several tables: a path without a file's ending, or a database without a table."""
        if self.scheme in ("postgresql", "snowflake"):
            return not self.table
        return "." not in self.path.rsplit("/", 1)[-1]


def is_remote(uri: str) -> bool:
    head, _, rest = uri.strip().partition("://")
    return bool(rest) and head.lower() in REMOTE


def parsed(uri: str, connection: str | None = None) -> Source:
    """s3://bucket/key, gs://, abfss://container@account/path, postgresql://user@host:port/db/schema.table, snowflake://account/db/schema/table."""
    raw = uri.strip()
    if not is_remote(raw):
        return Source("file", "", raw, raw, connection)
    u = urlparse(raw)
    scheme = {"postgres": "postgresql"}.get(u.scheme.lower(), u.scheme.lower())
    params = {k: v[0] if len(v) == 1 else v for k, v in parse_qs(u.query).items()}
    out = Source(scheme, u.hostname or "", u.path.lstrip("/"), raw, connection, params=params)
    if scheme in ("s3", "gs"):
        out.host = u.netloc
    elif scheme == "abfss":
        out.host = u.netloc
    else:
        parts = [unquote(p) for p in u.path.split("/") if p]
        out.user, out.password, out.port = u.username and unquote(u.username), u.password and unquote(u.password), u.port
        out.database = parts[0] if parts else None
        rest = parts[1:]
        if len(rest) == 1 and scheme == "postgresql":
            rest = rest[0].split(".", 1) if "." in rest[0] else ["public", rest[0]]
        out.schema = rest[0] if rest else params.get("schema")
        out.table = rest[1] if len(rest) > 1 else None
    return out


def quoted(name: str) -> str:
    """An SQL identifier, safe whatever is in it."""
    return '"' + name.replace('"', '""') + '"'


def literal(text: str) -> str:
    """An SQL string, safe whatever is in it."""
    return "'" + text.replace("'", "''") + "'"


def conninfo(value: str) -> str:
    """A value of a libpq connection string."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def store_options(s: Source, credentials: dict) -> tuple[str, str, dict[str, str]]:
    """(format, path, Hadoop options) of an object store's file."""
    ending = os.path.splitext(s.path.removesuffix(".gz"))[1].lower()
    path = {"s3": f"s3a://{s.host}/{s.path}", "gs": f"gs://{s.host}/{s.path}", "abfss": f"abfss://{s.host}/{s.path}"}[s.scheme]
    options = {}
    if s.scheme == "s3" and credentials.get("access_key"):
        options = {"fs.s3a.access.key": credentials["access_key"], "fs.s3a.secret.key": credentials.get("secret_key", "")}
    elif s.scheme == "gs" and credentials.get("key_file"):
        options = {"fs.gs.auth.service.account.json.keyfile": credentials["key_file"]}
    elif s.scheme == "abfss" and credentials.get("account_key"):
        options = {f"fs.azure.account.key.{s.host.partition('@')[2]}": credentials["account_key"]}
    return FORMATS.get(ending, "parquet"), path, options


def table_options(s: Source, credentials: dict, query: str | None = None) -> tuple[str, dict[str, str]]:
    """(format, reader options) of a database table, or of a query on it."""
    user, password = s.user or credentials.get("user", ""), s.password or credentials.get("password", "")
    name = ".".join(quoted(x) for x in (s.schema, s.table) if x)
    if s.scheme == "postgresql":
        out = {"url": f"jdbc:postgresql://{s.host}:{s.port or 5432}/{s.database}", "driver": "org.postgresql.Driver", "user": user, "password": password, "fetchsize": "10000"}
        return "jdbc", out | ({"query": query} if query else {"dbtable": name})
    out = {"sfURL": f"{s.host}.snowflakecomputing.com", "sfUser": user, "sfPassword": password, "sfDatabase": s.database or "", "sfSchema": s.schema or "PUBLIC"}
    if s.params.get("warehouse"):
        out["sfWarehouse"] = s.params["warehouse"]
    return "snowflake", out | ({"query": query} if query else {"dbtable": quoted(s.table or "")})


def tables_query(s: Source) -> str:
    """The tables of a schema, by the catalog that both databases have."""
    where = f"table_schema = {literal(s.schema)}" if s.schema else "table_schema not in ('pg_catalog', 'information_schema', 'INFORMATION_SCHEMA')"
    return f"select table_schema, table_name from information_schema.tables where {where} order by table_schema, table_name"


def schemas_query() -> str:
    return "select schema_name from information_schema.schemata where schema_name not in ('pg_catalog', 'information_schema', 'INFORMATION_SCHEMA') order by schema_name"


Opener = Callable[[SparkSession, Source, dict], DataFrame]


def _open_store(spark: SparkSession, s: Source, credentials: dict) -> DataFrame:
    form, path, options = store_options(s, credentials)
    for k, v in options.items():
        spark._jsc.hadoopConfiguration().set(k, v)
    reader = spark.read.format(form)
    return (reader.option("header", True) if form == "csv" else reader).load(path)


def _open_table(spark: SparkSession, s: Source, credentials: dict) -> DataFrame:
    form, options = table_options(s, credentials)
    return spark.read.format(form).options(**options).load()


_OPENERS: dict[str, Opener] = {"s3": _open_store, "gs": _open_store, "abfss": _open_store, "postgresql": _open_table, "snowflake": _open_table}


def register_connector(scheme: str, opener: Opener) -> None:
    """Adds or replaces the reader of a scheme."""
    _OPENERS[scheme] = opener


class Connections:
    """Credentials by connection id; without one, those of the environment."""

    def __init__(self):
        self._known: dict[str, tuple[str, dict]] = {}

    def connect(self, connection: str, scheme: str, **credentials: str) -> None:
        self._known[connection] = (scheme, credentials)

    def list(self) -> list[tuple[str, str]]:
        return sorted((k, scheme) for k, (scheme, _) in self._known.items())

    def remove(self, connection: str) -> bool:
        return self._known.pop(connection, None) is not None

    def credentials(self, s: Source) -> dict:
        if s.connection in self._known:
            return self._known[s.connection][1]
        return {k: os.environ[v] for k, v in ENVIRONMENT.get(s.scheme, {}).items() if v in os.environ}

    def open(self, spark: SparkSession, uri: str, connection: str | None = None) -> DataFrame:
        s = parsed(uri, connection)
        if s.scheme not in _OPENERS:
            raise ValueError(f"no connector for {s.scheme}")
        return _OPENERS[s.scheme](spark, s, self.credentials(s))

    def catalog(self, spark: SparkSession, uri: str, connection: str | None = None, schemas: bool = False) -> DataFrame:
        """Tables (or schemas) of a database."""
        s = parsed(uri, connection)
        form, options = table_options(s, self.credentials(s), schemas_query() if schemas else tables_query(s))
        return spark.read.format(form).options(**options).load()

    def test(self, spark: SparkSession, uri: str, connection: str | None = None) -> str | None:
        """Why the source can't be opened, or None."""
        try:
            self.open(spark, uri, connection).limit(1).count()
        except Exception as e:  # whatever the connector raises is the answer
            return str(e).splitlines()[0]
        return None
