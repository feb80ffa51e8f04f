"""Readers, stores and streams over small files."""

import gzip
import json
import sqlite3
import zipfile

import duckdb
import pytest

from gaugeframe import api
from gaugeframe.plans import profile
from gaugeframe.sources import delimited, intake, records, remote, store
from gaugeframe.streaming.incremental import ProfileState, followed

CSV = "order_id,customer,amount,active\n1,Alice,99.50,true\n2,Bob,150.00,false\n3,\"Carol, C\",200.00,true\n4,Dave,75.25,false\n"


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_csv_and_gzip(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(CSV)
    with gzip.open(tmp_path / "zipped.csv.gz", "wt") as f:
        f.write(CSV)
    for name in ("orders.csv", "zipped.csv.gz"):
        x = by_name(api.profile_file(spark, str(tmp_path / name)))
        assert [x[c]["inferred_type"] for c in ("order_id", "amount", "active")] == ["INTEGER", "FLOAT", "BOOLEAN"] and x["customer"]["row_count"] == 4
    kinds = {r["path"].rsplit("/", 1)[-1]: r["file_format"] for r in api.list_supported_files(spark, str(tmp_path)).collect()}
    assert kinds == {"orders.csv": "CSV", "zipped.csv.gz": "CSV"}


def test_headers_and_corruption(spark, tmp_path):
    assert delimited.header_of([["1", "Alice"], ["2", "Bob"]]) == (["column_1", "column_2"], False)
    assert delimited.header_of([["id", "name", "name"]]) == (["id", "name", "name_2"], True)
    (tmp_path / "bad.csv").write_text("a\n" + "1\n" * 90 + "1,2,3\n" * 10)
    with pytest.raises(intake.CorruptFile):
        api.profile_file(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(intake.EmptyFile):
        api.profile_file(spark, str(tmp_path / "empty.csv"))
    with pytest.raises(ValueError):
        api.profile_directory(spark, str(tmp_path))


def test_zip_entries_are_one_table(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "parts.zip", "w") as z:
        for k, n in enumerate((3, 2, 4)):
            z.writestr(f"p{k}.csv", "id,val\n" + "".join(f"{k}{i},v{i}\n" for i in range(n)))
        z.writestr("__MACOSX/p0.csv", "junk")
    x = by_name(api.profile_file(spark, str(tmp_path / "parts.zip")))
    assert x["id"]["row_count"] == 9 and x["id"]["distinct_count"] == 9


def test_json_shapes(spark, tmp_path):
    rows = [{"id": 1, "user": {"name": "a", "age": 3}, "tags": [1, 2]}, {"id": 2, "user": {"name": "b", "age": None}}, {"id": 3}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nbroken\n")
    for name in ("a.json", "b.jsonl"):
        x = by_name(api.profile_file(spark, str(tmp_path / name)))
        assert x["id"]["row_count"] == 3 and x["user_age"]["null_count"] == 2 and x["tags"]["sample_values"] == ["[1,2]"]
    (tmp_path / "w.json").write_text(json.dumps({"total": 2, "results": [{"a": 1}, {"a": 2}]}))
    seen = intake.examined(spark, str(tmp_path / "w.json"))
    assert records.read_json(spark, str(tmp_path / "w.json"), seen).count() == 1
    assert records.read_json(spark, str(tmp_path / "w.json"), seen, unwrap=True).count() == 2


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}"><v>{v}</v></c>'
    rows = [["id", "name"], [1.0, "x"], [2.5, "y"]]
    body = "".join("<row>" + "".join(cell(f"{'AB'[j]}{i + 1}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    x = by_name(api.profile_file(spark, str(tmp_path / "w.xlsx")))
    assert x["id"]["sample_values"] == ["1", "2.5"] and x["name"]["row_count"] == 2


def test_database_files(spark, tmp_path):
    with sqlite3.connect(tmp_path / "d.sqlite") as db:
        db.execute("create table t (id integer, note text)")
        db.executemany("insert into t values (?, ?)", [(1, "a"), (2, None), (3, "c")])
    with duckdb.connect(str(tmp_path / "d.duckdb")) as db:
        db.execute("create table t as select range as id, case when range = 1 then null else 'n' end as note from range(3)")
    for name in ("d.sqlite", "d.duckdb"):
        x = by_name(api.run(spark, str(tmp_path / name)))
        assert x["id"]["is_key_candidate"] and x["note"]["null_count"] == 1


def test_addresses():
    s = remote.parsed("s3://bucket/dir/x.parquet")
    assert remote.store_options(s, {"access_key": "k", "secret_key": "s"})[:2] == ("parquet", "s3a://bucket/dir/x.parquet") and not s.is_directory
    p = remote.parsed("postgres://me:p%27w@host:5433/db/public.orders")
    form, options = remote.table_options(p, {})
    assert form == "jdbc" and options["url"] == "jdbc:postgresql://host:5433/db" and options["dbtable"] == '"public"."orders"' and options["password"] == "p'w"
    assert remote.parsed("snowflake://acc/db/sch").is_directory and remote.parsed("/tmp/x.csv").scheme == "file"
    assert remote.quoted('a"b') == '"a""b"' and remote.literal("a'b") == "'a''b'" and remote.conninfo("a'\\") == "'a\\'\\\\'"


def test_connections(spark, tmp_path):
    c = remote.Connections()
    c.connect("mine", "s3", access_key="k")
    remote.register_connector("s3", lambda spark, s, credentials: spark.range(3))
    try:
        assert c.list() == [("mine", "s3")] and c.open(spark, "s3://b/t.parquet", "mine").count() == 3 and c.test(spark, "s3://b/t.parquet") is None
        assert by_name(api.profile_remote(spark, "s3://b/t.parquet", c))["id"]["row_count"] == 3
    finally:
        remote.register_connector("s3", remote._open_store)
    assert c.remove("mine") and not c.list() and "no connector" in c.test(spark, "ftp://x") if remote.is_remote("ftp://x") else True


def test_stores(spark, tmp_path):
    p = profile.column_profiles(spark.range(3), "t")
    s = store.ProfileStore(spark, str(tmp_path / "store"))
    s.put(p)
    s.put(profile.column_profiles(spark.range(5), "t"))
    assert [r["row_count"] for r in s.get("t").collect()] == [5]
    store.write_profile_json(profile.table_profile(p), str(tmp_path / "p.json"))
    assert json.loads((tmp_path / "p.json").read_text())["columns"][0]["name"] == "id"


def test_stream_of_batches(spark, tmp_path):
    source, state = tmp_path / "in", ProfileState(spark, str(tmp_path / "state"))
    source.mkdir()
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id long").parquet(str(source))
        followed(stream, state, str(tmp_path / "checkpoint")).awaitTermination()
        assert state.basics().first()["distinct_count"] == 10 * (k + 1)


def test_quoted_line_ends_utf16_and_broken_files(spark, tmp_path):
    from gaugeframe import api

    (tmp_path / "quoted.csv").write_text("id,note\n" + "".join(f'{i},"two\nlines"\n' for i in range(5)))
    (tmp_path / "wide.csv").write_bytes("id,note\n1,é\n2,ü\n".encode("utf-16"))
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 this is none PAR1")
    quoted, wide = (api.read_file(spark, str(tmp_path / f))[0] for f in ("quoted.csv", "wide.csv"))
    assert [r["note"] for r in quoted.collect()] == ["two\nlines"] * 5 and sorted(r["note"] for r in wide.collect()) == ["é", "ü"]
    found = api.profile_directory(spark, str(tmp_path))
    assert {(r["table_name"], r["row_count"]) for r in found.collect()} == {("quoted", 5), ("wide", 2)}
