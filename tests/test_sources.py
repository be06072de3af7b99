import json

import pytest
from pyspark.sql import functions as F

from tallymark.functions import predicates as P
from tallymark.operators import contract as C
from tallymark.sources import readers as R
from tallymark.sources import sinks as Z


def test_analysis_and_layout(spark, tmp_path):
    doc = {
        "source": "a.pdf",
        "documents": [{"fields": {"AccountNumber": {"content": "123", "confidence": 0.9}, "Memo": {"content": ""}}}],
        "tables": [{"row_count": 1, "column_count": 2, "cells": [
            {"content": "b", "row_index": 0, "column_index": 1}, {"content": "a", "row_index": 0, "column_index": 0}]}],
        "content": "x\ny",
    }
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"source": "b.pdf", "content": ""}))
    raw = R.read_analysis(spark, str(tmp_path))
    s = {r.source: r for r in R.analysis_to_statement(raw).collect()}
    assert s["a.pdf"].account_number == "123" and s["a.pdf"].ocr_text_lines == ["x", "y"] and len(s["a.pdf"].raw_fields) == 1
    assert s["b.pdf"].ocr_text_lines == [] and s["b.pdf"].bank_name is None
    assert [r.cells for r in R.layout_rows(raw).collect()] == [["a", "b"]]


def test_sniffing_with_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v,w\n1,"a,b",c\n2,"q""t",d\n')
    (tmp_path / "b.csv").write_text(" k;v; w1 \n3;x;y\n")
    (tmp_path / "c.csv").write_text("only\none\n")
    rows = R.sniff_rows(R.read_texts(spark, str(tmp_path), "*.csv")).collect()
    assert [set(r.cells) for r in rows if r.delimiter == ";"] == [{"k", "v", "w1"}]
    got = {(r.delimiter, r.cells.get("k"), r.cells.get("v"), r.cells.get("only")) for r in rows}
    assert got == {(",", "1", "a,b", None), (",", "2", 'q"t', None), (";", "3", "x", None), (",", None, None, "one")}


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


def test_a_large_file_is_sniffed_by_several_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n k ;v\r\n" + "".join(f'{i};"x;{i}"\r\n\n' for i in range(3000)))
    (tmp_path / "b.csv").write_text("k|v\n1|2\n")
    (tmp_path / "c.csv").write_text("")
    want = {(";", str(i), f"x;{i}") for i in range(3000)} | {("|", "1", "2")}
    try:
        for size in (4000, 1 << 27):
            small_splits(spark, size)
            rows = R.read_sniffed(spark, str(tmp_path), "*.csv")
            assert (rows.rdd.getNumPartitions() > 5) == (size == 4000)
            got = rows.collect()
            assert len(got) == len(want) and {(r.delimiter, r.cells["k"], r.cells["v"]) for r in got} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_list_order_under_any_split_size(spark, tmp_path):
    for f in range(3):
        lines = "".join(f"Bank {f}-{i},x,{f * 1000 + i},{i}\n" for i in range(400))
        (tmp_path / f"r{f}.csv").write_text("Bank Name,Address,Account Number,Routing Number\n" + lines)
    want = [(n + 1, f"Bank {n // 400}-{n % 400}") for n in range(1200)]
    try:
        for size in (1000, 7777, 1 << 27):
            small_splits(spark, size)
            got = sorted((r.ordinal, r.bank_name) for r in R.read_registry(spark, str(tmp_path)).collect())
            assert got == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_dispatch_reads_no_file_for_a_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y z\n")
    (tmp_path / "b.json").write_text('{"id": 3, "name": "z", "extra": {"k": [1]}}\n{"id": "4"}\n')
    spark.sparkContext.setJobGroup("dispatch-plan", "")
    df = R.dispatch(spark, str(tmp_path), {"id": "string", "name": "string", "it's": "int"})
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("dispatch-plan")
    got = sorted(tuple(r) for r in df.select("source_kind", "id", "name").collect())
    assert got == [("csv", "1", "x"), ("csv", "2", "y z"), ("json", "3", "z"), ("json", "4", None)]
    assert R.dispatch(spark, str(tmp_path)).columns == ["source_kind", "record"]


def test_registry(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Bank Name,Address,Account Number,Routing Number\n Harbor ,x,00123.0,011\n")
    r = R.read_registry(spark, str(tmp_path)).collect()[0]
    assert (r.bank_name, r.account_number, r.routing_number) == ("Harbor", "00123", "011")


def test_json_shapes(spark):
    df = spark.createDataFrame([("a", '[{"x":1},{"x":2}]'), ("b", '{"x":3}'), ("c", " 7 ")], "path string, text string")
    got = {(r.path, r.row_no): r.record for r in R.json_rows(df).collect()}
    assert got == {("a", 0): '{"x":1}', ("a", 1): '{"x":2}', ("b", 0): '{"x":3}', ("c", 0): '{"data":7}'}


def test_catalog_and_retention(spark, tmp_path):
    for d, n in (("archive", 2), ("inbox", 1)):
        (tmp_path / d).mkdir()
        for i in range(n):
            (tmp_path / d / f"f{i}.bai").write_text("x" * (i + 1))
    c = R.catalog(spark, str(tmp_path))
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]
    assert sorted((r.folder, r.file_name, r["size"]) for r in c.collect()) == [
        ("archive", "f0.bai", 1), ("archive", "f1.bai", 2), ("inbox", "f0.bai", 1),
    ]
    keep = c.withColumn("file_name", F.when(F.col("file_name") == "f0.bai", ".placeholder").otherwise(F.col("file_name")))
    r = R.retention(keep, ["archive"], ".placeholder").collect()
    assert [(x.folder, x.total_files, x.files_to_delete, x.kept_files) for x in r] == [("archive", 2, 1, 1)]


def test_content_class(spark):
    values = [
        b"<!DOCTYPE html>", b"PK\x03\x04....xl/workbook", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", b' {"a": 1}\n', b"a,b,c\nd,e,f\n",
        b"a;b;c\nd;e;f\n", b"a\tb\tc\nd\te\tf\n", b"plain\n", b"caf\xe9",
        b"\n{" + b'"k": 1,\n' * 2000 + b'"z": 2}', b"{" + b"a,b,c\n" * 2000,
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, b binary")
    got = [r[0] for r in df.orderBy("i").select(P.content_class("b")).collect()]
    assert got == ["html", "xlsx", "xls", "json", "csv_comma", "csv_semicolon", "csv_tab", "text", "unknown", "json", "csv_comma"]
    late = [b"a" * 1500 + b"\xe9", b"x" * 2100 + b"\n" + b"a,b,c\n" * 2000]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(late)], "i int, b binary").orderBy("i")
    assert [r[0] for r in df.select(P.content_class("b")).collect()] == ["text", "text"]
    whole = P.content_class("b", sniff_bytes=None, kind_bytes=None)
    assert [r[0] for r in df.select(whole).collect()] == ["unknown", "csv_comma"]


def test_json_orients(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    Z.write_json(df, str(tmp_path / "r"), "records")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "r")).collect()) == ['{"k":1,"v":"a"}', '{"k":2,"v":null}']
    assert Z.json_header(df, "split") == {"columns": ["k", "v"]}
    assert Z.json_header(df, "table")["schema"]["fields"][0] == {"name": "k", "type": "int"}


def test_bai2_files(spark, tmp_path):
    """A file per document; names are replaced by a replay, and a failed job leaves nothing half done."""
    rows = [("OK", f"a{i}.bai", f"01,{i}/\n99/\n") for i in range(20)] + [("ERROR", "ERROR_b c.bai", "03,ERROR,/"), ("OK", "é.bai", "x")]
    df = spark.createDataFrame(rows, "status string, output_name string, text string").repartition(3)
    audits = spark.createDataFrame([("a1", "- renumbered")], "file_id string, audit_text string")
    path = str(tmp_path / "o")
    for _ in range(2):
        Z.write_bai2(df, path, audits)
        got = Z.read_bai2(spark, path).collect()
        assert sorted((r.status, r.output_name, r.text) for r in got) == sorted(rows)
        assert sorted(p.name for p in (tmp_path / "o" / "OK").iterdir() if not p.name.startswith(".")) == sorted(n for s, n, _ in rows if s == "OK")
        assert json.loads((tmp_path / "o" / "_manifest.json").read_text()) == {"ERROR": 1, "OK": 21}
    assert not list((tmp_path / "o").glob("_staging*"))
    assert [r.audit_text for r in spark.read.json(f"{path}/_audit").collect()] == ["- renumbered"]
    changed = spark.createDataFrame([("OK", "a1.bai", "new"), ("OK", "../x.bai", "bad")], df.schema).coalesce(1)
    with pytest.raises(Exception, match="not a file name"):
        Z.write_bai2(changed, path)
    assert not list((tmp_path / "o").glob("_staging*"))


def test_bai2_files_are_read_by_few_tasks(spark, tmp_path):
    """Names come from the lists of finished jobs: the number of tasks doesn't grow with the files, a file of a
    job that failed is no output, one that is gone or empty gives no row."""
    rows = [("OK", f"a{i}.bai", f"01,{i}/\n") for i in range(300)] + [("ERROR", "e f.bai", "03,ERROR,/"), ("OK", "none.bai", None)]
    df = spark.createDataFrame(rows, "status string, output_name string, text string")
    path = str(tmp_path / "o")
    Z.write_bai2(df.where("false"), path)
    assert Z.read_bai2(spark, path).collect() == []
    Z.write_bai2(df.repartition(3), path)
    Z.write_bai2(df.limit(5), path)
    bad = spark.createDataFrame([("OK", "b1.bai", "new"), ("OK", "../x.bai", "bad")], df.schema).coalesce(1)
    with pytest.raises(Exception, match="not a file name"):
        Z.write_bai2(bad, path)
    (tmp_path / "o" / "OK" / "a7.bai").unlink()
    got = Z.read_bai2(spark, path)
    assert got.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[2] and r[1] != "a7.bai")


def test_contract(spark):
    whole = '```json\n{"account_number": "1", "transactions": [{"date": "2025-01-02", "amount": -5.25, "description": "a [b] \\" c"}]}\n```'
    cut = '{"account_number": "1", "transactions": [{"date": "d", "amount": 1.5, "description": "x"}], "summary": {"to'
    lost = '{"transactions": [{"date": "d", "amount": 1'
    df = spark.createDataFrame([(0, whole), (1, cut), (2, lost)], "i int, text string")
    p = C.parse_statement_json(df)
    assert [r.parse_status for r in p.orderBy("i").collect()] == ["complete", "recovered", "failed"]
    t = {r.i: (r.amount_cents, r.description) for r in C.statement_transactions(p, ("i",)).collect()}
    assert t == {0: (-525, 'a [b] " c'), 1: (150, "x")}


def test_long_paths_keep_all_parts(spark):
    tail = "/".join(f"p{i}" for i in range(1500))
    subject = "/blobServices/default/containers/data/blobs/incoming-bank-statements/" + tail
    url = "https://store.example.com/data/incoming-bank-statements/" + tail
    df = spark.createDataFrame([(0, subject, ""), (1, "", url)], "i int, s string, u string")
    assert {r[0] for r in df.select(P.incoming_path("s", "u")).collect()} == {"incoming-bank-statements/" + tail}
