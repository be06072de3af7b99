import os
import time

from pyspark.sql import functions as F

from tallymark.operators import statement_flow as X
from tallymark.sources import sinks as Z
from tallymark.streaming import ingest as I

GOOD = "Harbor Bank\nAccount Number: 0001234567\nStatement Period 06/01/25 through 06/30/25\nDEBITS\n06-02\nWd\n5.00\nCREDITS\n06-03\nIn\n7.00\n"
NONE = "Harbor Bank\nnothing here\n"


def registry(spark):
    return spark.createDataFrame(
        [(1, "Harbor Bank", "0001234567", "110000001")],
        "ordinal long, bank_name string, account_number string, routing_number string",
    )


def test_files_of_a_folder(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text(GOOD)
    (src / "b.txt").write_text(NONE)
    reg = registry(spark)
    work = lambda b: X.to_files(X.stored_headers(b.select(F.col("file_id").alias("doc_id"), "text")), reg, "250701")

    def run():
        stream = I.read_incoming(spark, str(src), "*.txt")
        I.run_once(stream, work, str(tmp_path / "out"), str(tmp_path / "state"))
        return {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    got = run()
    assert got["a.txt"].status == "OK" and "16,451,500,Z,00001,,Wd/" in got["a.txt"].out_text
    assert got["a.txt"].out_text.startswith("01,110000001,WORKDAY,250630,")
    assert "49,200,4/" in got["a.txt"].out_text
    assert got["b.txt"].code == "ERROR_NO_ACCOUNT" and got["b.txt"].output_name.startswith("ERROR_")
    (src / "c.txt").write_text(GOOD)
    assert set(run()) == {"a.txt", "b.txt", "c.txt"}


def test_batch_equals_stream(spark, tmp_path):
    docs = spark.createDataFrame([("x", GOOD), ("y", NONE)], "doc_id string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    reg = registry(spark)
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    I.run_once(stream, lambda b: X.to_files(X.stored_headers(b), reg, "250701"), str(tmp_path / "out"), str(tmp_path / "state"))
    key = lambda df: sorted((r.doc_id, r.status, r.out_text) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(X.to_files(X.stored_headers(docs), reg, "250701"))


def test_missing_input_is_skipped(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.txt").write_text(n)
    from tallymark.sources.readers import read_texts

    df = read_texts(spark, str(tmp_path))
    df.count()
    os.replace(tmp_path / "a.txt", tmp_path / ".a.gone")
    assert [r.text for r in df.collect()] == ["b"]


def test_archive(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    seen = str(tmp_path / "out")
    for i in range(3):
        (src / f"{i}.txt").write_text(str(i))
        stream = I.read_incoming(spark, str(src), "*.txt", archive=str(tmp_path / "done"), max_files=1)
        I.append_once(stream.select("text"), seen, str(tmp_path / "state"))
        time.sleep(0.2)
    assert sorted(r.text for r in spark.read.parquet(seen).collect()) == ["0", "1", "2"]
    assert any(f.endswith(".txt") for _, _, fs in os.walk(tmp_path / "done") for f in fs)


def test_dedupe_lets_later_replays_pass(spark, tmp_path):
    schema = "url string, subject string, eTag string, ts timestamp"
    rows = [
        [("u", "/blobServices/default/containers/c/blobs/incoming-bank-statements/a", "1", "2025-01-01 00:00:00")] * 2,
        [("u", "/blobServices/default/containers/c/blobs/incoming-bank-statements/b", "1", "2025-01-01 02:00:00")],
        [("u", "/blobServices/default/containers/c/blobs/incoming-bank-statements/a", "1", "2025-01-01 03:00:00")],
    ]
    for i, batch in enumerate(rows):
        df = spark.createDataFrame(batch, "url string, subject string, eTag string, t string")
        df.select("url", "subject", "eTag", F.to_timestamp("t").alias("ts")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        fresh = I.dedupe_events(I.incoming_events(stream), "10 minutes")
        I.append_once(fresh, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(str(r.ts) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["2025-01-01 00:00:00", "2025-01-01 02:00:00", "2025-01-01 03:00:00"]


def test_a_key_is_held_until_its_processing_ends(spark, tmp_path):
    """Starts before the finish are dropped, in the same and in later micro-batches; after it they pass. State is
    bounded by the keys in flight."""
    I.use_rocksdb(spark)
    batches = [
        [("a", "start", 1), ("a", "start", 2), ("b", "start", 3), ("c", "finish", 4), ("c", "start", 5), ("c", "finish", 6)],
        [("a", "start", 10), ("b", "finish", 11), ("b", "start", 12), ("c", "start", 13), ("c", "start", 14)],
        [("a", "finish", 20), ("a", "start", 21), ("b", "finish", 22), ("c", "finish", 23), ("a", "finish", 24)],
        [("c", "start", 30), ("a", "start", 31), ("a", "start", 32)],
    ]
    schema = "path string, eTag string, kind string, ts timestamp, seq long"
    kept = []
    for batch in batches:
        rows = spark.createDataFrame([(p, "1", k, n) for p, k, n in batch], "path string, eTag string, kind string, seq long")
        rows.select("path", "eTag", "kind", F.timestamp_seconds("seq").alias("ts"), "seq").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = (
            I.dedupe_in_flight(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r.path, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1), ("a", 21), ("a", 31), ("b", 3), ("b", 12), ("c", 5), ("c", 13), ("c", 30)]
    assert kept[-1] <= 2 and kept[2] == 0


def test_a_key_asks_the_state_store_only_what_it_needs():
    import datetime

    import pandas as pd

    calls = []

    class State:
        held = None

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def update(self, value):
            calls.append("update")
            self.held = value

        def clear(self):
            calls.append("clear")
            self.held = None

    state = State()
    worker = I.in_flight_processor()()
    worker.since = state

    def give(*kinds):
        calls.clear()
        rows = [(k, datetime.datetime(2025, 1, 1, 0, 0, i), i) for i, k in enumerate(kinds)]
        frames = worker.handleInputRows(("p", "1"), iter([pd.DataFrame(rows, columns=["kind", "ts", "seq"])]), None)
        return [n for f in frames for n in f["seq"]], list(calls)

    assert give("start", "start") == ([0], ["exists", "update"])
    assert give("start") == ([], ["exists"])
    assert give("finish", "start") == ([1], ["update"])
    assert give("start", "finish") == ([], ["exists", "clear"])
    assert give("start", "finish") == ([0], ["exists"]) and state.held is None


def test_archive_moves_every_file_once(spark, tmp_path):
    src, done = tmp_path / "in", tmp_path / "done"
    for i in range(5):
        spark.createDataFrame([(f"d{i}", f"text {i}")], "doc_id string, text string").coalesce(1).write.mode("append").parquet(str(src))
    names = lambda d: sorted(f for _, _, fs in os.walk(d) for f in fs if f.startswith("part"))
    before = names(src)

    def run():
        stream = spark.readStream.schema("doc_id string, text string").option("maxFilesPerTrigger", 2).option(
            "cleanSource", "archive").option("sourceArchiveDir", str(done)).parquet(str(src))
        Z.archive_once(stream, lambda b: b, str(tmp_path / "out"), str(tmp_path / "state"))

    run()
    spark.createDataFrame([], "doc_id string, text string").coalesce(1).write.mode("append").parquet(str(src))
    for _ in range(2):  # a second run finds nothing to do
        run()
        assert names(done) == before and not set(names(src)) & set(before)
        got = sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == [f"d{i}" for i in range(5)]


def test_a_registry_index_answers_as_the_registry(spark, tmp_path):
    from tallymark.operators import match as M

    reg = registry(spark)
    docs = spark.createDataFrame([("0001234567", "x"), ("XXXXXX4567", "y"), ("***9", None)], "account string, bank_name string")
    index = M.registry_index(reg).stored(str(tmp_path / "index"))
    key = lambda x: sorted(map(str, M.resolve_lookups(M.lookups(docs), x).collect()))
    assert key(index) == key(reg)


def test_call_report(spark):
    df = spark.range(70).select(F.to_timestamp(F.lit("2025-01-01 00:00:10")).alias("ts"))
    r = I.call_report(df).collect()
    assert [(x.calls, x.quota_exceeded) for x in r] == [(70, True)]
