"""Streaming forms, run to the end of the available input, and the batch twin of the ingest."""

from pyspark.sql import functions as F

from tallymark.functions.predicates import error_code_from_message
from tallymark.operators import error_files as E
from tallymark.operators import match as M
from tallymark.operators import statement_flow as X
from tallymark.plans import oracle_views as V
from tallymark.plans import sqltext as Q
from tallymark.plans import workload as W
from tallymark.plans.catalogue import query
from tallymark.plans.match_queries import _MATCH
from tallymark.plans.text_queries import _TXNS
from tallymark.session import work_dir
from tallymark.sources import readers as R
from tallymark.streaming import ingest as I

# Header fields of the printed statements as they should be read; the match itself is the one
# checked for ``match_account``, over these instead of the detected forms.
_AC = V.acct12("account")
_FIELDS = f"""detected AS (SELECT doc_id, 'First National Bank of NATION' AS bank_name,
   CASE account % 5 WHEN 0 THEN {_AC} WHEN 1 THEN {_AC} WHEN 2 THEN 'XXXXXX' || right({_AC}, 4) WHEN 3 THEN 'XXXXXX' || right({_AC}, 4) END AS account
   FROM (SELECT DISTINCT doc_id, account FROM ledger))"""
_FLOW = (
    _MATCH.replace(V.DETECTED, V.LEDGER + ",\n" + _FIELDS)
    + f""", {_TXNS},
  coded AS (SELECT res.doc_id, matched_ordinal, CASE WHEN account IS NULL THEN 'ERROR_NO_ACCOUNT' WHEN matched_ordinal IS NOT NULL THEN NULL
     WHEN match_type = 'multiple_accounts_low_similarity' THEN 'ERROR_MULTIPLE_ACCOUNTS_LOW_SIMILARITY'
     WHEN match_type = 'multiple_accounts_no_bank_name' THEN 'ERROR_MULTIPLE_ACCOUNTS_NO_BANK' ELSE 'ERROR_NO_ROUTING' END AS code FROM res),
  body AS (SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN section = 'debits' THEN -amount_cents ELSE amount_cents END) AS BIGINT) AS b,
     string_agg('16,' || CASE WHEN txn_type = 'fee' THEN '475' WHEN section = 'credits' THEN '301' ELSE '451' END || ',' || CAST(amount_cents AS VARCHAR) || ',Z,' || lpad(CAST(k AS VARCHAR), 5, '0') || ',,' || {Q.sanitize('description')} || '/' || chr(10), '' ORDER BY k) AS lines
     FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, entry_no) AS k FROM txns) GROUP BY doc_id)
  SELECT c.doc_id, code, CASE WHEN code IS NULL THEN 'OK' ELSE 'ERROR' END AS status, CASE WHEN code IS NULL THEN '' ELSE 'ERROR_' END || c.doc_id || '.bai' AS output_name,
    CASE WHEN code IS NULL THEN '01,' || routing_number || ',WORKDAY,250630,0000,1,,,2/' || chr(10) || '02,WORKDAY,' || routing_number || ',1,250630,,USD,2/' || chr(10) || '03,' || account_number || ',USD,010,,,Z/' || chr(10)
      || lines || '49,' || CAST(b AS VARCHAR) || ',' || CAST(n + 2 AS VARCHAR) || '/' || chr(10) || '98,' || CAST(b AS VARCHAR) || ',1,' || CAST(n + 4 AS VARCHAR) || '/' || chr(10) || '99,' || CAST(b AS VARCHAR) || ',1,' || CAST(n + 6 AS VARCHAR) || '/' || chr(10)
    ELSE concat_ws(chr(10), '01,ERROR,WORKDAY,250630,0000,1,,,2/', '02,ERROR,000000000,1,250630,,USD,2/', '03,ERROR,USD,010,,,Z/', '88,999,' || code || ',,Z/', '49,0,3/', '98,0,1,5/', '99,0,1,7/') || chr(10) END AS records
  FROM coded c JOIN body ON c.doc_id = body.doc_id LEFT JOIN registry r ON matched_ordinal = r.ordinal"""
)


def _records(files):
    return files.select(
        "doc_id", "code", "status", "output_name", F.regexp_extract("out_text", r"(?ms)^(01,.*)", 1).alias("records")
    )


@query("statement_to_bai2", _FLOW)
def statement_to_bai2(spark, sf):
    docs = W.statements(spark, sf).select("doc_id", "text")
    return _records(X.to_files(X.stored_headers(docs), W.registry(spark, sf), W.DAY))


@query("stream_ingest", _FLOW)
def stream_ingest(spark, sf):
    """The same work as a stream of several micro-batches: files of documents in, output files out, one
    folder per micro-batch, which a replay overwrites. The registry's index is written and the expressions are built once, before."""
    base = work_dir(spark, "ingest")
    W.statements(spark, sf).select("doc_id", "text").repartition(24, "doc_id").write.parquet(f"{base}/in")
    index = M.registry_index(W.registry(spark, sf)).stored(f"{base}/registry")
    docs = spark.readStream.schema("doc_id string, text string").option("maxFilesPerTrigger", 8).parquet(f"{base}/in")
    flow = X.Flow(W.DAY)
    work = lambda b: flow.files(flow.headers(b), index)
    I.run_once(docs, work, f"{base}/out", f"{base}/state")
    return _records(spark.read.parquet(f"{base}/out"))


@query(
    "stream_missing_input",
    "SELECT c_custkey, c_name FROM customer WHERE (c_custkey % 40) % 5 <> 0",
)
def stream_missing_input(spark, sf):
    """Files that vanish between two micro-batches of a running query, after they were listed, are skipped.

    Customers are files of forty keys; the first wave of files is read by the first micro-batch, which then
    removes every fifth key of the second wave. Those files are listed already and gone when their batch comes."""
    base = work_dir(spark, "missing")
    c = W.table(spark, sf, "customer").select((F.col("c_custkey") % 40).alias("key"), "c_custkey", "c_name")
    gone = F.col("key") % 5 == 0
    wave = ~gone & (F.col("key") < 20)
    for rows in (c.where(wave), c.where(~wave)):
        rows.repartition("key").write.partitionBy("key").mode("append").option("maxRecordsPerFile", 2000).csv(f"{base}/in")
    first = R.catalog(spark, f"{base}/in", glob="*.csv").where(F.regexp_extract("folder", r"key=(\d+)", 1).cast("int") < 20)
    first = first.where(F.regexp_extract("folder", r"key=(\d+)", 1).cast("int") % 5 != 0).count()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def work(batch, batch_id):
        line = F.explode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("line")
        cells = batch.select(line).select(F.split("line", ",", 2).alias("c"))
        rows = cells.select(F.col("c")[0].cast("long").alias("c_custkey"), F.col("c")[1].alias("c_name"))
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")
        if batch_id == 0:
            for key in range(0, 40, 5):
                folder = jvm.org.apache.hadoop.fs.Path(f"{base}/in/key={key}")
                folder.getFileSystem(conf).delete(folder, True)

    stream = I.read_incoming(spark, f"{base}/in", glob="*.csv", max_files=max(1, first))
    I.run_batches(stream, work, f"{base}/state")
    out = spark.read.schema("c_custkey long, c_name string, batch long").parquet(f"{base}/out")
    return out.select("c_custkey", "c_name")


def _event_stream(spark, sf, derive, name):
    """Derived event rows as a parquet folder and a stream over it."""
    base = work_dir(spark, name)
    rows = derive(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(f"{base}/in")
    return base, spark.readStream.schema(rows.schema).parquet(f"{base}/in")


_STARTS = """starts AS (SELECT event_id, ts, 'incoming-bank-statements/' || split_part(url, '/', 6) AS path, etag, CASE WHEN event_id % 3 = 0 THEN 'finish' ELSE 'start' END AS kind
    FROM incoming WHERE event_id % 5 <> 0)"""


# Files that each third of the events is written to, and read from by a micro-batch.
_WAVE_FILES = 24


@query(
    "stream_dedupe",
    V.ctes("incoming", extra=_STARTS)
    + """SELECT path, etag AS "eTag", event_id FROM (SELECT *, lag(kind) OVER (PARTITION BY path, etag ORDER BY ts, event_id) AS before FROM starts)
      WHERE kind = 'start' AND coalesce(before, 'finish') = 'finish'""",
)
def stream_dedupe(spark, sf):
    """Every third event of a file says that its processing ended; the others ask for it to begin. A key is held
    while it is in flight, over several micro-batches, and a replay after the end passes again."""
    base = work_dir(spark, "dedupe")
    events = I.incoming_events(W.incoming(spark, sf)).select(
        "path", "eTag", F.when(F.col("event_id") % 3 == 0, "finish").otherwise("start").alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("seq"),
    )
    cuts = events.select(F.percentile_approx(F.unix_timestamp("ts"), [0.33, 0.66]).alias("q")).first().q or [0, 0]
    at = F.unix_timestamp("ts")
    for part in (at < cuts[0], (at >= cuts[0]) & (at < cuts[1]), at >= cuts[1]):
        # A key's events of one wave are in one file, and waves come in order, wherever a micro-batch ends.
        events.where(part).repartition(_WAVE_FILES, "path", "eTag").write.mode("append").parquet(f"{base}/in")
    I.use_rocksdb(spark)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", _WAVE_FILES).parquet(f"{base}/in")
    I.append_once(I.dedupe_in_flight(stream), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("path", "eTag", F.col("seq").alias("event_id"))


_CALLS = "SELECT date_trunc('minute', ts) AS window_start, count(*) AS calls, count(*) >= 60 AS quota_exceeded FROM events GROUP BY 1"


@query("agg_call_report", f"SELECT CAST(window_start AS VARCHAR) AS window_start, calls, quota_exceeded FROM ({_CALLS})")
def agg_call_report(spark, sf):
    e = W.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    r = I.call_report(e)
    return r.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "stream_call_report",
    f"SELECT CAST(window_start AS VARCHAR) AS window_start, calls, quota_exceeded FROM ({_CALLS})",
)
def stream_call_report(spark, sf):
    """All minutes, also those still open when the input ends."""
    base, calls = _event_stream(spark, sf, lambda s, d: W.table(s, d, "events").select("ts"), "calls")
    out = I.updates_once(I.call_report(calls), f"{base}/out", f"{base}/state", ["window_start"])
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "stream_status_counts",
    V.ctes("messages")
    + f"""SELECT * FROM (SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, {Q.rules('lower(message)', E.K.ERROR_RULES)} AS code, count(*) AS files FROM messages GROUP BY 1, 2)""",
)
def stream_status_counts(spark, sf):
    base, msgs = _event_stream(spark, sf, W.messages, "status")
    coded = msgs.select("ts", error_code_from_message("message").alias("code"))
    out = I.updates_once(I.status_counts(coded), f"{base}/out", f"{base}/state", ["window_start", "code"])
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
