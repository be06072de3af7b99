"""Sources and sinks: derived data is written to the work folder and read back by the readers."""

from pyspark.sql import functions as F

from tallymark import schemas as S
from tallymark.functions import fixed as K
from tallymark.operators import bai2 as B
from tallymark.operators import contract as C
from tallymark.operators import error_files as E
from tallymark.operators import transactions as T
from tallymark.plans import bai2_queries  # noqa: F401  (registers the audit's check)
from tallymark.plans import oracle_views as V
from tallymark.plans import workload as W
from tallymark.plans.catalogue import CHECKS, query
from tallymark.session import work_dir
from tallymark.sources import readers as R
from tallymark.sources import sinks as Z
from tallymark.streaming import ingest as I


@query(
    "src_analysis_json",
    """SELECT 'c' || CAST(c_custkey AS VARCHAR) AS source, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS account_number, c_mktsegment AS bank_name,
      NULL AS statement_start_date, '06/30/2025' AS statement_end_date, CAST(CASE WHEN c_custkey % 3 <> 0 THEN 3 ELSE 2 END AS INTEGER) AS fields,
      CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 2 END AS lines, 'bankStatement.us_sdk' AS extraction_method FROM customer""",
)
def src_analysis_json(spark, sf):
    c = W.table(spark, sf, "customer")
    k = F.col("c_custkey")

    def field(value, conf):
        return F.struct(value.alias("content"), F.lit(conf).alias("confidence"))

    fields = F.map_from_arrays(
        F.array(F.lit("AccountNumber"), F.lit("BankName"), F.lit("StatementEndDate"), F.lit("Memo")),
        F.array(
            field(F.when(k % 3 == 0, "").otherwise(k.cast("string")), 0.9),
            field(F.col("c_mktsegment"), 0.8),
            field(F.lit("06/30/2025"), 0.7),
            field(F.lit(""), 0.1),
        ),
    )
    path = work_dir(spark, "analysis")
    c.select(
        F.concat(F.lit("c"), k.cast("string")).alias("source"),
        F.array(F.struct(fields.alias("fields"))).alias("documents"),
        F.when(k % 5 == 0, "").otherwise(F.concat("c_name", F.lit("\n"), "c_mktsegment")).alias("content"),
    ).write.json(path)
    s = R.analysis_to_statement(R.read_analysis(spark, path, multi_line=False))
    return s.select(
        "source", "account_number", "bank_name", "statement_start_date", "statement_end_date",
        F.size("raw_fields").alias("fields"), F.size("ocr_text_lines").alias("lines"), "extraction_method",
    )


@query(
    "src_layout_tables",
    """SELECT 'p' || CAST(p_partkey AS VARCHAR) AS source, 0 AS table_no, 0 AS row_index, p_name || '|' || p_brand AS cells FROM part
       UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), 0, 1, p_type || '|' || CAST(p_size AS VARCHAR) FROM part""",
)
def src_layout_tables(spark, sf):
    p = W.table(spark, sf, "part")

    def cell(value, r, c):
        return F.struct(value.alias("content"), F.lit(r).alias("row_index"), F.lit(c).alias("column_index"))

    cells = F.array(
        cell(F.col("p_size").cast("string"), 1, 1), cell(F.col("p_brand"), 0, 1),
        cell(F.col("p_type"), 1, 0), cell(F.col("p_name"), 0, 0),
    )
    table = F.struct(F.lit(2).alias("row_count"), F.lit(2).alias("column_count"), cells.alias("cells"))
    path = work_dir(spark, "layout")
    p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source"), F.array(table).alias("tables")).write.json(path)
    rows = R.layout_rows(R.read_analysis(spark, path, multi_line=False))
    return rows.withColumn("cells", F.array_join("cells", "|"))


def _registry_csv(spark, sf):
    """Registry as a spreadsheet export leaves it: blanks around cells, `.0` behind some numbers."""
    path = work_dir(spark, "registry")
    r = W.registry(spark, sf)
    r.select(
        F.col("ordinal").alias("Ordinal"),
        F.concat(F.lit(" "), "bank_name", F.lit(" ")).alias("Bank Name"),
        F.col("address").alias("Address"),
        F.concat("account_number", F.when(F.col("ordinal") % 3 == 0, ".0").otherwise("")).alias("Account Number"),
        F.concat("routing_number", F.when(F.col("ordinal") % 4 == 0, ".0").otherwise("")).alias("Routing Number"),
    ).write.option("header", True).csv(path)
    return path


@query("src_registry", V.ctes("registry") + "SELECT ordinal, bank_name, address, account_number, routing_number FROM registry")
def src_registry(spark, sf):
    return R.read_registry(spark, _registry_csv(spark, sf), ordinal="Ordinal")


@query(
    "src_registry_order",
    V.ctes("registry") + "SELECT row_number() OVER (ORDER BY ordinal) AS ordinal, account_number FROM registry",
)
def src_registry_order(spark, sf):
    """A list without an order column: its rows' positions, from files that were written in order."""
    path = work_dir(spark, "registry-order")
    r = W.registry(spark, sf).orderBy("ordinal").select(
        F.col("bank_name").alias("Bank Name"), F.col("address").alias("Address"),
        F.col("account_number").alias("Account Number"), F.col("routing_number").alias("Routing Number"),
    )
    r.write.option("header", True).csv(path)
    return R.read_registry(spark, path).select("ordinal", "account_number")


@query(
    "src_registry_refresh",
    V.ctes("registry")
    + "SELECT ordinal, bank_name, CASE WHEN ordinal % 5 = 0 THEN NULL ELSE address END AS address, account_number, routing_number FROM registry",
)
def src_registry_refresh(spark, sf):
    path = work_dir(spark, "refresh")
    r = W.registry(spark, sf).withColumn("address", F.when(F.col("ordinal") % 5 == 0, "NaN").otherwise(F.col("address")))
    R.refresh_registry(r, path)
    return spark.read.schema(r.schema).json(path)


@query("src_bank_list", V.ctes("registry") + "SELECT bank_name AS \"Bank Name\", count(*) AS n FROM registry GROUP BY 1")
def src_bank_list(spark, sf):
    path = work_dir(spark, "banks")
    Z.write_csv(W.registry(spark, sf).select(F.col("bank_name").alias("Bank Name")), path)
    names = R.read_bank_list(spark, path)
    out = work_dir(spark, "banks-json")
    Z.write_json(names, out)
    return spark.read.schema(S.BANK_LIST).json(out).groupBy("Bank Name").agg(F.count("*").alias("n"))


_SEPS = {"comma": ",", "semicolon": ";", "tab": "\t"}


def _delimited(spark, sf):
    base = work_dir(spark, "sniff")
    o = W.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    k = F.col("o_orderkey") % 3
    for i, (name, sep) in enumerate(_SEPS.items()):
        o.where(k == i).write.option("header", True).option("sep", sep).csv(f"{base}/{name}")
    return base


@query(
    "src_sniffed_text",
    "SELECT CASE o_orderkey % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS delimiter, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority FROM orders",
)
def src_sniffed_text(spark, sf):
    rows = R.read_sniffed(spark, _delimited(spark, sf), glob="*.csv")
    cell = lambda c: F.try_element_at("cells", F.lit(c)).alias(c)
    return rows.select("delimiter", cell("o_orderkey"), cell("o_custkey"), cell("o_orderpriority"))


@query(
    "src_delimited_union",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderpriority FROM orders",
)
def src_delimited_union(spark, sf):
    """Files of a known delimiter each, read by the splitting CSV reader and put together by name."""
    base = _delimited(spark, sf)
    parts = [R.read_delimited(spark, f"{base}/{name}", sep) for name, sep in _SEPS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


@query(
    "src_json_any",
    """SELECT c_custkey, 0 AS row_no, '{"k":' || CAST(c_custkey AS VARCHAR) || '}' AS record FROM customer WHERE c_custkey % 3 < 2
       UNION ALL SELECT c_custkey, 1, '{"k":"' || c_name || '"}' FROM customer WHERE c_custkey % 3 = 0
       UNION ALL SELECT c_custkey, 0, '{"data":' || CAST(c_custkey AS VARCHAR) || '}' FROM customer WHERE c_custkey % 3 = 2""",
)
def src_json_any(spark, sf):
    c = W.table(spark, sf, "customer")
    k = F.col("c_custkey").cast("string")
    obj = F.concat(F.lit('{"k":'), k, F.lit("}"))
    text = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" ["), obj, F.lit(', {"k":"'), "c_name", F.lit('"}]\n')))
        .when(F.col("c_custkey") % 3 == 1, obj)
        .otherwise(k)
    )
    return R.json_rows(c.select("c_custkey", text.alias("text")), keys=("c_custkey",))


FILE_ROWS = 5000


def _foldered(spark, sf):
    """A folder per nation with files of at most ``FILE_ROWS`` rows, so a whole text stays small."""
    path = work_dir(spark, "catalog")
    c = W.table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_name")
    c.repartition("c_nationkey").write.partitionBy("c_nationkey").option("header", True).option(
        "maxRecordsPerFile", FILE_ROWS
    ).csv(path)
    return path


@query(
    "src_catalog",
    f"SELECT 'c_nationkey=' || CAST(c_nationkey AS VARCHAR) AS folder, CAST(ceil(count(*) / {FILE_ROWS}.0) AS BIGINT) AS files, true AS has_bytes FROM customer GROUP BY c_nationkey",
)
def src_catalog(spark, sf):
    files = R.catalog(spark, _foldered(spark, sf), glob="*.csv")
    return files.groupBy("folder").agg(F.count("*").alias("files"), F.bool_and(F.col("size") > 0).alias("has_bytes"))


@query(
    "src_incoming",
    "SELECT c_nationkey, count(*) AS rows FROM customer GROUP BY c_nationkey",
)
def src_incoming(spark, sf):
    """Whole texts of a folder as a stream of several micro-batches, with their path; the lines of each
    text are its table's rows."""
    base = work_dir(spark, "incoming")
    stream = I.read_incoming(spark, _foldered(spark, sf), glob="*.csv", max_files=10)
    rows = F.size(F.filter(F.split("text", "\n"), lambda x: x != "")) - 1
    key = F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int").alias("c_nationkey")
    I.run_once(stream, lambda b: b.select(key, rows.alias("r")), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").groupBy("c_nationkey").agg(F.sum("r").alias("rows"))


@query(
    "src_dispatch",
    "SELECT 'csv' AS source_kind, CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, NULL AS extra FROM supplier UNION ALL SELECT 'json', CAST(n_nationkey AS VARCHAR), n_name, 'x' FROM nation",
)
def src_dispatch(spark, sf):
    path = work_dir(spark, "dispatch")
    W.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).write.mode(
        "append"
    ).option("header", True).csv(path)
    W.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("x").alias("extra")
    ).write.mode("append").json(path)
    return R.dispatch(spark, path, {"id": "string", "name": "string", "extra": "string"})


@query(
    "src_reader_kind",
    """WITH f AS (SELECT event_id, 'f' || CAST(event_id AS VARCHAR) || CASE event_id % 7 WHEN 0 THEN '.CSV' WHEN 1 THEN '.json' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.bai' WHEN 4 THEN '' WHEN 5 THEN '.tar.gz' ELSE '.pdf' END AS name FROM events)
       SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'excel' WHEN 3 THEN 'bai2' WHEN 6 THEN 'document' ELSE 'unknown' END AS kind FROM f""",
)
def src_reader_kind(spark, sf):
    k = F.col("event_id") % 7
    ext = F.when(k == 0, ".CSV").when(k == 1, ".json").when(k == 2, ".xlsx").when(k == 3, ".bai").when(k == 4, "").when(
        k == 5, ".tar.gz"
    ).otherwise(".pdf")
    e = W.table(spark, sf, "events")
    return e.select("event_id", R.reader_kind(F.concat(F.lit("f"), F.col("event_id").cast("string"), ext)).alias("kind"))


@query("src_prompt_marker", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text ELSE ' ' || text END AS text FROM documents")
def src_prompt_marker(spark, sf):
    d = W.table(spark, sf, "documents")

    def message(role, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    asked = F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(
        F.concat(F.lit("Read this.\n" + K.PROMPT_MARKER + " "), "text")
    )
    path = work_dir(spark, "prompt")
    d.select(
        F.col("doc_id").cast("string").alias("source"),
        F.array(
            message("system", F.lit("s")), message("user", F.lit("old")), message("user", asked), message("assistant", F.lit("a"))
        ).alias("messages"),
    ).write.json(path)
    p = spark.read.schema(S.PROMPT).json(path)
    return p.select(F.col("source").cast("bigint").alias("doc_id"), T.text_after_marker("messages").alias("text"))


# --- sinks ------------------------------------------------------------------------------------------


@query(
    "sink_json_orient",
    """SELECT 'records' AS orient, '{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_name":"' || c_name || '"}' AS value FROM customer
       UNION ALL SELECT 'values', '[' || CAST(c_custkey AS VARCHAR) || ',"' || c_name || '"]' FROM customer
       UNION ALL SELECT 'split', '{"index":' || CAST(c_custkey AS VARCHAR) || ',"data":["' || c_name || '"]}' FROM customer
       UNION ALL SELECT 'split-header', '{"columns": ["c_name"]}'
       UNION ALL SELECT 'table-header', '{"schema": {"fields": [{"name": "c_custkey", "type": "bigint"}, {"name": "c_name", "type": "string"}]}}'
       UNION ALL SELECT 'table', '{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_name":"' || c_name || '"}' FROM customer
       UNION ALL SELECT 'index', '{"' || CAST(c_custkey AS VARCHAR) || '":{"c_name":"' || c_name || '"}}' FROM customer""",
)
def sink_json_orient(spark, sf):
    c = W.table(spark, sf, "customer").select("c_custkey", "c_name")
    out = None
    for orient in Z.ORIENTS:
        path = work_dir(spark, f"orient-{orient}")
        Z.write_json(c, path, orient, ordinal="c_custkey" if orient in ("index", "split") else None)
        for kind in ("", "-header") if orient in ("split", "table") else ("",):
            part = spark.read.text(path + kind).select(F.lit(orient + kind).alias("orient"), "value")
            out = part if out is None else out.union(part)
    return out


@query("sink_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def sink_csv(spark, sf):
    path = work_dir(spark, "csv")
    Z.write_csv(W.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return spark.read.option("header", True).csv(path)


def _bai2_output(spark, sf):
    path = work_dir(spark, "bai2")
    # Written once: routing and audits both need the texts.
    stored = work_dir(spark, "bai2-texts")
    W.bai2_files(spark, sf).select("file_id", "text").write.parquet(stored)
    files = spark.read.schema("file_id string, text string").parquet(stored)
    routed = E.route_errors(files.withColumn("name", F.concat("file_id", F.lit(".pdf"))), name_col="name")
    audits = B.audit(B.fix(B.parse(files), W.DAY).where(F.col("bai2").isNotNull())).select("file_id", "audit_text")
    Z.write_bai2(routed, path, audits)
    return path


@query(
    "sink_bai2",
    V.ctes("bai2") + "SELECT 'OK' AS status, file_id || '.bai' AS output_name, text FROM bai2_files",
)
def sink_bai2(spark, sf):
    """A file per document, listed and read back."""
    return Z.read_bai2(spark, _bai2_output(spark, sf))


@query("sink_bai2_audit", f"SELECT file_id, audit_text FROM ({CHECKS['agg_bai2_audit']})")
def sink_bai2_audit(spark, sf):
    """The audits that stand beside the files."""
    return spark.read.schema("file_id string, audit_text string").json(f"{_bai2_output(spark, sf)}/_audit")


@query("sink_archive", V.ctes("statements") + "SELECT doc_id, text FROM statements")
def sink_archive(spark, sf):
    """Statements as a file stream of several micro-batches; what comes back is read from where the finished
    files were moved. An empty file at the end lets the last of them move."""
    base = work_dir(spark, "archive")
    rows = W.statements(spark, sf).select("doc_id", "text")
    rows.repartition(8, "doc_id").write.parquet(f"{base}/in")
    for turn in range(2):
        if turn:
            rows.where("false").coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = (
            spark.readStream.schema(rows.schema)
            .option("maxFilesPerTrigger", 4)
            .option("cleanSource", "archive")
            .option("sourceArchiveDir", f"{base}/done")
            .parquet(f"{base}/in")
        )
        Z.archive_once(stream, lambda b: b.select("doc_id", F.length("text").alias("n")), f"{base}/out", f"{base}/state")
    return spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{base}/done")


# --- listings -----------------------------------------------------------------------------------------


def _listing(spark, sf):
    """A file listing with one file per event."""
    e = W.table(spark, sf, "events")
    folder = F.when(F.col("event_id") % 3 == 0, "archive").when(F.col("event_id") % 3 == 1, "bai2-outputs").otherwise("inbox")
    name = F.when(F.col("event_id") % 50 == 0, K.RETENTION_KEEP).otherwise(
        F.concat(F.lit("f"), F.col("event_id").cast("string"), F.lit(".bai"))
    )
    return e.select(
        F.concat(folder, F.lit("/"), F.col("event_id").cast("string"), F.lit("/"), name).alias("path"),
        name.alias("file_name"), folder.alias("folder"), F.col("ts").alias("modified"),
    )


_LIST = """files AS (SELECT CASE event_id % 3 WHEN 0 THEN 'archive' WHEN 1 THEN 'bai2-outputs' ELSE 'inbox' END AS folder,
  CASE WHEN event_id % 50 = 0 THEN '.placeholder' ELSE 'f' || CAST(event_id AS VARCHAR) || '.bai' END AS file_name, event_id, ts FROM events)"""
_RET = f"WITH {_LIST} SELECT folder, count(*) AS total_files, count(*) FILTER (WHERE file_name <> '.placeholder') AS files_to_delete, count(*) FILTER (WHERE file_name = '.placeholder') AS kept_files FROM files WHERE folder IN ('archive', 'bai2-outputs') GROUP BY folder"


@query("rpt_retention", _RET)
def rpt_retention(spark, sf):
    return R.retention(_listing(spark, sf), K.RETENTION_FOLDERS, K.RETENTION_KEEP)


@query(
    "agg_retention",
    f"WITH r AS ({_RET}) SELECT CAST(sum(total_files) AS BIGINT) AS total_files, CAST(sum(files_to_delete) AS BIGINT) AS files_to_delete FROM r",
)
def agg_retention(spark, sf):
    r = R.retention(_listing(spark, sf), K.RETENTION_FOLDERS, K.RETENTION_KEEP)
    return r.agg(F.sum("total_files").alias("total_files"), F.sum("files_to_delete").alias("files_to_delete"))


@query(
    "topk_recent_files",
    f"WITH {_LIST} SELECT folder || '/' || CAST(event_id AS VARCHAR) || '/' || file_name AS path FROM files ORDER BY ts DESC, path LIMIT 50",
)
def topk_recent_files(spark, sf):
    return R.recent_files(_listing(spark, sf), 50).select("path")


@query(
    "set_union_formats",
    "SELECT 'c' AS side, c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL AS brand FROM customer UNION ALL SELECT 'p', p_partkey, p_name, NULL, p_brand FROM part",
)
def set_union_formats(spark, sf):
    a = W.table(spark, sf, "customer").select(
        F.lit("c").alias("side"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    b = W.table(spark, sf, "part").select(
        F.lit("p").alias("side"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name")
    )
    return a.unionByName(b, allowMissingColumns=True)


# --- parsed-statement JSON ------------------------------------------------------------------------------


def _answers(spark, sf):
    """Contract answers per statement: fenced and whole, cut behind the transactions, cut inside."""
    item = F.to_json(
        F.struct(
            F.date_format("txn_date", "yyyy-MM-dd").alias("date"),
            (F.col("amount_cents") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)").alias("amount"),
            F.col("description"),
            F.when(F.col("is_debit"), "withdrawal").otherwise("deposit").alias("type"),
        )
    )
    g = W.ledger(spark, sf).groupBy("doc_id", "account").agg(
        F.array_sort(F.collect_list(F.struct("txn_date", "txn_id", item.alias("j")))).alias("r")
    )
    items = F.array_join(F.transform("r", lambda x: x["j"]), ", ")
    head = F.concat(F.lit('{"account_number": "'), F.col("account").cast("string"), F.lit('", "transactions": ['))
    whole = F.concat(F.lit("```json\n"), head, items, F.lit('], "summary": {"transaction_count": 1}}\n```'))
    text = (
        F.when(F.col("account") % 3 == 0, whole)
        .when(F.col("account") % 3 == 1, F.concat(head, items, F.lit('], "summary": {"total')))
        .otherwise(F.concat(head, items, F.lit(', {"date": "2')))
    )
    return g.select("doc_id", "account", text.alias("text"))


@query(
    "fn_llm_json",
    V.ctes("ledger") + "SELECT doc_id, CASE account % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'recovered' ELSE 'failed' END AS parse_status, CASE WHEN account % 3 = 0 THEN CAST(account AS VARCHAR) END AS account_number FROM ledger GROUP BY doc_id, account",
)
def fn_llm_json(spark, sf):
    p = C.parse_statement_json(_answers(spark, sf))
    return p.select("doc_id", "parse_status", F.col("statement.account_number").alias("account_number"))


@query(
    "fn_llm_json_transactions",
    V.ctes("ledger") + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY txn_date, txn_id) - 1 AS INTEGER) AS pos, strftime(txn_date, '%Y-%m-%d') AS txn_date, amount_cents, description, CASE WHEN is_debit THEN 'withdrawal' ELSE 'deposit' END AS txn_type FROM ledger WHERE account % 3 < 2",
)
def fn_llm_json_transactions(spark, sf):
    return C.statement_transactions(C.parse_statement_json(_answers(spark, sf)), ("doc_id",))
