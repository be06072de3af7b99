"""BAI2 files: parse, repair, trailers, audit, validation, generation, error files."""

from pyspark.sql import functions as F

from tallymark.functions.scalars import line_count
from tallymark.operators import accounts as A
from tallymark.operators import bai2 as B
from tallymark.operators import banks as N
from tallymark.operators import error_files as E
from tallymark.operators import lines as L
from tallymark.plans import oracle_views as V
from tallymark.plans import sqltext as Q
from tallymark.plans import workload as W
from tallymark.plans.catalogue import query

# What the files should hold, from the ledger itself: e = entries of the files that have a header.
_DEC = "CAST({0} // 100 AS VARCHAR) || '.' || lpad(CAST({0} % 100 AS VARCHAR), 2, '0')"
_EXPECT = f"""ok AS (SELECT * FROM ledger WHERE account % 13 <> 12),
  e0 AS (SELECT doc_id AS file_id, account, CASE WHEN is_debit THEN 1 ELSE 2 END AS group_no, txn_id,
      row_number() OVER (PARTITION BY doc_id, is_debit ORDER BY txn_date, txn_id) AS entry_no,
      CASE WHEN is_debit THEN '451' ELSE '301' END AS type_code, cents,
      CASE txn_id % 3 WHEN 0 THEN CAST(cents AS VARCHAR) WHEN 1 THEN {_DEC.format('cents')} ELSE '-' || CAST(cents AS VARCHAR) END AS raw_amount,
      description FROM ok),
  f AS (SELECT doc_id AS file_id, account, CAST(coalesce(sum(cents) FILTER (WHERE is_debit), 0) AS BIGINT) AS out_cents,
      CAST(coalesce(sum(cents) FILTER (WHERE NOT is_debit), 0) AS BIGINT) AS in_cents, count(*) FILTER (WHERE is_debit) AS n1, count(*) FILTER (WHERE NOT is_debit) AS n2 FROM ok GROUP BY doc_id, account),
  late AS (SELECT file_id, account, 1 AS group_no, NULL AS txn_id, n1 + 1 AS entry_no, '301' AS type_code, 777 AS cents, '777' AS raw_amount, 'late entry' AS description FROM f WHERE account % 3 = 2),
  e AS (SELECT * FROM e0 UNION ALL SELECT * FROM late),
  g AS (SELECT file_id, account, 1 AS group_no, CASE WHEN account % 3 = 2 THEN n1 + 1 ELSE n1 END AS n,
      CASE account % 3 WHEN 0 THEN '-' || {_DEC.format('out_cents')} WHEN 1 THEN CAST(out_cents AS VARCHAR) END AS raw_balance,
      CASE account % 3 WHEN 0 THEN -out_cents WHEN 1 THEN out_cents ELSE 0 END AS balance,
      CASE WHEN account % 3 = 2 THEN 0 ELSE out_cents END AS legacy_balance, account % 4 = 1 AS bad_date FROM f
    UNION ALL SELECT file_id, account, 2, n2, CAST(in_cents AS VARCHAR), in_cents, in_cents, false FROM f)"""
_X = V.ctes("ledger", extra=_EXPECT)


def _parsed(spark, sf):
    return B.parse(W.bai2_files(spark, sf))


def _fixed(spark, sf, legacy=False):
    return B.fix(_parsed(spark, sf), W.DAY, legacy=legacy)


@query(
    "bai2_parse",
    _X + "SELECT file_id, CAST(group_no AS INTEGER) AS group_no, 1 AS account_no, CAST(entry_no AS INTEGER) AS entry_no, type_code, raw_amount AS amount, CASE WHEN txn_id IS NULL THEN '1' ELSE '999' END AS ref_num, "
    "description AS description_rest, split_part(description, ',', 1) AS description_field FROM e",
)
def bai2_parse(spark, sf):
    return B.entries_view(_parsed(spark, sf).where(F.col("bai2").isNotNull()))


@query(
    "bai2_parse_accounts",
    _X + f"SELECT file_id, CAST(group_no AS INTEGER) AS group_no, 1 AS account_no, {V.acct12('account')} AS account_number, CAST(n AS INTEGER) AS entries, raw_balance AS trailer_balance FROM g",
)
def bai2_parse_accounts(spark, sf):
    a = B.accounts_view(_parsed(spark, sf).where(F.col("bai2").isNotNull()))
    return a.select(
        "file_id", "group_no", "account_no", F.col("a.account_number").alias("account_number"),
        F.size("a.entries").alias("entries"), F.col("a.trailer_balance").alias("trailer_balance"),
    )


@query(
    "bai2_parse_groups",
    _X + "SELECT file_id, CAST(group_no AS INTEGER) AS group_no, 'ORIG' || CAST(account AS VARCHAR) AS originator_id, CASE WHEN bad_date THEN '250631' ELSE '250630' END AS group_date FROM g",
)
def bai2_parse_groups(spark, sf):
    g = B.groups_view(_parsed(spark, sf).where(F.col("bai2").isNotNull()))
    return g.select("file_id", "group_no", F.col("g.originator_id").alias("originator_id"), F.col("g.group_date").alias("group_date"))


@query(
    "bai2_rejects",
    V.ctes("ledger") + "SELECT DISTINCT doc_id AS file_id, 'Missing 01 header' AS reason FROM ledger WHERE account % 13 = 12",
)
def bai2_rejects(spark, sf):
    return B.rejects(_parsed(spark, sf)).select("file_id", "reason")


_AMT = "CASE WHEN txn_id IS NULL THEN '777' WHEN txn_id % 3 = 2 THEN '-' || CAST(cents AS VARCHAR) ELSE CAST(cents AS VARCHAR) END"


@query(
    "bai2_fix",
    _X + f"SELECT file_id, CAST(group_no AS INTEGER) AS group_no, CAST(entry_no AS INTEGER) AS entry_no, {_AMT} AS amount, lpad(CAST(entry_no AS VARCHAR), 5, '0') AS ref_num, {Q.sanitize('description')} AS description FROM e",
)
def bai2_fix(spark, sf):
    e = B.entries_view(_fixed(spark, sf))
    return e.select("file_id", "group_no", "entry_no", "amount", "ref_num", "description")


def _file_text(amount, description, balance, total, groups_extra="CAST(n + 2 AS VARCHAR)"):
    return f"""el AS (SELECT file_id, group_no, string_agg('16,' || type_code || ',' || {amount} || ',Z,' || lpad(CAST(entry_no AS VARCHAR), 5, '0') || ',,' || {description} || '/' || chr(10), '' ORDER BY entry_no) AS lines FROM e GROUP BY ALL),
      gl AS (SELECT g.file_id, g.group_no, g.account, n, {total} AS t, '02,WORKDAY,ORIG' || CAST(account AS VARCHAR) || ',1,' || CASE WHEN bad_date THEN '{W.DAY}' ELSE '250630' END || ',,USD,2/' || chr(10) ||
         '03,' || {V.acct12('account')} || ',USD,010,,,Z/' || chr(10) || coalesce(lines, '') || '49,' || {balance} || ',' || CAST(n + 2 AS VARCHAR) || '/' || chr(10) ||
         '98,' || CAST({total} AS VARCHAR) || ',1,' || CAST(n + 4 AS VARCHAR) || '/' || chr(10) AS block FROM g LEFT JOIN el ON g.file_id = el.file_id AND g.group_no = el.group_no),
      whole AS (SELECT file_id, '01,ORIG' || CAST(any_value(account) AS VARCHAR) || ',WORKDAY,' || CASE WHEN any_value(account) % 5 = 0 THEN '{W.DAY}' ELSE '250630' END || ',1200,1,,,2/' || chr(10) ||
         string_agg(block, '' ORDER BY group_no) || '99,' || CAST(sum(t) AS VARCHAR) || ',2,' || CAST(sum(n + 4) + 2 AS VARCHAR) || '/' || chr(10) AS fixed_text FROM gl GROUP BY file_id)"""


@query(
    "bai2_rebuild",
    _X.rstrip() + ", " + _file_text(_AMT, Q.sanitize("description"), "CAST(balance AS VARCHAR)", "balance") + " SELECT file_id, fixed_text FROM whole",
)
def bai2_rebuild(spark, sf):
    return B.rebuild(_fixed(spark, sf)).select("file_id", "fixed_text")


_LEGACY_BAL = "CASE WHEN raw_balance IS NULL THEN '0' ELSE regexp_replace(raw_balance, '[^0-9]', '', 'g') END"


@query(
    "bai2_rebuild_legacy",
    _X.rstrip() + ", " + _file_text("CAST(cents AS VARCHAR)", Q.sanitize("split_part(description, ',', 1)"), _LEGACY_BAL, "legacy_balance").replace(
        "CASE WHEN txn_id IS NULL", "CASE WHEN txn_id IS NULL") + " SELECT file_id, fixed_text FROM whole",
)
def bai2_rebuild_legacy(spark, sf):
    return B.rebuild(_fixed(spark, sf, legacy=True)).select("file_id", "fixed_text")


def _trailer_sql(r49, r98, r99):
    return _X + f"""SELECT file_id, '49' AS level, CAST(group_no AS INTEGER) AS group_no, 1 AS account_no, balance AS total, n AS items, {r49} AS records FROM g
      UNION ALL SELECT file_id, '98', CAST(group_no AS INTEGER), NULL, balance, 1, {r98} FROM g
      UNION ALL SELECT file_id, '99', NULL, NULL, CAST(sum(balance) AS BIGINT), 2, CAST({r99} AS BIGINT) FROM g GROUP BY file_id"""


for _name, _conv, _r in (
    ("agg_bai2_trailers", "inclusive", ("n + 2", "n + 4", "sum(n + 4) + 2")),
    ("agg_bai2_trailers_spec", "spec", ("n", "n + 3", "sum(n + 3)")),
    ("agg_bai2_trailers_previous", "previous", ("n", "n + 3", "sum(n + 4)")),
):

    def _run(spark, sf, conv=_conv):
        return B.trailers(_fixed(spark, sf), convention=conv)

    query(_name, _trailer_sql(*_r))(_run)


_AUDIT_E = f"""ex AS (SELECT file_id, count(*) FILTER (WHERE txn_id % 3 = 1) AS norm_default, count(*) FILTER (WHERE {Q.sanitize('description')} <> description) AS clean,
    count(*) FILTER (WHERE contains(description, '/')) AS slash, count(*) FILTER (WHERE contains(description, 'é')) AS ascii,
    min(CASE WHEN contains(description, '/') THEN group_no * 1000000 + entry_no END) AS fs, min(CASE WHEN contains(description, 'é') THEN group_no * 1000000 + entry_no END) AS fa FROM e GROUP BY file_id),
  au AS (SELECT f.file_id, f.account, f.account % 5 = 0 AS fd, CASE WHEN f.account % 4 = 1 THEN 1 ELSE 0 END AS gd, coalesce(norm_default, 0) AS am, coalesce(clean, 0) AS ds, coalesce(slash, 0) AS slash, coalesce(ascii, 0) AS ascii, fs, fa,
    CASE WHEN f.account % 3 = 0 THEN 1 ELSE 0 END AS eb FROM f LEFT JOIN ex ON f.file_id = ex.file_id)"""
_S = "'replace slash with dash=' || CAST(slash AS VARCHAR)"
_N = "'non-ascii -> space=' || CAST(ascii AS VARCHAR)"
_REASONS = f"CASE WHEN slash > 0 AND ascii > 0 THEN CASE WHEN fs < fa THEN {_S} || ', ' || {_N} ELSE {_N} || ', ' || {_S} END WHEN slash > 0 THEN {_S} WHEN ascii > 0 THEN {_N} ELSE 'sanitized descriptions' END"


@query(
    "agg_bai2_audit",
    _X.rstrip() + ", " + _AUDIT_E
    + f""" SELECT file_id, fd AS file_date_corrected, CAST(gd AS INTEGER) AS group_dates_corrected, 2 AS accounts_renumbered, CAST(am AS INTEGER) AS amounts_normalized,
      CAST(ds AS INTEGER) AS descriptions_sanitized, CAST(eb AS INTEGER) AS ending_balances_fixed, slash AS slash_fixes, ascii AS ascii_fixes,
      concat_ws(chr(10), CASE WHEN fd THEN '- corrected 01 file date -> {W.DAY}' END, CASE WHEN gd > 0 THEN '- corrected ' || CAST(gd AS VARCHAR) || ' group date(s) in 02' END,
        '- renumbered REF_NUMs for 2 account(s)', CASE WHEN am > 0 THEN '- normalized ' || CAST(am AS VARCHAR) || ' amount(s) to integer cents' END,
        CASE WHEN ds > 0 THEN '- sanitized ' || CAST(ds AS VARCHAR) || ' description(s) (' || {_REASONS} || ')' END,
        CASE WHEN eb > 0 THEN '- fixed non-integer ending balances in ' || CAST(eb AS VARCHAR) || ' account(s)' END, '- rebuilt trailers: 49=2, 98=2, 99=1') AS audit_text FROM au""",
)
def agg_bai2_audit(spark, sf):
    a = B.audit(_fixed(spark, sf))
    n = lambda r: F.coalesce(F.try_element_at("reasons", F.lit(r)), F.lit(0))
    return a.select(
        "file_id", "file_date_corrected", "group_dates_corrected", "accounts_renumbered", "amounts_normalized",
        "descriptions_sanitized", "ending_balances_fixed", n("replace slash with dash").alias("slash_fixes"),
        n("non-ascii -> space").alias("ascii_fixes"), "audit_text",
    )


_LINES = """bl0 AS (SELECT file_id, string_split(text, chr(10)) AS ls FROM bai2_files),
  bl AS (SELECT file_id, CAST(i - 1 AS INTEGER) AS pos, ls[i] AS line, split_part(ls[i], ',', 1) AS rec FROM (SELECT file_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM bl0) WHERE trim(ls[i]) <> '')"""


@query("agg_record_types", V.ctes("bai2", extra=_LINES) + "SELECT file_id, rec, count(*) AS n FROM bl GROUP BY file_id, rec")
def agg_record_types(spark, sf):
    return B.record_types(W.bai2_files(spark, sf))


@query(
    "win_hierarchy",
    V.ctes("bai2", extra=_LINES)
    + """, a AS (SELECT *, last_value(CASE WHEN rec = '02' THEN pos WHEN rec = '98' THEN -1 END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM bl),
      b AS (SELECT *, rec = '03' AND coalesce(g, -1) >= 0 AS opens FROM a),
      c AS (SELECT *, last_value(CASE WHEN opens THEN pos WHEN rec IN ('02', '49') THEN -1 END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS acc,
        CAST(sum(CASE WHEN rec = '02' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos) AS BIGINT) AS n02, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY pos) AS BIGINT) AS n03 FROM b)
      SELECT file_id, pos, rec, CASE WHEN rec = '02' OR coalesce(g, -1) >= 0 THEN n02 END AS group_no, CASE WHEN opens OR (coalesce(acc, -1) >= 0 AND rec IN ('16', '49')) THEN n03 END AS account_no FROM c""",
)
def win_hierarchy(spark, sf):
    return L.with_hierarchy(L.record_arrays(W.bai2_files(spark, sf)))


@query(
    "bai2_validate",
    _X.rstrip()
    + """, v AS (SELECT f.file_id, f.account, count(e.entry_no) FILTER (WHERE e.txn_id IS NOT NULL AND e.txn_id % 3 > 0) AS bad_amounts,
        count(e.entry_no) FILTER (WHERE contains(e.description, '/')) AS slashes, count(DISTINCT e.group_no) AS ref_bad FROM f LEFT JOIN e ON f.file_id = e.file_id GROUP BY ALL)
      SELECT file_id, 'integer_amount' AS rule, bad_amounts AS n FROM v WHERE bad_amounts > 0 UNION ALL SELECT file_id, 'slash_in_description', slashes FROM v WHERE slashes > 0
      UNION ALL SELECT file_id, 'reference_sequence', ref_bad FROM v WHERE ref_bad > 0 UNION ALL SELECT file_id, 'account_trailer', 2 FROM v
      UNION ALL SELECT file_id, 'group_trailer', 2 FROM v UNION ALL SELECT file_id, 'file_trailer', 1 FROM v""",
)
def bai2_validate(spark, sf):
    return B.violations(_parsed(spark, sf).where(F.col("bai2").isNotNull()))


@query(
    "bai2_validate_fixed",
    _X + "SELECT file_id, 'integer_amount' AS rule, count(*) AS n FROM e WHERE txn_id % 3 = 2 GROUP BY file_id",
)
def bai2_validate_fixed(spark, sf):
    """Rebuilt files read again: only amounts that kept their sign are left."""
    text = B.rebuild(_fixed(spark, sf)).select("file_id", F.col("fixed_text").alias("text"))
    return B.violations(B.parse(text))


@query(
    "bai2_code_check",
    _X + "SELECT file_id, group_no, count(*) AS flagged FROM e WHERE txn_id IS NOT NULL AND ((type_code = '301' AND regexp_matches(lower(description), 'withdrawal|debit|payment|purchase') "
    "AND NOT regexp_matches(lower(description), 'deposit|credit')) OR (type_code = '451' AND regexp_matches(lower(description), 'deposit|credit') "
    "AND NOT regexp_matches(lower(description), 'withdrawal|debit|payment|purchase'))) GROUP BY ALL",
)
def bai2_code_check(spark, sf):
    e = B.entries_view(_parsed(spark, sf).where(F.col("bai2").isNotNull()))
    flagged = e.where(B.code_mismatch("type_code", "description_rest"))
    return flagged.groupBy("file_id", F.col("group_no").cast("bigint").alias("group_no")).agg(F.count("*").alias("flagged"))


def _generated(spark, sf):
    led = W.ledger(spark, sf)
    txns = led.select(F.col("doc_id").alias("file_id"), "txn_date", "txn_id", "amount_cents", "is_fee", "description")
    files = led.groupBy(F.col("doc_id").alias("file_id"), "account").agg(F.sum("amount_cents").alias("ending_balance")).select(
        "file_id",
        W.account12(F.col("account")).alias("account_number"),
        F.concat(F.lit("ORIG"), F.col("account").cast("string")).alias("originator_id"),
        F.lit("250630").alias("file_date"),
        F.lit("1200").alias("file_time"),
        "ending_balance",
    )
    return B.from_transactions(txns, files)


@query(
    "bai2_from_transactions",
    V.ctes("ledger")
    + f""", t AS (SELECT doc_id AS file_id, account, string_agg('16,' || CASE WHEN is_fee THEN '475' WHEN amount_cents > 0 THEN '301' ELSE '451' END || ',' || CAST(cents AS VARCHAR) || ',Z,' || lpad(CAST(r AS VARCHAR), 5, '0') || ',,' || {Q.sanitize('description')} || '/' || chr(10), '' ORDER BY r) AS lines,
        count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS b FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY txn_date, txn_id) AS r FROM ledger) GROUP BY doc_id, account)
      SELECT file_id, '01,ORIG' || CAST(account AS VARCHAR) || ',WORKDAY,250630,1200,1,,,2/' || chr(10) || '02,WORKDAY,ORIG' || CAST(account AS VARCHAR) || ',1,250630,,USD,2/' || chr(10) || '03,' || {V.acct12('account')} || ',USD,010,,,Z/' || chr(10) || lines ||
        '49,' || CAST(b AS VARCHAR) || ',' || CAST(n + 2 AS VARCHAR) || '/' || chr(10) || '98,' || CAST(b AS VARCHAR) || ',1,' || CAST(n + 4 AS VARCHAR) || '/' || chr(10) || '99,' || CAST(b AS VARCHAR) || ',1,' || CAST(n + 6 AS VARCHAR) || '/' || chr(10) AS text FROM t""",
)
def bai2_from_transactions(spark, sf):
    return B.rebuild(_generated(spark, sf), out="text").select("file_id", "text")


@query(
    "bai2_round_trip",
    V.ctes("ledger")
    + f"SELECT doc_id AS file_id, lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY txn_date, txn_id) AS VARCHAR), 5, '0') AS ref_num, CAST(cents AS VARCHAR) AS amount, {Q.sanitize('description')} AS description FROM ledger",
)
def bai2_round_trip(spark, sf):
    """Ledger to files to text and back."""
    text = B.rebuild(_generated(spark, sf), out="text").select("file_id", "text")
    e = B.entries_view(B.parse(text))
    return e.select("file_id", "ref_num", "amount", F.col("description_rest").alias("description"))


# --- error files ----------------------------------------------------------------------------------


def _error_texts(spark, sf):
    m = W.messages(spark, sf)
    return m.select(
        "event_id",
        E.error_file_text(
            F.col("message"),
            F.concat(F.lit("file"), F.col("event_id").cast("string"), F.lit(".pdf")),
            F.lit("250630"),
            F.lit("1200"),
            F.lit("2025-07-01 00:00:00"),
        ).alias("text"),
    )


_RULES = Q.rules("lower(message)", E.K.ERROR_RULES)


def _guidance_sql() -> str:
    def block(what, checks):
        steps = [f"# {i}. {c}" for i, c in enumerate(checks, 1)]
        lines = [f"# PROBLEM: {what}", "#", "# WHAT TO CHECK:", *steps]
        return "concat_ws(chr(10), " + ", ".join(f"'{x}'" for x in lines) + ")"

    plain = [k for k in E.GUIDANCE if k not in ("ERROR_AI", "OTHER")]
    cases = " ".join(f"WHEN code = '{k}' THEN {block(*E.GUIDANCE[k])}" for k in plain)
    ai = f"WHEN regexp_matches(code, '^ERROR_(AI|OPENAI)') THEN {block(*E.GUIDANCE['ERROR_AI'])}"
    return f"CASE {cases} {ai} ELSE {block(*E.GUIDANCE['OTHER'])} END"


_GUIDANCE_SQL = _guidance_sql()


@query(
    "bai2_error_file",
    V.ctes("messages")
    + f""", m AS (SELECT event_id, message, {_RULES} AS code FROM messages)
      SELECT event_id, 'ERROR' AS status, concat_ws(chr(10), '{E.RULER}', '# ERROR BAI2 FILE - PROCESSING FAILED', '{E.RULER}', '# File: file' || event_id || '.pdf',
       '# Date: 2025-07-01 00:00:00', '# Error Code: ' || code, '#', '# WHAT HAPPENED:', '# ' || message, '#', {_GUIDANCE_SQL}, '#', '# TECHNICAL DETAILS:', '# No diagnostic data available',
       '#', '{E.RULER}', '', '01,ERROR,WORKDAY,250630,1200,1,,,2/', '02,ERROR,000000000,1,250630,,USD,2/', '03,ERROR,USD,010,,,Z/',
       '88,999,' || code || ',,Z/', '49,0,3/', '98,0,1,5/', '99,0,1,7/', '') AS text FROM m""",
)
def bai2_error_file(spark, sf):
    """Whole error files, every line of them."""
    return _error_texts(spark, sf).select("event_id", E.file_status("text").alias("status"), "text")


@query(
    "sink_error_route",
    V.ctes("bai2")
    + """, a AS (SELECT file_id || '.pdf' AS name, text FROM bai2_files UNION ALL SELECT 'e' || CAST(event_id AS VARCHAR) || '.pdf', '88,999,ERROR_NO_ACCOUNT,,Z/' || chr(10) || '03,ERROR,USD' FROM events)
      SELECT name, CASE WHEN contains(text, 'ERROR_NO_ACCOUNT') OR contains(text, '03,ERROR,') THEN 'ERROR' ELSE 'OK' END AS status,
        CASE WHEN contains(text, 'ERROR_NO_ACCOUNT') OR contains(text, '03,ERROR,') THEN 'ERROR_' ELSE '' END || regexp_replace(name, '\\.[^.]*$', '') || '.bai' AS output_name FROM a""",
)
def sink_error_route(spark, sf):
    good = W.bai2_files(spark, sf).select(F.concat("file_id", F.lit(".pdf")).alias("name"), "text")
    bad = W.table(spark, sf, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit(".pdf")).alias("name"),
        F.lit("88,999,ERROR_NO_ACCOUNT,,Z/\n03,ERROR,USD").alias("text"),
    )
    return E.route_errors(good.union(bad), name_col="name").drop("text")


@query(
    "fn_strip_fence",
    V.ctes("bai2")
    + "SELECT file_id, CASE WHEN starts_with(text, '01,') AND length(file_id) % 2 = 0 THEN regexp_extract(text, '(?s)(01,.*99,[^\\n]*)', 1) WHEN length(file_id) % 2 = 0 THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END AS bare FROM bai2_files",
)
def fn_strip_fence(spark, sf):
    f = W.bai2_files(spark, sf)
    fenced = F.when(F.length("file_id") % 2 == 0, F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return f.select("file_id", E.strip_fence(fenced).alias("bare"))


@query(
    "error_diagnostics",
    V.ctes("noisy")
    + """, c AS (SELECT doc_id, text, list_filter(regexp_extract_all(regexp_replace(text, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g'), '(?:^|[^\\p{L}\\p{N}_])([0-9]{4,})(?:$|[^\\p{L}\\p{N}_])', 1), lambda m: length(m) >= 6) AS c FROM noisy)
      SELECT doc_id, 'Account Numbers Found: ' || CASE WHEN len(c) > 0 THEN array_to_string(c, ', ') ELSE 'None' END AS found,
        'OCR Text Lines: ' || CAST(len(string_split(text, chr(10))) AS VARCHAR) || ' lines extracted' AS lines FROM c""",
)
def error_diagnostics(spark, sf):
    d = W.noisy_docs(spark, sf)
    notes = E.diagnostics(A.number_candidates("text"), N.bank_name("text"), line_count("text"))
    return d.select("doc_id", notes.alias("n")).select(
        "doc_id", F.col("n")[1].alias("found"), F.col("n")[2].alias("lines")
    )
