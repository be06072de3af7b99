"""Statement text: transactions, accounts, bank names, dates, line windows, reconciliation."""

from pyspark.sql import functions as F

from tallymark.functions import fixed as K
from tallymark.operators import accounts as A
from tallymark.operators import banks as B
from tallymark.operators import lines as L
from tallymark.operators import reconcile as R
from tallymark.operators import transactions as T
from tallymark.plans import oracle_views as V
from tallymark.plans import sqltext as Q
from tallymark.plans import workload as W
from tallymark.plans.catalogue import query

# --- transactions ------------------------------------------------------------------------

_TXNS = f"""txns AS (
  SELECT doc_id, CASE WHEN is_debit THEN 'debits' ELSE 'credits' END AS section,
    CASE WHEN is_debit THEN 1 ELSE 2 END AS section_no,
    CAST(row_number() OVER (PARTITION BY doc_id, is_debit ORDER BY txn_date, txn_id) AS INTEGER) AS entry_no,
    strftime(txn_date, '%m-%d') AS txn_date,
    CASE WHEN is_fee THEN 'fee' WHEN is_debit THEN 'debit' ELSE 'credit' END AS txn_type,
    {V.MONEY.format('cents')} AS amount, cents AS amount_cents, description FROM ledger)"""
_DAILY = f"""daily AS (
  SELECT doc_id, 'credits' AS section, 2 AS section_no,
    CAST(1 + row_number() OVER (PARTITION BY doc_id ORDER BY txn_date, txn_id)
      + count(*) FILTER (WHERE NOT is_debit) OVER (PARTITION BY doc_id) AS INTEGER) AS entry_no,
    strftime(txn_date, '%m-%d') AS txn_date, 'credit' AS txn_type,
    {V.MONEY.format('cents')} AS amount, cents AS amount_cents, '' AS description FROM ledger)"""


@query("ext_transactions", V.ctes("ledger", extra=_TXNS) + "SELECT * FROM txns")
def ext_transactions(spark, sf):
    return T.extract_transactions(W.statements(spark, sf))


@query(
    "ext_transactions_legacy",
    V.ctes("ledger", extra=_TXNS + ",\n" + _DAILY) + "SELECT * FROM txns UNION ALL SELECT * FROM daily",
)
def ext_transactions_legacy(spark, sf):
    return T.extract_transactions(W.statements(spark, sf), reset_sections=False)


_TOTALS = """SELECT doc_id, CAST(sum(CASE WHEN is_debit THEN cents ELSE 0 END) AS BIGINT) AS total_debits_cents,
  CAST(sum(CASE WHEN is_debit THEN 0 ELSE cents END) AS BIGINT) AS total_credits_cents,
  count(*) FILTER (WHERE is_debit) AS count_debits, count(*) FILTER (WHERE NOT is_debit) AS count_credits
  FROM ledger GROUP BY doc_id"""


@query("agg_section_totals", V.ctes("ledger") + _TOTALS)
def agg_section_totals(spark, sf):
    return T.section_totals(T.extract_transactions(W.statements(spark, sf)))


_RECON = """SELECT account, opening_balance, opening_balance_known, closing_balance, closing_balance_known,
  total_deposits, total_withdrawals, CASE WHEN ok AND ck THEN e END AS expected_closing,
  CASE WHEN ok AND ck THEN abs(closing - e) ELSE 0 END AS difference,
  ok AND ck AND coalesce(abs(closing - e) <= 1, false) AS balanced, transaction_count, deposit_count,
  CASE WHEN NOT (ok AND ck) THEN 'INCOMPLETE' WHEN abs(closing - e) <= 1 THEN 'COMPLETE' ELSE 'FAILED' END AS reconciliation_status,
  concat_ws('; ', CASE WHEN susp THEN 'Opening balance likely confused with large deposit' END,
    CASE WHEN ok AND ck AND abs(closing - e) > 1 THEN 'Balance reconciliation failed: difference of $' || format('{:,.2f}', CAST(abs(closing - e) / 100.0 AS DOUBLE)) END) AS warnings
FROM joined"""
_JOINED = """totals AS (SELECT account AS a, CAST(sum(greatest(amount_cents, 0)) AS BIGINT) AS dep2, CAST(sum(greatest(-amount_cents, 0)) AS BIGINT) AS wd,
    count(*) AS n, count(*) FILTER (WHERE amount_cents > 0) AS nd FROM ledger GROUP BY account),
 j0 AS (SELECT account, opening, closing, coalesce(dep2, 0) AS total_deposits, coalesce(wd, 0) AS total_withdrawals,
    coalesce(n, 0) AS transaction_count, coalesce(nd, 0) AS deposit_count FROM balances LEFT JOIN totals ON account = a),
 joined AS (SELECT *, coalesce(opening = total_deposits AND opening > 100000, false) AS susp,
    opening IS NOT NULL AND NOT coalesce(opening = total_deposits AND opening > 100000, false) AS ok, closing IS NOT NULL AS ck,
    opening + total_deposits - total_withdrawals AS e, coalesce(opening, 0) AS opening_balance, coalesce(closing, 0) AS closing_balance,
    opening IS NOT NULL AND NOT coalesce(opening = total_deposits AND opening > 100000, false) AS opening_balance_known,
    closing IS NOT NULL AS closing_balance_known FROM j0)"""


def _read_back(spark, sf):
    """Transactions read from the printed statements, signed, with their account."""
    t = T.extract_transactions(W.statements(spark, sf), key_cols=("doc_id", "account"))
    return t.select(
        "account",
        F.when(F.col("section") == "debits", -F.col("amount_cents")).otherwise(F.col("amount_cents")).alias("amount_cents"),
    )


def _flat(df):
    return df.withColumn("warnings", F.array_join("warnings", "; "))


@query("statement_round_trip", V.ctes("balances", extra=_JOINED) + _RECON)
def statement_round_trip(spark, sf):
    return _flat(R.reconcile(W.balances(spark, sf), _read_back(spark, sf), ["account"]))


@query("agg_reconcile", V.ctes("balances", extra=_JOINED) + _RECON)
def agg_reconcile(spark, sf):
    return _flat(R.reconcile(W.balances(spark, sf), W.ledger(spark, sf), ["account"]))


_INFER = """SELECT account, CASE WHEN ok AND ck THEN abs(closing - e) <= 1 ELSE false END AS balanced,
  CASE WHEN ok THEN e WHEN ck THEN closing END AS expected_closing,
  CASE WHEN ok THEN opening WHEN ck THEN closing - total_deposits + total_withdrawals END AS inferred_opening,
  CASE WHEN ok AND ck AND abs(closing - e) <= 1 THEN 'COMPLETE' WHEN ok AND ck THEN 'FAILED' WHEN ok OR ck THEN 'PARTIAL' ELSE 'FAILED' END AS reconciliation_status,
  concat_ws(',', CASE WHEN NOT ok THEN 'OB_UNKNOWN' END, CASE WHEN NOT ck THEN 'CB_UNKNOWN' END,
    CASE WHEN ok AND ck AND abs(closing - e) > 1 THEN 'BALANCE_MISMATCH' END,
    CASE WHEN (ok AND ck AND abs(closing - e) > 1) OR NOT (ok OR ck) THEN 'RECON_FAILED' END) AS error_codes FROM joined"""


@query("agg_reconcile_infer", V.ctes("balances", extra=_JOINED) + _INFER)
def agg_reconcile_infer(spark, sf):
    r = R.reconcile(W.balances(spark, sf), W.ledger(spark, sf), ["account"], infer_missing=True)
    return r.select(
        "account", "balanced", "expected_closing", "inferred_opening", "reconciliation_status",
        F.array_join("error_codes", ",").alias("error_codes"),
    )


_M = "'$' || format('{:,.2f}', CAST(%s / 100.0 AS DOUBLE))"
_COMMENTS = f"""SELECT account, concat_ws(chr(10),
  '#RECONCILIATION_STATUS: ' || st,
  CASE WHEN ok THEN '#OPENING_BALANCE: ' || {_M % 'opening'} || ' (from statement)' ELSE '#OPENING_BALANCE: NOT_FOUND - Missing from bank statement' END,
  CASE WHEN ck THEN '#CLOSING_BALANCE: ' || {_M % 'closing'} || ' (from statement)' ELSE '#CLOSING_BALANCE: NOT_FOUND - Missing from bank statement' END,
  '#TOTAL_DEPOSITS: ' || {_M % 'total_deposits'} || ' (' || CAST(deposit_count AS VARCHAR) || ' transactions)',
  '#TOTAL_WITHDRAWALS: ' || {_M % 'total_withdrawals'},
  CASE WHEN ok AND ck THEN '#EXPECTED_CLOSING: ' || {_M % 'e'} END,
  CASE WHEN st = 'FAILED' THEN '#BALANCE_DIFFERENCE: ' || {_M % '(closing - e)'} END,
  CASE WHEN st = 'FAILED' THEN '#RECONCILIATION_FAILED: Balance difference exceeds tolerance' END,
  CASE WHEN susp OR st = 'FAILED' THEN '#WARNINGS:' || chr(10) || concat_ws(chr(10),
     CASE WHEN susp THEN '#  - Opening balance likely confused with large deposit' END,
     CASE WHEN st = 'FAILED' THEN '#  - Balance reconciliation failed: difference of ' || {_M % 'abs(closing - e)'} END) END,
  CASE st WHEN 'COMPLETE' THEN '#RECOMMENDATION: Reconciliation successful - BAI2 data is accurate'
     WHEN 'FAILED' THEN '#RECOMMENDATION: Reconciliation failed - review statement and re-process' END) AS comments
FROM (SELECT *, CASE WHEN NOT (ok AND ck) THEN 'INCOMPLETE' WHEN abs(closing - e) <= 1 THEN 'COMPLETE' ELSE 'FAILED' END AS st FROM joined)"""


@query("bai2_comments", V.ctes("balances", extra=_JOINED) + _COMMENTS)
def bai2_comments(spark, sf):
    r = R.reconcile(W.balances(spark, sf), W.ledger(spark, sf), ["account"])
    return r.select("account", R.balance_comments().alias("comments"))


_PROFILE_DATE = "CASE txn_id % 10 WHEN 0 THEN NULL WHEN 1 THEN strftime(txn_date, '%m/%d/%Y') WHEN 2 THEN strftime(txn_date, '%m-%d') ELSE strftime(txn_date, '%Y-%m-%d') END"


def _printed_dates(spark, sf):
    k, d = F.col("txn_id") % 10, F.col("txn_date")
    printed = (
        F.when(k == 0, F.lit(None).cast("string"))
        .when(k == 1, F.date_format(d, "MM/dd/yyyy"))
        .when(k == 2, F.date_format(d, "MM-dd"))
        .otherwise(F.date_format(d, "yyyy-MM-dd"))
    )
    return W.ledger(spark, sf).withColumn("printed", printed)


@query(
    "agg_txn_profile",
    V.ctes("ledger")
    + f"""SELECT account, count(*) AS transaction_count, count(*) FILTER (WHERE amount_cents > 0) AS deposit_count,
       count(*) FILTER (WHERE amount_cents < 0) AS withdrawal_count, count(*) FILTER (WHERE p IS NULL) AS missing_dates,
       min(p) AS first_date, max(p) AS last_date,
       coalesce(string_agg(DISTINCT f, ',' ORDER BY f), '') AS date_formats,
       CASE WHEN count(*) >= 100 THEN 'high' WHEN count(*) >= 50 THEN 'good' WHEN count(*) >= 20 THEN 'moderate' ELSE 'low' END AS volume
       FROM (SELECT account, amount_cents, {_PROFILE_DATE} AS p, CASE txn_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'MM/DD/YYYY' WHEN 2 THEN 'OTHER' ELSE 'YYYY-MM-DD' END AS f FROM ledger)
       GROUP BY account""",
)
def agg_txn_profile(spark, sf):
    p = R.transaction_profile(_printed_dates(spark, sf), ["account"], "printed")
    return p.withColumn("date_formats", F.array_join("date_formats", ","))


@query(
    "agg_txn_dates",
    V.ctes("ledger")
    + f"SELECT account, p AS printed, count(*) AS n FROM (SELECT account, {_PROFILE_DATE} AS p FROM ledger) WHERE p IS NOT NULL GROUP BY account, p",
)
def agg_txn_dates(spark, sf):
    return R.count_by_date(_printed_dates(spark, sf), ["account"], "printed")


_DT = Q.any_contains("lower(l)", K.DENSE_TXN_WORDS)
_DB = Q.any_contains("lower(l)", K.DENSE_BALANCE_WORDS)


@query(
    "flt_dense_lines",
    V.ctes("noisy")
    + f""", s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM noisy),
      p AS (SELECT doc_id, text, list_filter(ls, lambda l: {_DT} OR (contains(l, '$') AND regexp_matches(l, '\\p{{Nd}}'))) AS tx,
        list_filter(ls, lambda l: NOT ({_DT} OR (contains(l, '$') AND regexp_matches(l, '\\p{{Nd}}'))) AND {_DB}) AS bl FROM s),
      f AS (SELECT doc_id, text, array_to_string(list_concat(list_concat(bl[:10], tx), bl[greatest(len(bl) - 9, 1):]), chr(10)) AS focused FROM p)
      SELECT doc_id, CASE WHEN length(text) > 12000 AND length(focused) < length(text) * 0.8 THEN focused ELSE text END AS dense FROM f""",
)
def flt_dense_lines(spark, sf):
    return T.dense_documents(W.noisy_docs(spark, sf)).select("doc_id", "dense")


# --- accounts -------------------------------------------------------------------------------


def _accounts(name, column, sql):
    @query(name, sql)
    def run(spark, sf):
        d = W.noisy_docs(spark, sf).withColumn("_low", F.lower("text"))
        return d.select("doc_id", column(F.col("text"), F.col("_low")).alias("account"))


_LOW = V.ctes("noisy") + ", d AS (SELECT doc_id, text, lower(text) AS low FROM noisy)"
_COMPACT = lambda m: f"replace(replace(upper({m}), '-', ''), ' ', '')"
_ND = lambda m: f"length({Q.digits(m)})"

_NEAR_REST = "trim(CASE " + " ".join(
    f"WHEN regexp_matches(lower(ls[i]), {Q.q(p)}) THEN regexp_replace(lower(ls[i]), {Q.q(p)}, '', 'g')"
    for p in K.ACCOUNT_LABEL_PATTERNS
) + " END)"


def _six(s, p):
    m = f"regexp_extract({s}, '{p}', 1)"
    return f"CASE WHEN {m} <> '' AND {Q.not_repeated(m)} THEN {m} END"


_NEAR = (
    "list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN "
    + f"({_NEAR_REST}) IS NOT NULL THEN coalesce({_six(_NEAR_REST, '([0-9]{6,})')}, "
    + ", ".join(_six(f"trim(coalesce(ls[i + {k}], ''))", "^([0-9]{6,})(?:\\s|$)") for k in (1, 2, 3))
    + ") END), lambda x: x IS NOT NULL)[1]"
)
_PARTIAL = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(low, {Q.q('(?i)' + p)}, 1), '')" for p in K.LABELED_PARTIAL_PATTERNS
) + ")"
_LABELED = (
    "coalesce("
    + Q.first_valid("low", K.LABELED_MASKED_PATTERNS,
                    lambda m: f"length({m}) >= 4 AND {_ND(m)} >= 3 AND regexp_matches({m}, '[*X]')", _COMPACT)
    + ", "
    + Q.first_valid("low", K.LABELED_NUMERIC_PATTERNS,
                    lambda m: f"CASE WHEN contains({m}, '-') THEN {_ND(m)} >= 4 ELSE length({m}) >= 6 AND {Q.not_repeated(m)} END")
    + f", {_NEAR}, 'XXXXXX' || {_PARTIAL})"
)
_DL = _LOW + ", dl AS (SELECT doc_id, text, low, string_split(text, chr(10)) AS ls FROM d)"

_accounts("ext_labeled_account", A.labeled_account, _DL + f" SELECT doc_id, {_LABELED} AS account FROM dl")

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_HY = "regexp_extract({0}, '^[^0-9]*([0-9]+-[0-9]+-[0-9]+|[0-9]+-[0-9]+)', 1)"
_B = "coalesce(ls[i + 1], '')"
_TAIL = r"regexp_extract(ls[i], '(?i)\baccount\s*[:\-\s#]*([0-9X*\-]+)', 1)"
_TD = Q.digits(_TAIL)


def _stars(m):
    return f"CASE WHEN {m} <> '' THEN '***' || {m} END"


_MASKED_BELOW = r"regexp_extract(coalesce(ls[i + 1], ''), '(?i)[X*]{3,}([0-9]{2,})', 1)"
_RUN_BELOW = f"regexp_extract({_B}, '^[^0-9]*([0-9]+)', 1)"
_ON_LINE = f"""coalesce(
  {_stars("regexp_extract(ls[i], '(?i)[X*]{3,}([0-9]{2,})', 1)")},
  {_stars("regexp_extract(ls[i], '(?i)(?:^|[^0-9A-Za-z_])ending[ ]+(?:with[ ]*:?[ ]*[*]+)?([0-9]{2,})', 1)")},
  CASE WHEN regexp_matches(ls[i], '(?i)\\baccount\\b') AND lower(ls[i]) <> 'account' THEN coalesce(
    CASE WHEN regexp_matches({_TAIL}, '[xX*]') THEN nullif(regexp_extract({_TAIL}, '(?i)[X*]+([0-9]+)', 1), '')
      WHEN regexp_matches({_TAIL}, '^[0-9]+-[0-9]+(?:-[0-9]+)?$') THEN {_TAIL}
      WHEN length({_TD}) >= 4 THEN {_TD} END,
    CASE WHEN {_B} <> '' THEN coalesce({_stars(_MASKED_BELOW)},
      CASE WHEN {_HY.format(_B)} <> '' THEN {_HY.format(_B)} WHEN length({_RUN_BELOW}) >= 4 THEN {_RUN_BELOW} END) END) END)"""
_LONE = f"""CASE WHEN i <= 30 AND lower(ls[i]) = 'account' AND i < least(len(ls), 30) AND {_B} <> '' THEN
  CASE WHEN {_HY.format(_B)} <> '' THEN {_HY.format(_B)}
    WHEN regexp_extract({_B}, '^[^0-9]*([0-9]{{4,}})', 1) <> '' THEN regexp_extract({_B}, '^[^0-9]*([0-9]{{4,}})', 1) END END"""
_OCR = (
    f"coalesce(list_filter(list_transform(range(1, len(ls) + 1), lambda i: {_LONE}), lambda x: x IS NOT NULL)[1], "
    f"list_filter(list_transform(range(1, len(ls) + 1), lambda i: {_ON_LINE}), lambda x: x IS NOT NULL)[1])"
)
_DT2 = _LOW + f", dl AS (SELECT doc_id, text, low, list_transform(string_split(text, chr(10)), lambda l: trim(l, {_WS})) AS ls FROM d)"

_accounts("ext_account_ocr", lambda t, low: A.account_from_lines(t), _DT2 + f" SELECT doc_id, {_OCR} AS account FROM dl")

_AFTER = r"regexp_extract(ls[i], '(?i)\baccount\b(.*)$', 1)"
_HERE = f"regexp_extract({_AFTER}, '^[^0-9]*([0-9]+)', 1)"
_NUM = f"CASE WHEN {_HERE} <> '' THEN {_HERE} ELSE regexp_extract({_B}, '^([0-9]+)', 1) END"
_accounts(
    "ext_account_after_label",
    lambda t, low: A.account_after_label(t),
    _DT2
    + f""" SELECT doc_id, list_filter(list_transform(range(1, len(ls) + 1), lambda i:
       CASE WHEN regexp_matches(ls[i], '(?i)\\baccount\\b') AND length({_NUM}) BETWEEN 4 AND 20 THEN {_NUM} END), lambda x: x IS NOT NULL)[1] AS account FROM dl""",
)

_MASKISH = lambda m: f"(regexp_matches({m}, '[*X#]') AND length({m}) >= 4)"
_NOW = "coalesce(" + ", ".join(
    f"list_filter(list_transform(list_transform(regexp_extract_all(low, {Q.q('(?i)' + p)}, 1), lambda m: {_COMPACT('m')}), "
    f"lambda m: CASE WHEN {_MASKISH('m')} THEN CASE WHEN {_ND('m')} >= 3 THEN m END WHEN {Q.valid_account('m')} THEN NULL "
    f"WHEN regexp_matches(m, '^[0-9]{{4}}$') THEN 'XXXXXX' || m END), lambda x: x IS NOT NULL)[1]"
    for p in K.REGEX_TEXT_PATTERNS
) + ")"
_REGEX = (
    "coalesce("
    + Q.first_valid("low", K.REGEX_MASKED_PATTERNS, lambda m: f"{_MASKISH(m)} AND {_ND(m)} >= 3", _COMPACT)
    + ", 'XXXXXX' || "
    + Q.first_valid("low", K.REGEX_LAST_DIGITS_PATTERNS, lambda m: f"NOT regexp_matches({m}, '^(?:800|888|877|866)')")
    + f", {_NOW}, "
    + Q.first_valid("low", K.REGEX_NUMERIC_PATTERNS, Q.valid_account)
    + ", "
    + Q.first_valid("low", K.REGEX_TEXT_PATTERNS, lambda m: f"NOT {_MASKISH(m)} AND {Q.valid_account(m)}", _COMPACT)
    + ")"
)
_accounts("ext_account_regex", A.regex_account, _LOW + f" SELECT doc_id, {_REGEX} AS account FROM d")

_V0 = "coalesce(" + Q.first_valid("low", K.REGEX_NUMERIC_PATTERNS, Q.valid_account_strict) + ", " + ", ".join(
    f"list_filter(list_transform(regexp_extract_all(low, {Q.q('(?i)' + p)}, 1), lambda m: "
    f"CASE WHEN {Q.valid_account_strict('m')} THEN m WHEN contains(m, '*') AND length(m) >= 4 THEN m "
    f"WHEN regexp_matches(m, '^[0-9]{{4}}$') THEN '*' || m END), lambda x: x IS NOT NULL)[1]"
    for p in K.REGEX_TEXT_PATTERNS_V0
) + ")"
_accounts("ext_account_regex_v0", A.regex_account_v0, _LOW + f" SELECT doc_id, {_V0} AS account FROM d")

_accounts(
    "ext_routing",
    A.routing_from_text,
    _LOW + " SELECT doc_id, " + Q.first_valid("low", K.ROUTING_PATTERNS, Q.valid_routing) + " AS account FROM d",
)


def _with_fields(docs):
    """Model fields beside the text: some statements have an account field, some a spelled-out one."""
    k = F.col("doc_id")
    model = F.when(k % 12 == 11, F.when(k % 24 == 11, F.concat(F.lit("77"), F.lpad(k.cast("string"), 6, "0"))).otherwise("12"))
    field = F.struct(
        F.concat(F.lit("55-"), F.lpad(k.cast("string"), 4, "0")).alias("content"), F.lit(0.9).alias("confidence")
    )
    other = F.struct(F.lit("Rivertown").alias("content"), F.lit(0.8).alias("confidence"))
    fields = F.map_from_arrays(F.array(F.lit("BankCity"), F.lit("Account")), F.array(other, field))
    return docs.withColumn("model_account", model).withColumn("raw_fields", fields)


@query(
    "ext_account",
    _DT2
    + f""", dl2 AS (SELECT doc_id, text, low, string_split(text, chr(10)) AS ls FROM d),
     a AS (SELECT doc_id, {_LABELED} AS a1 FROM dl2), b AS (SELECT doc_id, {_OCR} AS b1 FROM dl)
     SELECT doc_id, coalesce(a1, b1, CASE WHEN doc_id % 24 = 11 THEN '77' || lpad(CAST(doc_id AS VARCHAR), 6, '0') END,
       '55-' || lpad(CAST(doc_id AS VARCHAR), 4, '0')) AS account FROM a JOIN b USING (doc_id)""",
)
def ext_account(spark, sf):
    d = _with_fields(W.noisy_docs(spark, sf)).withColumn("_low", F.lower("text"))
    return d.select("doc_id", A.account_cascade("text", "model_account", "raw_fields", low="_low").alias("account"))


# Word boundaries are Unicode ones: every separator is doubled so that neighbours keep their own.
_SEP = "regexp_replace({0}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"


def _bounded(text, core):
    return f"regexp_extract_all({_SEP.format(text)}, '(?:^|[^\\p{{L}}\\p{{N}}_]){core}(?:$|[^\\p{{L}}\\p{{N}}_])', 1)"


_CAND = f"list_filter({_bounded('text', '([0-9]{4,})')}, lambda m: length(m) >= 6)"


@query(
    "ext_number_candidates",
    V.ctes("noisy") + f"SELECT doc_id, CAST(len({_CAND}) AS INTEGER) AS n, array_to_string({_CAND}, ',') AS shown FROM noisy",
)
def ext_number_candidates(spark, sf):
    d = W.noisy_docs(spark, sf).select("doc_id", A.number_candidates("text").alias("c"))
    return d.select("doc_id", F.size("c").alias("n"), F.array_join("c", ",").alias("shown"))


@query(
    "ext_account_frequency",
    V.ctes("noisy")
    + f""", u AS (SELECT doc_id, upper(text) AS t FROM noisy),
      x AS (SELECT doc_id, 'masked' AS class, unnest(list_filter(list_concat(list_concat(
              regexp_extract_all(t, '\\b([X*]+[0-9]{{4,}})\\b', 1), regexp_extract_all(t, '\\b([0-9]{{4,}}[X*]+)\\b', 1)),
              regexp_extract_all(t, '\\b([0-9]+[X*]+[0-9]+)\\b', 1)), lambda m: {_ND('m')} >= 3)) AS token FROM u
        UNION ALL SELECT doc_id, 'numeric', unnest(list_filter({_bounded('t', '([0-9]{6,12})')}, lambda m: {Q.valid_account('m')})) FROM u
        UNION ALL SELECT doc_id, 'reference', unnest(list_concat(list_filter({_bounded('t', '([A-Z]+#[0-9]{4,})')}, lambda m: {_ND('m')} >= 3),
              list_filter({_bounded('t', '([A-Z]{2,}[0-9]{4,})')}, lambda m: {_ND('m')} >= 3))) FROM u)
      SELECT doc_id, class, token, count(*) AS n FROM x GROUP BY ALL""",
)
def ext_account_frequency(spark, sf):
    return A.account_frequency(W.noisy_docs(spark, sf))


def _scan_sql():
    parts = []
    for kind, pats in (("labelled", K.SCAN_PATTERNS), ("partial", K.SCAN_PARTIAL_PATTERNS)):
        for i, p in enumerate(pats, 1):
            hits = f"regexp_extract_all(l, {Q.q(p)}, 1)"
            if kind == "labelled":
                hits = (
                    f"CASE WHEN regexp_matches(l, 'account|acct|ending') THEN list_filter({hits}, lambda m: length(m) >= 4) "
                    f"ELSE CAST([] AS VARCHAR[]) END"
                )
            parts.append(f"SELECT doc_id, line_no, '{kind}' AS kind, {i} AS pattern_no, unnest({hits}) AS number FROM n")
    return " UNION ALL ".join(parts)


@query(
    "ext_account_scan",
    V.ctes("noisy")
    + f""", s AS (SELECT doc_id, string_split(lower(text), chr(10)) AS ls FROM noisy),
      n AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, trim(ls[i], {_WS}) AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM s))
      {_scan_sql()}""",
)
def ext_account_scan(spark, sf):
    return A.account_scan(W.noisy_docs(spark, sf))


# --- bank names -------------------------------------------------------------------------------

_STRIP_CHARS = Q.q(K.BANK_TOKEN_STRIP)
_STRONG = Q.inlist(K.BANK_STRONG_ENDINGS)
_STOPS = Q.inlist(K.BANK_STOP_WORDS + K.BANK_LINE_STOP_WORDS)
_SPLIT = "list_filter(regexp_split_to_array({0}, '[\\s]+'), lambda w: w <> '')"
_BARE = f"list_filter(list_transform({_SPLIT}, lambda w: trim(w, {_STRIP_CHARS})), lambda w: w <> '')"


def _tok(k):
    return f"toks[n + {k}]"


def _is(x, names):
    return f"coalesce(lower({x}), '') IN {names}"


_EXT = f"""CASE WHEN NOT ({_is(_tok(1), _STRONG)}) OR (lower({_tok(1)}) IN ('national', 'federal') AND {_is(_tok(2), _STRONG)}) THEN 0
  WHEN {_tok(3)} IS NOT NULL AND {_is(_tok(2), Q.inlist(K.BANK_CONNECTORS))} AND regexp_matches({_tok(3)}, '^\\p{{Lu}}') AND length({_tok(3)}) >= 3
     AND NOT {_is(_tok(3), _STOPS)} THEN
     CASE WHEN lower({_tok(2)}) = 'of' AND lower({_tok(3)}) = 'the' AND regexp_matches(coalesce({_tok(4)}, ''), '^\\p{{Lu}}') AND NOT {_is(_tok(4), _STOPS)} THEN 3 ELSE 2 END
  WHEN {_is(_tok(2), _STRONG)} THEN CASE WHEN lower({_tok(1)}) IN ('credit', 'savings') THEN
     CASE WHEN lower({_tok(3)}) = 'and' AND {_is(_tok(4), _STRONG)} THEN 3 ELSE 1 END ELSE 0 END
  WHEN lower({_tok(2)}) = 'and' AND {_is(_tok(3), _STRONG)} THEN CASE WHEN {_is(_tok(4), _STRONG)} THEN 3 ELSE 2 END
  WHEN lower({_tok(1)}) IN {Q.inlist(K.BANK_FINAL_ENDINGS)} THEN -1 ELSE -2 END"""


def _walk(source):
    """Recursive walk over ``source`` (doc_id, ln, toks); gives names(doc_id, ln, name)."""
    return f"""walk AS (
      SELECT doc_id, ln, toks, 0 AS n, false AS done FROM {source}
      UNION ALL
      SELECT doc_id, ln, toks, n + 1 + greatest(ext, 0),
        ext = -1 OR (ext = -2 AND n + 1 >= 6) OR (ext > 0 AND lower(toks[n + 2]) = 'of')
      FROM (SELECT *, {_EXT} AS ext FROM walk WHERE NOT done AND n < 10 AND n < len(toks) AND NOT {_is(_tok(1), _STOPS)})),
    taken AS (SELECT doc_id, ln, any_value(toks) AS toks, max(n) AS n FROM walk GROUP BY doc_id, ln),
    names AS (SELECT doc_id, ln, CASE WHEN n BETWEEN 1 AND 10 AND length(array_to_string(toks[1:n], ' ')) BETWEEN 3 AND 100
        AND regexp_matches(array_to_string(toks[1:n], ' '), '\\p{{L}}') AND lower(array_to_string(toks[1:n], ' ')) NOT IN {_STOPS}
        THEN array_to_string(toks[1:n], ' ') END AS name FROM taken)"""


def _line_tokens(line):
    return (
        f"list_filter({_BARE.replace('{0}', line)}, lambda w: NOT regexp_matches(w, '^\\p{{Nd}}+$') AND w NOT IN "
        f"{Q.inlist(K.BANK_SYMBOL_TOKENS)})[1:16]"
    )


_ALL_LINES = f"""raw AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM noisy),
  each_line AS (SELECT doc_id, ln, trim(ls[ln], {_WS}) AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS ln FROM raw))"""


@query(
    "ext_bank_name_line",
    V.ctes("noisy", recursive=True)
    + f""", {_ALL_LINES}, src AS (SELECT doc_id, ln, {_line_tokens('line')} AS toks FROM each_line),
      {_walk('src')} SELECT doc_id, CAST(ln AS INTEGER) AS line_no, name AS bank_name FROM names WHERE name IS NOT NULL""",
)
def ext_bank_name_line(spark, sf):
    rows = L.lines_table(W.noisy_docs(spark, sf))
    name = F.array_compact(F.array(B.bank_name_from_line("line")))
    return rows.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.explode(name).alias("bank_name"))


_BS = Q.inlist(K.BANK_STOP_WORDS)


def _words_name(text):
    w10 = f"{_SPLIT.format(text)}[1:10]"
    bare = f"list_filter(list_transform({w10}, lambda w: trim(w, {_STRIP_CHARS})), lambda w: w <> '')"
    num = f"(regexp_matches(trim(coalesce({w10}[1], ''), {_STRIP_CHARS}), '^\\p{{Nd}}+$') AND len({w10}) > 1)"
    return w10, bare, num


_W10, _WB, _WN = _words_name("text")
_WORDS_CTES = f"""w0 AS (SELECT doc_id, {_WB} AS bare, {_WN} AS num FROM noisy),
  w1 AS (SELECT doc_id, bare, num, bare[(CASE WHEN num THEN 2 ELSE 1 END):(CASE WHEN num THEN 9 ELSE 8 END)] AS run FROM w0),
  w2 AS (SELECT *, list_position(list_transform(run, lambda w: lower(w) IN {_BS}), true) AS stop_at,
     list_position(list_transform(run, lambda w: lower(w) IN {_STRONG}), true) AS end_at FROM w1),
  w3 AS (SELECT *, least(CASE WHEN stop_at > 0 THEN stop_at - 1 END, CASE WHEN end_at > 0 THEN end_at END, len(run)) AS lim FROM w2),
  words_name AS (SELECT doc_id, CASE WHEN len(bare) > CASE WHEN num THEN 1 ELSE 0 END AND lim > 0
     AND length(array_to_string(run[1:lim], ' ')) BETWEEN 2 AND 80 AND regexp_matches(array_to_string(run[1:lim], ' '), '\\p{{L}}')
     AND lower(array_to_string(run[1:lim], ' ')) NOT IN {_BS} THEN array_to_string(run[1:lim], ' ') END AS name FROM w3)"""


@query("ext_bank_name_words", V.ctes("noisy", extra=_WORDS_CTES) + "SELECT doc_id, name AS bank_name FROM words_name")
def ext_bank_name_words(spark, sf):
    return W.noisy_docs(spark, sf).select("doc_id", B.bank_name_from_words("text").alias("bank_name"))


@query(
    "ext_bank_name",
    V.ctes("noisy", recursive=True, extra=_WORDS_CTES)
    + f""", {_ALL_LINES}, src AS (SELECT doc_id, ln, {_line_tokens('line')} AS toks FROM each_line
         WHERE ln <= 5 AND length(line) >= 3 AND NOT {Q.any_contains('lower(line)', K.BANK_HEADER_SKIP_WORDS)}),
      {_walk('src')}, firsts AS (SELECT doc_id, arg_min(name, ln) AS name FROM names WHERE name IS NOT NULL GROUP BY doc_id)
      SELECT w.doc_id, coalesce(f.name, w.name) AS bank_name FROM words_name w LEFT JOIN firsts f ON w.doc_id = f.doc_id""",
)
def ext_bank_name(spark, sf):
    return W.noisy_docs(spark, sf).select("doc_id", B.bank_name("text").alias("bank_name"))


def _pattern_list(text):
    parts = [f"regexp_extract_all({text}, {Q.q('(?i)' + p)}, 1)" for p in K.BANK_NAME_PATTERNS]
    return "flatten([" + ", ".join(parts) + "])"


_CLEAN = (
    "regexp_replace(array_to_string(" + _SPLIT.format("nm") + ", ' '), '[.,;:!?]+$', '')"
)
_TITLE = (
    f"array_to_string(list_transform(regexp_extract_all({_CLEAN}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), "
    "lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2))), '')"
)
_FIXED = (
    f"regexp_replace(regexp_replace(regexp_replace({_TITLE}, '\\bAnd\\b', '&', 'g'), '\\bFcu\\b', 'FCU', 'g'), '\\bUsa\\b', 'USA', 'g')"
)
_VALID_NAME = f"""CASE WHEN length(trim(name)) < 2 OR length(trim(name)) > 100 OR NOT regexp_matches(name, '\\p{{L}}') THEN false
  WHEN {Q.any_contains('lower(name)', K.BANK_NAME_KEYWORDS)} THEN NOT {Q.any_contains('lower(name)', K.BANK_NAME_BAD_WORDS)}
  WHEN len({_SPLIT.format('name')}) >= 2 AND len(list_filter({_SPLIT.format('name')}, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) >= len({_SPLIT.format('name')}) * 0.7 THEN true
  ELSE len({_SPLIT.format('name')}) = 1 AND length(trim(name)) >= 4 AND regexp_matches(trim(name), '^\\p{{Lu}}') END"""
_CANDS = f"""heads AS (SELECT doc_id, text, list_filter(string_split(text, chr(10))[1:10], lambda l: trim(l, {_WS}) <> '') AS hs FROM noisy),
  lists AS (SELECT doc_id, true AS is_header, flatten(list_transform(hs, lambda h: {_pattern_list('h')})) AS ns FROM heads
    UNION ALL SELECT doc_id, false, {_pattern_list('text')} FROM noisy),
  flat AS (SELECT doc_id, is_header, pos - 1 AS pos, ns[pos] AS nm FROM (SELECT doc_id, is_header, ns, unnest(range(1, len(ns) + 1)) AS pos FROM lists)),
  cleaned AS (SELECT doc_id, is_header, CAST(pos AS INTEGER) AS pos, {_FIXED} AS name FROM flat),
  cands AS (SELECT * FROM cleaned WHERE {_VALID_NAME})"""


@query("ext_bank_name_candidates", V.ctes("noisy", extra=_CANDS) + "SELECT doc_id, is_header, pos, name FROM cands")
def ext_bank_name_candidates(spark, sf):
    return B.bank_name_candidates(W.noisy_docs(spark, sf))


@query(
    "ext_bank_name_patterns",
    V.ctes("noisy", extra=_CANDS)
    + """SELECT doc_id, name AS bank_name, is_header AS from_header FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
       ORDER BY is_header DESC, length(name) DESC, pos) AS r FROM cands) WHERE r = 1""",
)
def ext_bank_name_patterns(spark, sf):
    return B.bank_name_by_patterns(W.noisy_docs(spark, sf))


# --- dates ----------------------------------------------------------------------------------------

_SD = "(DATE '2025-01-01' + CAST(doc_id % 365 AS INTEGER))"


def _date_inputs(spark, sf):
    k = F.col("doc_id")
    d = F.date_add(F.lit("2025-01-01").cast("date"), (k % 365).cast("int"))
    end = (
        F.when(k % 8 == 0, F.date_format(d, "MM/dd/yyyy"))
        .when(k % 8 == 1, F.date_format(d, "M/d/yy"))
        .when(k % 8 == 2, F.date_format(d, "yyyy-MM-dd"))
        .when(k % 8 == 3, F.date_format(d, "MM-dd-yyyy"))
        .when(k % 8 == 4, "31/31/2025")
    )
    period = F.when(k % 16 == 6, F.date_format(d, "yyyy-MM-dd"))
    closing = F.when(k % 16 == 7, F.date_format(d, "MM/dd/yyyy"))
    name = (
        F.when(k % 3 == 0, F.concat(F.lit("stmt_"), F.date_format(d, "yyyyMMdd"), F.lit(".pdf")))
        .when(k % 3 == 1, F.concat(F.lit("x-"), F.date_format(d, "MM-dd-yy"), F.lit(".pdf")))
        .otherwise("none.pdf")
    )
    return W.noisy_docs(spark, sf).select(
        "doc_id", "text", end.alias("end_field"), period.alias("period"), closing.alias("closing"), name.alias("filename")
    )


_PE = "coalesce(" + ", ".join(
    f"CASE WHEN regexp_matches(m{i}, '/[0-9]{{4}}$') THEN try_strptime(m{i}, '%m/%d/%Y') WHEN regexp_matches(m{i}, '/[0-9]{{2}}$') THEN try_strptime(m{i}, '%m/%d/%y') END"
    for i in range(len(K.PERIOD_PATTERNS))
) + ")"
_PM = ", ".join(f"regexp_extract(lower(text), {Q.q(p)}, 1) AS m{i}" for i, p in enumerate(K.PERIOD_PATTERNS))


@query(
    "ext_statement_date",
    V.ctes("noisy")
    + f""", m AS (SELECT doc_id, {_SD} AS d, {_PM} FROM noisy)
      SELECT doc_id, strftime(CASE WHEN doc_id % 8 < 4 THEN CAST(d AS TIMESTAMP) ELSE coalesce({_PE},
        CASE WHEN doc_id % 16 IN (6, 7) THEN CAST(d AS TIMESTAMP) END, CASE WHEN doc_id % 3 < 2 THEN CAST(d AS TIMESTAMP) END) END, '%y%m%d') AS statement_date FROM m""",
)
def ext_statement_date(spark, sf):
    d = _date_inputs(spark, sf)
    return d.select(
        "doc_id", B.statement_date("end_field", "text", "period", "closing", "filename").alias("statement_date")
    )


_TOK_SLASH = "([0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2})"
_TOK_NAME = "((?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4})"
_DTOK = f"""dl AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM noisy),
  dn AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM dl),
  dt AS (SELECT doc_id, ls, i, unnest(list_concat(
      regexp_extract_all(regexp_replace(ls[i], '([^0-9/])', '\\1\\1', 'g'), '(?:^|[^0-9/]){_TOK_SLASH}(?:$|[^0-9/])', 1),
      regexp_extract_all(ls[i], '{_TOK_NAME}', 1))) AS token FROM dn),
  toks AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, token, ls[i] AS line, CASE WHEN i > 1 THEN ls[i - 1] END AS prev_line, ls[i + 1] AS next_line,
      CAST(CASE WHEN regexp_matches(token, '^[0-9]+/[0-9]+/[0-9]{{4}}$') THEN try_strptime(token, '%m/%d/%Y')
        WHEN regexp_matches(token, '^[0-9]+/[0-9]+/[0-9]{{2}}$') THEN try_strptime(token, '%m/%d/%y')
        WHEN regexp_matches(token, '^[A-Z]') THEN try_strptime(token, '%B %d, %Y') END AS DATE) AS normalized FROM dt)"""


@query(
    "fn_date_tokens",
    V.ctes("noisy", extra=_DTOK)
    + "SELECT doc_id, line_no, token, line, prev_line, next_line, CAST(normalized AS VARCHAR) AS normalized FROM toks",
)
def fn_date_tokens(spark, sf):
    t = B.date_tokens(W.noisy_docs(spark, sf))
    return t.withColumn("normalized", F.col("normalized").cast("string"))


@query(
    "fn_date_summary",
    V.ctes("noisy", extra=_DTOK)
    + """SELECT doc_id, string_agg(DISTINCT token, '|' ORDER BY token) AS raw_date_tokens,
      coalesce(string_agg(DISTINCT CAST(normalized AS VARCHAR), '|' ORDER BY CAST(normalized AS VARCHAR)), '') AS normalized_dates,
      coalesce(string_agg(DISTINCT CAST(year(normalized) AS VARCHAR), '|' ORDER BY CAST(year(normalized) AS VARCHAR)), '') AS years_detected,
      CAST(min(normalized) AS VARCHAR) AS period_start, CAST(max(normalized) AS VARCHAR) AS period_end FROM toks GROUP BY doc_id""",
)
def fn_date_summary(spark, sf):
    s = B.date_summary(W.noisy_docs(spark, sf))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|").alias(c)
    return s.select(
        "doc_id", join("raw_date_tokens"), join("normalized_dates"), join("years_detected"),
        F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"),
    )


# --- line windows ------------------------------------------------------------------------------------

_SL = """sl0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM statements),
  sl AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM sl0))"""
_STMT_LINES = V.ctes("statements", extra=_SL)


def _statement_lines(spark, sf):
    return L.line_arrays(W.statements(spark, sf), clean=True)


@query(
    "win_section",
    _STMT_LINES
    + """SELECT doc_id, pos, line, last_value(CASE WHEN upper(line) IN ('DEBITS', 'CREDITS') THEN lower(line) END IGNORE NULLS)
       OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM sl""",
)
def win_section(spark, sf):
    return L.explode_lines(L.with_section(_statement_lines(spark, sf)))


@query(
    "win_segment",
    _STMT_LINES
    + f"""SELECT doc_id, pos, line, CAST(sum(CASE WHEN regexp_matches(line, '^{K.TXN_DATE_LINE}$') OR upper(line) IN {Q.inlist(K.SECTION_TERMINATORS)} THEN 1 ELSE 0 END)
       OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS segment FROM sl""",
)
def win_segment(spark, sf):
    return L.explode_lines(L.with_segment(_statement_lines(spark, sf)))


@query(
    "win_lookahead",
    _STMT_LINES
    + "SELECT doc_id, pos, line, lead(line, 1) OVER w AS next_1, lead(line, 2) OVER w AS next_2, lead(line, 3) OVER w AS next_3 FROM sl WINDOW w AS (PARTITION BY doc_id ORDER BY pos)",
)
def win_lookahead(spark, sf):
    return L.explode_lines(L.with_next_lines(_statement_lines(spark, sf)))


@query(
    "win_head_tail",
    V.ctes("noisy")
    + f""", {_ALL_LINES.replace('trim(ls[ln], ' + _WS + ')', 'ls[ln]')},
      b AS (SELECT doc_id, CAST(ln - 1 AS INTEGER) AS pos, line FROM each_line WHERE {Q.any_contains('lower(line)', K.DENSE_BALANCE_WORDS)}),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS from_top, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS INTEGER) AS from_end FROM b)
      SELECT * FROM r WHERE from_top <= 10 OR from_end <= 10""",
)
def win_head_tail(spark, sf):
    return L.edge_balance_lines(L.line_arrays(W.noisy_docs(spark, sf)))


@query(
    "win_first_by_priority",
    V.ctes("noisy")
    + f""", s AS (SELECT doc_id, string_split(lower(text), chr(10)) AS ls FROM noisy),
      n AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, trim(ls[i], {_WS}) AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)),
      hits AS ({_scan_sql()})
      SELECT doc_id, number FROM (SELECT doc_id, number, row_number() OVER (PARTITION BY doc_id ORDER BY kind, pattern_no, line_no, number) AS r FROM hits) WHERE r = 1""",
)
def win_first_by_priority(spark, sf):
    return A.first_scanned(W.noisy_docs(spark, sf))


@query(
    "win_refnum",
    V.ctes("ledger")
    + "SELECT doc_id, txn_id, lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY txn_date, txn_id) AS VARCHAR), 5, '0') AS ref_num FROM ledger",
)
def win_refnum(spark, sf):
    return L.numbered(W.ledger(spark, sf).select("doc_id", "txn_id", "txn_date"), ["doc_id"], ["txn_date", "txn_id"]).drop("txn_date")


@query(
    "topk_longest",
    "SELECT doc_id, line, CAST(pos AS INTEGER) AS pos FROM (SELECT doc_id, pos, ls[pos + 1] AS line, row_number() OVER (PARTITION BY doc_id ORDER BY length(ls[pos + 1]) DESC, pos) AS r "
    "FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE r = 1",
)
def topk_longest(spark, sf):
    lines = F.split("text", "\n")
    best = F.array_max(
        F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("back"), x.alias("line")))
    )
    d = W.table(spark, sf, "documents").select("doc_id", best.alias("b"))
    return d.select("doc_id", F.col("b.line").alias("line"), (-F.col("b.back")).alias("pos"))


@query(
    "set_dedupe_ci",
    "SELECT doc_id, CAST(pos AS INTEGER) AS pos, line FROM (SELECT doc_id, pos, ls[pos + 1] AS line, row_number() OVER (PARTITION BY doc_id, lower(ls[pos + 1]) ORDER BY pos) AS r "
    "FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE r = 1",
)
def set_dedupe_ci(spark, sf):
    kept = B.distinct_ignore_case(F.split("text", "\n"), "line")
    return W.table(spark, sf, "documents").select("doc_id", F.inline(kept))


@query(
    "limit_preview",
    "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:20], chr(10)) AS preview FROM documents",
)
def limit_preview(spark, sf):
    return W.table(spark, sf, "documents").select(
        "doc_id", F.substring_index("text", "\n", 20).alias("preview")
    )
