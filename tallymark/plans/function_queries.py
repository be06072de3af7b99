"""Predicates, classifiers and scalar functions over the given tables."""

from pyspark.sql import functions as F

from tallymark.functions import fixed as K
from tallymark.functions import predicates as P
from tallymark.functions import scalars as S
from tallymark.functions.similarity import ratio
from tallymark.plans import oracle_views as V
from tallymark.plans import sqltext as Q
from tallymark.plans import workload as W
from tallymark.plans.catalogue import query


def forms(spark, sf):
    """Account-like texts, one per order, in every shape the predicates tell apart."""
    o = W.table(spark, sf, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    s = k.cast("string")
    values = [
        F.lpad(s, 8, "0"), F.concat(F.lit("****"), (k % 100).cast("string")), F.lit("X12"),
        F.concat(F.lit("12-"), s), F.lit("Account"), F.concat(F.lit("ab_"), s),
        F.repeat(F.lit("7"), (k % 6).cast("int")), F.concat(F.lit(" "), s, F.lit(" ")),
        F.concat(F.lit("a.b"), s), (k % 1000).cast("string"), F.concat(F.lit("Nñ"), s),
        F.concat(F.lit("XXXX"), s, F.lit("#")), F.concat(F.lit("8"), F.lpad(s, 9, "0")),
    ]
    out = F
    for i, v in enumerate(values):
        out = out.when(k % 14 == i, v)
    return o.select("o_orderkey", out.alias("value"))


FORMS = """forms AS (SELECT o_orderkey, CASE o_orderkey % 14
  WHEN 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 8, '0') WHEN 1 THEN '****' || CAST(o_orderkey % 100 AS VARCHAR)
  WHEN 2 THEN 'X12' WHEN 3 THEN '12-' || CAST(o_orderkey AS VARCHAR) WHEN 4 THEN 'Account'
  WHEN 5 THEN 'ab_' || CAST(o_orderkey AS VARCHAR) WHEN 6 THEN repeat('7', CAST(o_orderkey % 6 AS INTEGER))
  WHEN 7 THEN ' ' || CAST(o_orderkey AS VARCHAR) || ' ' WHEN 8 THEN 'a.b' || CAST(o_orderkey AS VARCHAR)
  WHEN 9 THEN CAST(o_orderkey % 1000 AS VARCHAR) WHEN 10 THEN 'Nñ' || CAST(o_orderkey AS VARCHAR)
  WHEN 11 THEN 'XXXX' || CAST(o_orderkey AS VARCHAR) || '#'
  WHEN 12 THEN '8' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') END AS value FROM orders)"""


def _over_forms(name, column, sql, extra=""):
    @query(name, f"WITH {FORMS} SELECT o_orderkey, value, {sql} AS result FROM forms")
    def run(spark, sf):
        return forms(spark, sf).select("o_orderkey", "value", column(F.col("value")).alias("result"))


_over_forms("is_valid_account", P.is_valid_account, Q.valid_account("value"))
_over_forms("is_valid_account_strict", P.is_valid_account_strict, Q.valid_account_strict("value"))
_over_forms("fn_mask_digits", S.mask_digits,
            f"CASE WHEN regexp_matches(value, '[*xX#]') THEN {Q.digits('value')} ELSE value END")
_over_forms("fn_account_digits", S.account_digits, "regexp_replace(coalesce(value, ''), '[^0-9]', '', 'g')")
_D = "regexp_replace(coalesce(value, ''), '[^0-9]', '', 'g')"
_over_forms(
    "cls_number_candidate",
    lambda c: P.number_class(S.account_digits(c)),
    f"CASE WHEN length({_D}) = 10 AND starts_with({_D}, '8') THEN 'phone' WHEN length({_D}) < 6 THEN 'too_short' "
    f"WHEN length({_D}) > 15 THEN 'masked_or_long' WHEN length({_D}) <= 12 THEN 'possible_account' ELSE 'unknown' END",
)
_over_forms(
    "flt_phone_like",
    lambda c: P.is_phone_like(S.account_digits(c)),
    "regexp_matches(regexp_replace(coalesce(value, ''), '[^0-9]', '', 'g'), '^(?:800|888|877|866)')",
)

_NINE = "lpad(CAST(o_orderkey * 7 AS VARCHAR), CASE WHEN o_orderkey % 50 = 0 THEN 8 ELSE 9 END, '1')"


@query("is_valid_routing", f"SELECT o_orderkey, {Q.valid_routing(_NINE)} AS valid FROM orders")
def is_valid_routing(spark, sf):
    o = W.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    s = (k * 7).cast("string")
    nine = F.when(k % 50 == 0, F.lpad(s, 8, "1")).otherwise(F.lpad(s, 9, "1"))
    return o.select("o_orderkey", P.is_valid_routing(nine).alias("valid"))


_YMD = "CASE WHEN o_orderkey % 9 = 0 THEN strftime(o_orderdate, '%y%m%d') || '1' WHEN o_orderkey % 9 = 1 THEN strftime(o_orderdate, '%y%d%m') ELSE strftime(o_orderdate, '%y%m%d') END"


@query(
    "is_yymmdd",
    f"SELECT o_orderkey, regexp_matches({_YMD}, '^[0-9]{{6}}$') AND try_strptime({_YMD}, '%y%m%d') IS NOT NULL AS valid FROM orders",
)
def is_yymmdd(spark, sf):
    o = W.table(spark, sf, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    s = (
        F.when(k % 9 == 0, F.concat(F.date_format(d, "yyMMdd"), F.lit("1")))
        .when(k % 9 == 1, F.date_format(d, "yyddMM"))
        .otherwise(F.date_format(d, "yyMMdd"))
    )
    return o.select("o_orderkey", P.is_yymmdd(s).alias("valid"))


_NAME = "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN 'Bank of ' || p_brand WHEN 2 THEN p_type || ' Trust Statement' WHEN 3 THEN 'The ' || p_type || ' Group' WHEN 4 THEN 'x' ELSE p_type END"
_NS = f"trim({_NAME})"


@query(
    "is_valid_bank_name",
    f"""SELECT p_partkey, CASE WHEN length({_NS}) < 2 THEN false
      WHEN length({_NS}) > 100 OR NOT regexp_matches({_NS}, '\\p{{L}}') THEN false
      WHEN {Q.any_contains(f'lower({_NS})', K.BANK_NAME_KEYWORDS)} THEN NOT {Q.any_contains(f'lower({_NS})', K.BANK_NAME_BAD_WORDS)}
      WHEN len(string_split({_NS}, ' ')) >= 2 AND len(list_filter(string_split({_NS}, ' '), lambda w: regexp_matches(w, '^\\p{{Lu}}')))
        >= len(string_split({_NS}, ' ')) * 0.7 THEN true
      ELSE len(string_split({_NS}, ' ')) = 1 AND length({_NS}) >= 4 AND regexp_matches({_NS}, '^\\p{{Lu}}') END AS valid
    FROM part""",
)
def is_valid_bank_name(spark, sf):
    p = W.table(spark, sf, "part")
    k = F.col("p_partkey") % 6
    name = (
        F.when(k == 0, F.col("p_name"))
        .when(k == 1, F.concat(F.lit("Bank of "), "p_brand"))
        .when(k == 2, F.concat("p_type", F.lit(" Trust Statement")))
        .when(k == 3, F.concat(F.lit("The "), "p_type", F.lit(" Group")))
        .when(k == 4, "x")
        .otherwise(F.col("p_type"))
    )
    return p.select("p_partkey", P.is_valid_bank_name(name).alias("valid"))


@query(
    "flt_incoming_path",
    V.ctes("incoming")
    + """, paths AS (SELECT event_id, CASE WHEN subject <> '' THEN
        CASE WHEN len(string_split(subject, '/')) >= 7 AND contains(subject, 'incoming-bank-statements')
          THEN array_to_string(string_split(subject, '/')[7:], '/') END
        ELSE array_to_string(string_split(url, '/')[5:], '/') END AS path FROM incoming)
      SELECT event_id, path FROM paths WHERE starts_with(path, 'incoming-bank-statements/')""",
)
def flt_incoming_path(spark, sf):
    return (
        W.incoming(spark, sf)
        .select("event_id", P.incoming_path("subject", "url").alias("path"))
        .where(F.col("path").isNotNull())
    )


@query(
    "cls_error_msg",
    V.ctes("messages")
    + f"SELECT event_id, {Q.rules('lower(message)', K.ERROR_RULES)} AS code, {Q.rules('lower(message)', K.ERROR_RULES_V0)} AS code_previous FROM messages",
)
def cls_error_msg(spark, sf):
    return W.messages(spark, sf).select(
        "event_id",
        P.error_code_from_message("message").alias("code"),
        P.error_code_from_message_v0("message").alias("code_previous"),
    )


def _exc_sql():
    whens = []
    for code, words, types in K.EXCEPTION_RULES:
        conds = []
        if words:
            conds.append(Q.any_contains("lower(message)", words))
        if types:
            conds.append(f"exc_type IN {Q.inlist(types)}")
        whens.append(f"WHEN {' OR '.join(conds)} THEN '{code}'")
    return "CASE " + " ".join(whens) + f" ELSE '{K.ERROR_UNKNOWN}' END"


@query("cls_error_exc", V.ctes("messages") + f"SELECT event_id, {_exc_sql()} AS code FROM messages")
def cls_error_exc(spark, sf):
    return W.messages(spark, sf).select("event_id", P.error_code_from_exception("message", "exc_type").alias("code"))


@query(
    "cls_retryable",
    V.ctes("messages")
    + f"SELECT event_id, {Q.any_contains('lower(message)', K.RETRYABLE_WORDS)} AS retryable, {Q.any_contains('lower(message)', K.RETRYABLE_WORDS_FALLBACK)} AS retryable_fallback FROM messages",
)
def cls_retryable(spark, sf):
    return W.messages(spark, sf).select(
        "event_id",
        P.is_retryable("message").alias("retryable"),
        P.is_retryable("message", fallback=True).alias("retryable_fallback"),
    )


@query(
    "cls_volume",
    """SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= 100 THEN 'high' WHEN count(*) >= 50 THEN 'good'
       WHEN count(*) >= 20 THEN 'moderate' ELSE 'low' END AS volume FROM orders GROUP BY o_custkey""",
)
def cls_volume(spark, sf):
    n = W.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.withColumn("volume", P.volume_class("n"))


@query(
    "cls_content",
    """WITH c AS (SELECT page_id AS id, 'page' AS kind, html AS t FROM pages UNION ALL SELECT doc_id, 'doc', text FROM documents
         UNION ALL SELECT event_id, 'event', props FROM events
         UNION ALL SELECT o_orderkey, 'order', 'k;v;w' || chr(10) || CAST(o_orderkey AS VARCHAR) || ';a;b' || chr(10) FROM orders),
       h AS (SELECT id, kind, t, encode(t) AS b FROM c)
       SELECT id, kind, CASE WHEN starts_with(t, '<!DOCTYPE') OR starts_with(t, '<html') THEN 'html'
         WHEN (starts_with(trim(t), '{') AND right(trim(t), 1) = '}') THEN 'json'
         WHEN NOT regexp_matches(substr(t, 1, 1000), '[^\\x00-\\x7f]') AND contains(substr(t, 1, 2000), chr(10))
           AND length(substr(t, 1, 2000)) - length(replace(substr(t, 1, 2000), ',', '')) > length(substr(t, 1, 2000)) - length(replace(substr(t, 1, 2000), chr(10), '')) THEN 'csv_comma'
         WHEN NOT regexp_matches(substr(t, 1, 1000), '[^\\x00-\\x7f]') AND contains(substr(t, 1, 2000), chr(10))
           AND length(substr(t, 1, 2000)) - length(replace(substr(t, 1, 2000), ';', '')) > length(substr(t, 1, 2000)) - length(replace(substr(t, 1, 2000), chr(10), '')) THEN 'csv_semicolon'
         WHEN NOT regexp_matches(substr(t, 1, 1000), '[^\\x00-\\x7f]') THEN 'text' ELSE 'unknown' END AS content
       FROM h""",
)
def cls_content(spark, sf):
    page = W.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.col("html").alias("t"))
    doc = W.table(spark, sf, "documents").select("doc_id", F.lit("doc"), "text")
    event = W.table(spark, sf, "events").select("event_id", F.lit("event"), "props")
    order = W.table(spark, sf, "orders").select(
        "o_orderkey", F.lit("order"), F.concat(F.lit("k;v;w\n"), F.col("o_orderkey").cast("string"), F.lit(";a;b\n"))
    )
    both = page.union(doc).union(event).union(order)
    return both.select("id", "kind", P.content_class(F.encode("t", "UTF-8")).alias("content"))


@query(
    "prj_raw_field_accounts",
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'AccountNumber' ELSE 'account' END AS field, CAST(c_custkey AS VARCHAR) AS content FROM customer
       UNION ALL SELECT c_custkey, 'Accounts', c_name FROM customer""",
)
def prj_raw_field_accounts(spark, sf):
    c = W.table(spark, sf, "customer")
    fields = F.map_from_arrays(
        F.array(
            F.when(F.col("c_custkey") % 2 == 0, "AccountNumber").otherwise("account"),
            F.lit("Accounts"), F.lit("AccountHolder"), F.lit("BankName"),
        ),
        F.array(F.col("c_custkey").cast("string"), "c_name", "c_name", "c_mktsegment"),
    )
    return c.select("c_custkey", F.explode(P.account_fields(fields)).alias("field", "content"))


@query(
    "fn_norm_bank",
    V.ctes("registry", "detected")
    + f""", n AS (SELECT 'registry' AS side, ordinal AS id, bank_name FROM registry UNION ALL SELECT 'detected', doc_id, bank_name FROM detected
          UNION ALL SELECT 'part', p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' Trust Company' WHEN 1 THEN ', N.A.' WHEN 2 THEN ' and State Bank Corp.' WHEN 3 THEN ' StockYards & Company' ELSE ' Inc.' END FROM part)
      SELECT side, id, {Q.norm_bank('bank_name')} AS norm FROM n""",
)
def fn_norm_bank(spark, sf):
    r = W.registry(spark, sf).select(F.lit("registry").alias("side"), F.col("ordinal").alias("id"), "bank_name")
    d = W.detected(spark, sf).select(F.lit("detected"), "doc_id", "bank_name")
    k = F.col("p_partkey") % 5
    tail = (
        F.when(k == 0, " Trust Company").when(k == 1, ", N.A.").when(k == 2, " and State Bank Corp.")
        .when(k == 3, " StockYards & Company").otherwise(" Inc.")
    )
    p = W.table(spark, sf, "part").select(F.lit("part"), "p_partkey", F.concat("p_name", tail))
    return r.union(d).union(p).select("side", "id", S.norm_bank("bank_name").alias("norm"))


@query(
    "fn_similarity",
    V.ctes("registry", recursive=True)
    + f""", pairs AS (SELECT DISTINCT {Q.norm_bank('p_name')} AS a, {Q.norm_bank('bank_name')} AS b
           FROM part JOIN registry ON p_partkey // 20 = ordinal),
      {Q.SIMILARITY}
      SELECT a AS detected, b AS registered, round(sim, 6) AS similarity FROM sims""",
)
def fn_similarity(spark, sf):
    p = W.table(spark, sf, "part").select(F.expr("p_partkey div 20").alias("k"), "p_name")
    r = W.registry(spark, sf)
    pairs = p.join(r, p["k"] == r["ordinal"]).select(
        S.norm_bank("p_name").alias("detected"), S.norm_bank("bank_name").alias("registered")
    )
    return pairs.distinct().withColumn("similarity", F.round(ratio("detected", "registered"), 6))


_RAW = "CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), '/') WHEN 1 THEN text ELSE replace(text, ' ', chr(9)) END"
_CHANGED = f"{Q.sanitize(_RAW)} <> {_RAW}"


@query(
    "fn_sanitize",
    f"""SELECT doc_id, {Q.sanitize(_RAW)} AS clean, {_CHANGED} AS changed,
       concat_ws('; ', CASE WHEN contains({_RAW}, '/') THEN 'replace slash with dash' END,
         CASE WHEN regexp_matches({_RAW}, '[\\x00-\\x1F\\x7F]') THEN 'remove control chars' END,
         CASE WHEN regexp_matches({_RAW}, '[^\\x00-\\x7F]') THEN 'non-ascii -> space' END) AS reasons FROM documents""",
)
def fn_sanitize(spark, sf):
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.replace("text", F.lit("\n"), F.lit("/"))).when(k == 1, F.col("text")).otherwise(
        F.replace("text", F.lit(" "), F.lit("\t"))
    )
    d = W.table(spark, sf, "documents").select("doc_id", raw.alias("raw"))
    return d.select(
        "doc_id",
        S.sanitize("raw").alias("clean"),
        S.sanitize_changed("raw").alias("changed"),
        F.array_join(S.sanitize_reasons("raw"), "; ").alias("reasons"),
    )


_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_PRINTED = f"CASE o_orderkey % 6 WHEN 0 THEN CAST({_CENTS} AS VARCHAR) WHEN 1 THEN '-' || CAST({_CENTS} // 100 AS VARCHAR) || '.' || lpad(CAST({_CENTS} % 100 AS VARCHAR), 2, '0') WHEN 2 THEN format('{{:,.2f}}', CAST({_CENTS} / 100.0 AS DOUBLE)) WHEN 3 THEN '$' || CAST({_CENTS} // 100 AS VARCHAR) || '.5' WHEN 4 THEN 'n/a' END"


def _printed():
    k, c = F.col("o_orderkey") % 6, F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole = F.expr("cast(round(o_totalprice * 100) as bigint) div 100").cast("string")
    return (
        F.when(k == 0, c.cast("string"))
        .when(k == 1, F.concat(F.lit("-"), whole, F.lit("."), F.lpad((c % 100).cast("string"), 2, "0")))
        .when(k == 2, S.money_text(c))
        .when(k == 3, F.concat(F.lit("$"), whole, F.lit(".5")))
        .when(k == 4, "n/a")
    )


@query(
    "fn_int_cents",
    f"""SELECT o_orderkey, regexp_replace(coalesce({_PRINTED}, ''), '[^0-9]', '', 'g') AS legacy_cents,
      CASE o_orderkey % 6 WHEN 0 THEN CAST({_CENTS} AS VARCHAR) WHEN 1 THEN CAST(-{_CENTS} AS VARCHAR)
        WHEN 2 THEN CAST({_CENTS} AS VARCHAR) WHEN 3 THEN CAST({_CENTS} // 100 * 100 + 50 AS VARCHAR) ELSE '' END AS cents,
      o_orderkey % 6 NOT IN (0, 5) AS changed FROM orders""",
)
def fn_int_cents(spark, sf):
    o = W.table(spark, sf, "orders").select("o_orderkey", _printed().alias("s"))
    return o.select(
        "o_orderkey",
        S.int_cents("s", legacy=True).alias("legacy_cents"),
        S.int_cents("s").alias("cents"),
        S.int_cents_changed("s", legacy=True).alias("changed"),
    )


@query(
    "fn_amount",
    f"""SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN {_CENTS} * 100 WHEN 1 THEN -{_CENTS} WHEN 2 THEN {_CENTS}
        WHEN 3 THEN {_CENTS} // 100 * 100 + 50 ELSE 0 END AS BIGINT) AS amount_cents FROM orders""",
)
def fn_amount(spark, sf):
    o = W.table(spark, sf, "orders").select("o_orderkey", _printed().alias("s"))
    return o.select("o_orderkey", S.amount_cents("s").alias("amount_cents"))


@query(
    "fn_text_stats",
    """SELECT doc_id, CAST(length(text) AS INTEGER) AS chars,
      CAST(len(list_filter(regexp_split_to_array(text, '[\\s\\x{a0}]+'), lambda w: w <> '')) AS INTEGER) AS words,
      CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines FROM documents""",
)
def fn_text_stats(spark, sf):
    d = W.table(spark, sf, "documents")
    return d.select(
        "doc_id",
        F.length("text").alias("chars"),
        S.word_count("text").alias("words"),
        S.line_count("text").alias("lines"),
    )


@query(
    "ext_bank_from_filename",
    """WITH f AS (SELECT p_partkey, '/in/' || CASE p_partkey % 7 WHEN 0 THEN 'StockYard_' WHEN 1 THEN 'VERA-' WHEN 2 THEN 'my community '
         WHEN 3 THEN 'citizens_community_' WHEN 4 THEN 'Prosperity' ELSE '' END || replace(p_name, ' ', '_') || '.pdf' AS path FROM part)
       SELECT p_partkey, CASE WHEN contains(lower(path), 'stockyard') THEN 'Stock Yards Bank' WHEN contains(lower(path), 'vera') THEN 'VeraBank'
         WHEN contains(lower(path), 'community') THEN 'Community Bank' WHEN contains(lower(path), 'citizens') THEN 'Citizens Bank of Kentucky'
         WHEN contains(lower(path), 'prosperity') THEN 'Prosperity Bank' END AS bank_name FROM f""",
)
def ext_bank_from_filename(spark, sf):
    k = F.col("p_partkey") % 7
    start = (
        F.when(k == 0, "StockYard_").when(k == 1, "VERA-").when(k == 2, "my community ")
        .when(k == 3, "citizens_community_").when(k == 4, "Prosperity").otherwise("")
    )
    path = F.concat(F.lit("/in/"), start, F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".pdf"))
    return W.table(spark, sf, "part").select("p_partkey", S.bank_from_filename(path).alias("bank_name"))
