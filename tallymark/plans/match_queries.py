"""Resolution of detected accounts, and set work on registries."""

from pyspark.sql import functions as F

from tallymark.functions.scalars import account_digits
from tallymark.operators import match as M
from tallymark.operators import registry as G
from tallymark.plans import oracle_views as V
from tallymark.plans import sqltext as Q
from tallymark.plans import workload as W
from tallymark.plans.catalogue import query

_RD = V.ctes("registry", "detected")
_DIG = "regexp_replace(coalesce(account, ''), '[^0-9]', '', 'g')"


def _hit(df, *extra):
    return df.select(
        "doc_id",
        *extra,
        F.col("hit.ordinal").alias("matched_ordinal"),
        F.col("hit.routing_number").alias("matched_routing"),
    )


@query(
    "join_exact",
    _RD
    + "SELECT doc_id, min(ordinal) AS matched_ordinal, arg_min(routing_number, ordinal) AS matched_routing FROM detected JOIN registry ON trim(account) = trim(account_number) GROUP BY doc_id",
)
def join_exact(spark, sf):
    return _hit(M.join_exact(W.detected(spark, sf), W.registry(spark, sf)))


@query(
    "join_zero_norm",
    _RD
    + "SELECT doc_id, min(ordinal) AS matched_ordinal, arg_min(routing_number, ordinal) AS matched_routing FROM detected JOIN registry ON ltrim(account, '0') = ltrim(account_number, '0') GROUP BY doc_id",
)
def join_zero_norm(spark, sf):
    return _hit(M.join_zero_norm(W.detected(spark, sf), W.registry(spark, sf)))


@query(
    "join_suffix",
    _RD
    + f"SELECT doc_id, count(*) AS candidate_count, min(ordinal) AS matched_ordinal, arg_min(routing_number, ordinal) AS matched_routing FROM detected JOIN registry ON ends_with(account_number, {_DIG}) AND length({_DIG}) >= 2 GROUP BY doc_id",
)
def join_suffix(spark, sf):
    out = M.join_suffix(W.detected(spark, sf), W.registry(spark, sf))
    return out.select(
        "doc_id", "candidate_count", F.col("first_hit.ordinal").alias("matched_ordinal"),
        F.col("first_hit.routing_number").alias("matched_routing"),
    )


_MATCH = (
    V.ctes("registry", "detected", recursive=True)
    + f""", d AS (SELECT doc_id, account, bank_name, {_DIG} AS dg,
    CASE WHEN starts_with(account, 'XXXXXX') AND length(account) = 10 THEN 'partial'
      WHEN starts_with(account, '***') AND length({_DIG}) >= 2 THEN 'masked' END AS kind FROM detected),
  k AS (SELECT *, CASE WHEN kind = 'partial' THEN right(account, 4) WHEN kind = 'masked' OR length(dg) >= 3 THEN dg END AS key FROM d),
  cand AS (SELECT k.*, r.ordinal, r.bank_name AS rb, r.account_number AS ra, r.routing_number AS rr,
      account = r.account_number AS ex, ltrim(account, '0') = ltrim(r.account_number, '0') AND ltrim(account, '0') <> '' AS ze,
      coalesce(ends_with(r.account_number, key), false) AS su
    FROM k JOIN registry r ON coalesce(ends_with(r.account_number, key), false)
      OR (kind IS NULL AND (account = r.account_number OR ltrim(account, '0') = ltrim(r.account_number, '0')))),
  cnt AS (SELECT doc_id, count(*) AS n FROM cand WHERE kind IS NOT NULL GROUP BY doc_id),
  pairs AS (SELECT DISTINCT {Q.norm_bank('c.bank_name')} AS a, {Q.norm_bank('rb')} AS b FROM cand c JOIN cnt ON c.doc_id = cnt.doc_id WHERE n > 1 AND c.bank_name IS NOT NULL),
  {Q.SIMILARITY},
  scored AS (SELECT c.*, n, coalesce(sim, 0) AS sim FROM cand c JOIN cnt ON c.doc_id = cnt.doc_id
     LEFT JOIN sims ON a = {Q.norm_bank('c.bank_name')} AND b = {Q.norm_bank('rb')} AND n > 1 AND c.bank_name IS NOT NULL),
  best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, ordinal) AS r FROM scored),
  plain AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS r,
     CASE WHEN ex THEN 'exact' WHEN ze THEN 'normalized' ELSE 'legacy_partial' END AS t FROM cand WHERE kind IS NULL),
  m AS (SELECT k.doc_id, k.account, k.bank_name, k.key, kind, coalesce(b.n, 0) AS n, b.sim, b.ordinal AS bo, p.t, p.ordinal AS po
     FROM k LEFT JOIN (SELECT doc_id AS bd, n, sim, ordinal FROM best WHERE r = 1) b ON k.doc_id = bd
     LEFT JOIN (SELECT doc_id AS pd, t, ordinal FROM plain WHERE r = 1) p ON k.doc_id = pd),
  res AS (SELECT doc_id, account, bank_name, key, n,
    CASE WHEN kind IS NOT NULL AND n = 1 THEN kind || '_single' WHEN kind IS NOT NULL AND n > 1 AND bank_name IS NOT NULL AND sim >= 0.5 THEN kind || '_disambiguated'
      WHEN kind IS NOT NULL AND n > 1 AND bank_name IS NOT NULL THEN 'multiple_accounts_low_similarity'
      WHEN kind IS NOT NULL AND n > 1 THEN 'multiple_accounts_no_bank_name'
      WHEN kind = 'masked' THEN 'no_account_match' WHEN kind = 'partial' THEN 'none' ELSE coalesce(t, 'none') END AS match_type,
    CASE WHEN kind IS NOT NULL AND n > 1 AND bank_name IS NOT NULL THEN sim WHEN (kind IS NOT NULL AND n = 1) OR (kind IS NULL AND t IS NOT NULL) THEN 1 ELSE 0 END AS similarity,
    CASE WHEN kind IS NOT NULL AND (n = 1 OR (n > 1 AND bank_name IS NOT NULL AND sim >= 0.5)) THEN bo WHEN kind IS NULL THEN po END AS matched_ordinal,
    CASE WHEN kind IS NOT NULL AND n > 1 THEN key END AS ending_digits, CASE WHEN kind IS NOT NULL AND n > 1 THEN n END AS candidate_count FROM m)"""
)


@query(
    "match_account",
    _MATCH
    + """ SELECT doc_id, match_type, matched_ordinal IS NOT NULL AS account_valid, round(CAST(similarity AS DOUBLE), 6) AS similarity, matched_ordinal,
       r.account_number AS matched_account, r.bank_name AS matched_bank, r.routing_number AS matched_routing, ending_digits, candidate_count
       FROM res LEFT JOIN registry r ON matched_ordinal = r.ordinal""",
)
def match_account(spark, sf):
    m = M.match_account(W.detected(spark, sf), W.registry(spark, sf))
    return m.drop("account", "bank_name").withColumn("similarity", F.round("similarity", 6))


_STATUS = """CASE WHEN matched_ordinal IS NOT NULL THEN 'own_account' WHEN starts_with(match_type, 'multiple') THEN match_type
  WHEN match_type = 'none' THEN 'no_account_match' ELSE 'error' END"""


@query("match_status", _MATCH + f" SELECT {_STATUS} AS status, match_type, count(*) AS n FROM res GROUP BY 1, 2")
def match_status(spark, sf):
    m = M.match_status(M.match_account(W.detected(spark, sf), W.registry(spark, sf)))
    return m.groupBy("status", "match_type").agg(F.count("*").alias("n"))


@query(
    "match_candidates",
    _MATCH
    + f""", o AS (SELECT DISTINCT ending_digits, coalesce(bank_name, '') AS detected_bank FROM res WHERE starts_with(match_type, 'multiple')),
      c AS (SELECT o.*, r.ordinal, r.account_number AS account, r.bank_name AS bank, r.routing_number AS routing FROM o JOIN registry r ON ends_with(r.account_number, ending_digits))
      SELECT ending_digits, detected_bank, ordinal, account, bank, routing, CASE WHEN detected_bank = '' THEN 0.0 ELSE round(CAST(sim AS DOUBLE), 6) END AS similarity
      FROM c LEFT JOIN sims ON a = {Q.norm_bank('detected_bank')} AND b = {Q.norm_bank('bank')} AND detected_bank <> ''""",
)
def match_candidates(spark, sf):
    r = W.registry(spark, sf)
    rows = M.candidate_rows(M.match_account(W.detected(spark, sf), r), r)
    return rows.withColumn("similarity", F.round("similarity", 6))


@query(
    "agg_candidate_details",
    _MATCH
    + f""", o AS (SELECT ending_digits, coalesce(bank_name, '') AS detected_bank, count(*) AS statements FROM res WHERE starts_with(match_type, 'multiple') GROUP BY ALL),
      c AS (SELECT o.*, r.bank_name AS bank FROM o JOIN registry r ON ends_with(r.account_number, ending_digits))
      SELECT ending_digits, detected_bank, any_value(statements) AS statements, count(*) AS candidate_count, count(DISTINCT bank) AS candidate_banks,
        max(CASE WHEN detected_bank = '' THEN 0.0 ELSE round(CAST(sim AS DOUBLE), 6) END) AS best_similarity
      FROM c LEFT JOIN sims ON a = {Q.norm_bank('detected_bank')} AND b = {Q.norm_bank('bank')} AND detected_bank <> '' GROUP BY 1, 2""",
)
def agg_candidate_details(spark, sf):
    r = W.registry(spark, sf)
    d = M.candidate_details(M.match_account(W.detected(spark, sf), r), r)
    return d.withColumn("best_similarity", F.round("best_similarity", 6))


_ROUTE = (
    V.ctes("registry", "detected", recursive=True)
    + f""", k AS (SELECT doc_id, account, bank_name, regexp_matches(account, '[*xX]') AS masked, {_DIG} AS key,
      CASE WHEN regexp_matches(account, '[*xX#]') THEN {_DIG} ELSE account END AS plain FROM detected WHERE bank_name IS NOT NULL),
  cand AS (SELECT k.*, r.ordinal, r.bank_name AS rb, ends_with(r.account_number, key) AS su, plain = r.account_number AS ex FROM k JOIN registry r ON (key <> '' AND ends_with(r.account_number, key)) OR plain = r.account_number),
  cnt AS (SELECT doc_id, count(*) AS n FROM cand WHERE su GROUP BY doc_id),
  pairs AS (SELECT DISTINCT {Q.norm_bank('c.bank_name')} AS a, {Q.norm_bank('rb')} AS b FROM cand c JOIN cnt ON c.doc_id = cnt.doc_id WHERE masked AND n > 1),
  {Q.SIMILARITY},
  scored AS (SELECT c.*, n, sim FROM cand c LEFT JOIN cnt ON c.doc_id = cnt.doc_id LEFT JOIN sims ON a = {Q.norm_bank('c.bank_name')} AND b = {Q.norm_bank('rb')} AND masked AND n > 1),
  staged AS (SELECT *, CASE WHEN masked AND su AND coalesce(sim, 0) > 0.4 THEN 1 WHEN masked AND su THEN 2 WHEN ex THEN 3 WHEN length(key) >= 3 THEN 4 END AS stage FROM scored),
  picked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stage, CASE WHEN stage = 1 THEN -sim ELSE 0 END, ordinal) AS r FROM staged WHERE stage IS NOT NULL)"""
)


@query(
    "match_routing",
    _ROUTE
    + """ SELECT d.doc_id, CASE stage WHEN 1 THEN 'masked_best_name' WHEN 2 THEN 'masked_first' WHEN 3 THEN 'exact' WHEN 4 THEN 'suffix_first' END AS routing_stage,
      p.ordinal AS matched_ordinal, g.routing_number, g.account_number AS matched_account
      FROM detected d LEFT JOIN (SELECT * FROM picked WHERE r = 1) p ON d.doc_id = p.doc_id LEFT JOIN registry g ON p.ordinal = g.ordinal""",
)
def match_routing(spark, sf):
    return M.match_routing(W.detected(spark, sf), W.registry(spark, sf)).drop("account", "bank_name")


_NAME_PAIRS = f"""names AS (SELECT DISTINCT bank_name, {Q.norm_bank('bank_name')} AS na FROM src WHERE bank_name IS NOT NULL),
  regs AS (SELECT *, {Q.norm_bank('bank_name')} AS nb FROM registry),
  pairs AS (SELECT DISTINCT na AS a, nb AS b FROM names, regs),
  {Q.SIMILARITY}"""


def _name_match(source, threshold):
    return (
        V.ctes("registry", "detected", recursive=True)
        + f""", src AS ({source}), {_NAME_PAIRS},
      ranked AS (SELECT n.bank_name, r.ordinal, sim, row_number() OVER (PARTITION BY n.bank_name ORDER BY sim DESC, r.ordinal) AS k
        FROM names n JOIN sims ON a = na JOIN regs r ON nb = b WHERE sim >= {threshold} - 1e-12),
      found AS (SELECT * FROM ranked WHERE k = 1)"""
    )


@query(
    "match_name_best",
    _name_match("SELECT doc_id, bank_name FROM detected", 0.7)
    + """ SELECT s.doc_id, round(CAST(sim AS DOUBLE), 6) AS match_confidence, f.ordinal AS matched_ordinal, r.routing_number AS matched_routing
       FROM src s LEFT JOIN found f ON s.bank_name = f.bank_name LEFT JOIN registry r ON f.ordinal = r.ordinal""",
)
def match_name_best(spark, sf):
    m = M.match_name(W.detected(spark, sf).select("doc_id", "bank_name"), W.registry(spark, sf))
    return m.select(
        "doc_id", F.round("match_confidence", 6).alias("match_confidence"), "matched_ordinal", "matched_routing"
    )


_FILES = "SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'First National Bank of NATION ' || upper(substr(p_name, 1, 1)) WHEN 1 THEN 'Nation ' || upper(substr(p_name, 1, 1)) || ' Fed. Credit Union' WHEN 2 THEN p_name || ' Bank' ELSE 'NATION B Comunity Bank' END AS bank_name FROM part"


@query(
    "match_with_fallback",
    _name_match(_FILES, 0.8)
    + """ SELECT s.doc_id, f.ordinal AS matched_ordinal, f.ordinal IS NOT NULL AS bank_info_found, CASE WHEN f.ordinal IS NULL THEN 'fallback' ELSE 'registry' END AS processing_method,
      CASE WHEN f.ordinal IS NULL THEN 'No matching bank found above 80% threshold' END AS fallback_reason
      FROM src s LEFT JOIN found f ON s.bank_name = f.bank_name""",
)
def match_with_fallback(spark, sf):
    k = F.col("p_partkey") % 4
    letter = F.upper(F.substring("p_name", 1, 1))
    name = (
        F.when(k == 0, F.concat(F.lit("First National Bank of NATION "), letter))
        .when(k == 1, F.concat(F.lit("Nation "), letter, F.lit(" Fed. Credit Union")))
        .when(k == 2, F.concat("p_name", F.lit(" Bank")))
        .otherwise("NATION B Comunity Bank")
    )
    docs = W.table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), name.alias("bank_name"))
    out = M.match_with_fallback(docs, W.registry(spark, sf))
    return out.select("doc_id", "matched_ordinal", "bank_info_found", "processing_method", "fallback_reason")


@query(
    "match_account_first",
    V.ctes("registry", "detected", recursive=True)
    + f""", src AS (SELECT doc_id, account, bank_name FROM detected), {_NAME_PAIRS},
      d AS (SELECT doc_id, account, bank_name, {_DIG} AS key FROM src),
      ex AS (SELECT doc_id, min(ordinal) AS o FROM d JOIN registry ON account = account_number GROUP BY doc_id),
      pt AS (SELECT d.doc_id, r.ordinal, row_number() OVER (PARTITION BY d.doc_id ORDER BY coalesce(sim, 0) DESC, r.ordinal) AS k
         FROM d JOIN regs r ON length(key) >= 4 AND ends_with(account_number, key) LEFT JOIN sims ON a = {Q.norm_bank('d.bank_name')} AND b = nb AND d.bank_name IS NOT NULL),
      nm AS (SELECT n.bank_name, r.ordinal, row_number() OVER (PARTITION BY n.bank_name ORDER BY sim DESC, r.ordinal) AS k
         FROM names n JOIN sims ON a = na JOIN regs r ON nb = b WHERE sim >= 0.7 - 1e-12),
      j AS (SELECT d.doc_id, d.account, ex.o AS eo, pt.ordinal AS po, nm.ordinal AS no FROM d LEFT JOIN ex ON d.doc_id = ex.doc_id
         LEFT JOIN pt ON d.doc_id = pt.doc_id AND pt.k = 1 LEFT JOIN nm ON d.bank_name = nm.bank_name AND nm.k = 1)
      SELECT j.doc_id, CASE WHEN eo IS NOT NULL THEN 'exact_account_match' WHEN po IS NOT NULL THEN 'partial_account_match' WHEN no IS NOT NULL THEN 'customer_statement' ELSE 'no_match' END AS match_type,
        coalesce(eo, po, no) AS matched_ordinal, CASE WHEN eo IS NULL AND po IS NULL AND no IS NOT NULL THEN j.account ELSE r.account_number END AS resolved_account, r.routing_number AS resolved_routing
      FROM j LEFT JOIN registry r ON coalesce(eo, po, no) = r.ordinal""",
)
def match_account_first(spark, sf):
    m = M.match_account_first(W.detected(spark, sf), W.registry(spark, sf))
    return m.drop("account", "bank_name")


_RANK = (
    V.ctes("registry", recursive=True)
    + f""", pairs AS (SELECT DISTINCT 'first national bank of nation c' AS a, lower(bank_name) AS b FROM registry), {Q.SIMILARITY},
      s AS (SELECT r.ordinal, r.bank_name, round(CAST(sim * 100 AS DOUBLE), 4) AS score FROM registry r JOIN sims ON b = lower(bank_name))
      SELECT ordinal, bank_name, score, score >= 70 AS similar"""
)


def _ranked(spark, sf):
    r = M.rank_similarity(W.registry(spark, sf), "First National Bank of NATION C")
    return r.select("ordinal", "bank_name", "score", "similar")


@query("rank_similarity", _RANK + " FROM s")
def rank_similarity(spark, sf):
    return _ranked(spark, sf)


@query("sort_similarity", _RANK + " FROM s ORDER BY score DESC, ordinal")
def sort_similarity(spark, sf):
    """The whole ranking, range-partitioned by the sort."""
    return _ranked(spark, sf).orderBy(F.desc("score"), "ordinal")


@query(
    "topk_match",
    _MATCH + " SELECT doc_id, ordinal, round(CAST(sim AS DOUBLE), 6) AS similarity FROM best WHERE r = 1 AND n > 1 AND bank_name IS NOT NULL",
)
def topk_match(spark, sf):
    d, r = W.detected(spark, sf), W.registry(spark, sf)
    masked = F.startswith("account", F.lit("XXXXXX")) & (F.length("account") == 10) | F.startswith("account", F.lit("***"))
    keyed = d.where(masked & F.col("bank_name").isNotNull()).select(
        "doc_id", F.col("bank_name").alias("_bank"), account_digits("account").alias("_key")
    )
    look = keyed.select("_bank", "_key").distinct()
    found = M.suffix_hits(look, r, F.lit(True)).where(F.col("best_hit").isNotNull())
    best = keyed.join(found, ["_bank", "_key"]).where(F.col("best_hit").isNotNull())
    return best.select(
        "doc_id", F.col("best_hit.ordinal").alias("ordinal"), F.round("best_similarity", 6).alias("similarity")
    )


# --- sets ------------------------------------------------------------------------------------------


def _numbers(spark, sf):
    return W.detected(spark, sf).select("doc_id", F.lpad(account_digits("account"), 12, "0").alias("number"))


_NUMS = _RD + f", nums AS (SELECT doc_id, lpad({_DIG}, 12, '0') AS number FROM detected) "


@query("semi_known_accounts", _NUMS + "SELECT doc_id, number FROM nums WHERE number IN (SELECT account_number FROM registry)")
def semi_known_accounts(spark, sf):
    return G.known_accounts(_numbers(spark, sf), W.registry(spark, sf))


@query("set_member", _NUMS + "SELECT DISTINCT number FROM nums WHERE number IN (SELECT account_number FROM registry)")
def set_member(spark, sf):
    return _numbers(spark, sf).select("number").intersect(W.registry(spark, sf).select(F.col("account_number").alias("number")))


@query("set_diff", _NUMS + "SELECT doc_id, number FROM nums WHERE number NOT IN (SELECT account_number FROM registry)")
def set_diff(spark, sf):
    return G.known_accounts(_numbers(spark, sf), W.registry(spark, sf), known=False)


@query(
    "diff_registry",
    V.ctes("registry")
    + """, a AS (SELECT account_number, bank_name, routing_number FROM registry),
      b AS (SELECT CASE WHEN ordinal % 10 = 5 THEN 'N' || account_number ELSE account_number END AS account_number, CASE WHEN ordinal % 7 = 0 THEN upper(bank_name) ELSE bank_name END AS bank_name, routing_number FROM registry)
      SELECT coalesce(a.account_number, b.account_number) AS account_number, a.bank_name AS a_bank_name, a.routing_number AS a_routing_number, b.bank_name AS b_bank_name, b.routing_number AS b_routing_number,
        a.account_number IS NOT NULL AND b.account_number IS NOT NULL AND coalesce(a.bank_name = b.bank_name, false) AS same_bank_name,
        a.account_number IS NOT NULL AND b.account_number IS NOT NULL AND coalesce(a.routing_number = b.routing_number, false) AS same_routing_number,
        CASE WHEN b.account_number IS NULL THEN 'only_a' WHEN a.account_number IS NULL THEN 'only_b' WHEN a.bank_name = b.bank_name AND a.routing_number = b.routing_number THEN 'equal' ELSE 'changed' END AS diff
      FROM a FULL JOIN b ON a.account_number = b.account_number""",
)
def diff_registry(spark, sf):
    r = W.registry(spark, sf)
    b = r.withColumn(
        "bank_name", F.when(F.col("ordinal") % 7 == 0, F.upper("bank_name")).otherwise(F.col("bank_name"))
    ).withColumn(
        "account_number",
        F.when(F.col("ordinal") % 10 == 5, F.concat(F.lit("N"), "account_number")).otherwise(F.col("account_number")),
    )
    return G.diff_registry(r, b)


@query(
    "flt_keyword",
    V.ctes("registry") + "SELECT ordinal, bank_name, account_number FROM registry WHERE contains(lower(bank_name), 'first national') AND ends_with(account_number, '03')",
)
def flt_keyword(spark, sf):
    return G.keyword_filter(W.registry(spark, sf), contains="First National", endswith="03").select(
        "ordinal", "bank_name", "account_number"
    )


_ORDER_COLUMNS = [
    ("o_orderkey", "bigint"),
    ("o_custkey", "bigint"),
    ("o_orderstatus", "string"),
    ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"),
    ("o_orderpriority", "string"),
]


@query(
    "agg_profile",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, count(*) - count({c}) AS nulls, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, "
        + (f"round(avg({c}), 4)" if t in ("bigint", "double") else "CAST(NULL AS DOUBLE)")
        + " AS mean FROM orders"
        for c, t in _ORDER_COLUMNS
    ) + ")",
)
def agg_profile(spark, sf):
    return G.profile(W.table(spark, sf, "orders")).withColumn("mean", F.round("mean", 4))


_DESCRIBED = {
    "orders": _ORDER_COLUMNS,
    "documents": [("doc_id", "bigint"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")],
}


@query(
    "agg_describe",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count({c}) AS non_null, count(*) - count({c}) AS nulls, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, "
        + (f"round(avg({c}), 4) AS mean, round(stddev({c}), 3) AS std" if k in ("bigint", "int", "double") else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std")
        + f" FROM {t}"
        for t, cs in _DESCRIBED.items() for c, k in cs
    ) + ")",
)
def agg_describe(spark, sf):
    """The exact part of the description; the sketches are in ``agg_describe_sketches``."""
    out = None
    for t, cs in _DESCRIBED.items():
        wanted = W.table(spark, sf, t)
        rows = G.describe(wanted.select([c for c, _ in cs]))
        rows = rows.select(
            F.lit(t).alias("table"), "column", "non_null", "nulls", "min_value", "max_value",
            F.round("mean", 4).alias("mean"), F.round("std", 3).alias("std"),
        )
        out = rows if out is None else out.union(rows)
    return out


@query("agg_describe_sketches")
def agg_describe_sketches(spark, sf):
    """Distinct values, quartiles and most frequent values of all columns of two tables."""
    out = None
    for t in _DESCRIBED:
        rows = G.describe(W.table(spark, sf, t)).select(
            F.lit(t).alias("table"), "column", "unique", "top", "freq", "freq_error", "q1", "median", "q3"
        )
        out = rows if out is None else out.union(rows)
    return out


_OTHER = """, a AS (SELECT account_number, bank_name, routing_number FROM registry),
  b AS (SELECT account_number, CASE ordinal % 6 WHEN 0 THEN 'The ' || bank_name WHEN 1 THEN replace(bank_name, 'Bank', 'Banc') ELSE bank_name END AS bank_name, routing_number FROM registry WHERE ordinal % 11 <> 0)"""


def _other_registry(r):
    k = F.col("ordinal") % 6
    name = (
        F.when(k == 0, F.concat(F.lit("The "), "bank_name"))
        .when(k == 1, F.replace("bank_name", F.lit("Bank"), F.lit("Banc")))
        .otherwise(F.col("bank_name"))
    )
    return r.where(F.col("ordinal") % 11 != 0).withColumn("bank_name", name)


@query(
    "diff_registry_names",
    V.ctes("registry", recursive=True)
    + _OTHER
    + f""", pairs AS (SELECT DISTINCT lower(a.bank_name) AS a, lower(b.bank_name) AS b FROM a JOIN b ON a.account_number = b.account_number WHERE a.bank_name <> b.bank_name), {Q.SIMILARITY}
      SELECT a.account_number, a.bank_name AS a_bank_name, b.bank_name AS b_bank_name,
        CASE WHEN b.account_number IS NULL THEN 'only_a' WHEN a.bank_name = b.bank_name THEN 'equal' ELSE 'changed' END AS diff, round(CAST(sim AS DOUBLE), 6) AS name_similarity
      FROM a LEFT JOIN b ON a.account_number = b.account_number LEFT JOIN sims ON sims.a = lower(a.bank_name) AND sims.b = lower(b.bank_name) AND a.bank_name <> b.bank_name""",
)
def diff_registry_names(spark, sf):
    r = W.registry(spark, sf)
    rows = G.name_changes(G.diff_registry(r, _other_registry(r), columns=("bank_name",)))
    return rows.select("account_number", "a_bank_name", "b_bank_name", "diff", F.round("name_similarity", 6).alias("name_similarity"))


@query(
    "diff_registry_rows",
    V.ctes("registry")
    + _OTHER
    + " SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
)
def diff_registry_rows(spark, sf):
    r = W.registry(spark, sf)
    keep = ["account_number", "bank_name", "routing_number"]
    return G.two_way_difference(r.select(keep), _other_registry(r).select(keep))
