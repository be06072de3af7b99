"""Registered queries of this subpackage and their DuckDB checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import (
    ann,
    bpe_words,
    exact_dedup,
    language,
    licenses,
    line_dedup,
    near_dedup,
    packing,
    repeated_spans,
    resampling,
    turn_repair,
    url_filter,
    vector_codes,
)
from tallymark.llm.license_texts import BASE_PHRASES, TEMPLATES
from tallymark.llm.shared import table, tokenizer_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


@query("op1_distinct_word_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return bpe_words.digests(bpe_words.encode(table(spark, sf_dir, "documents"), ranks), ranks)


@query("op3_cost_balanced_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = f.read()
    return packing.pack(table(spark, sf_dir, "documents"), model)


@query("op6_importance_resampling")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "log_ratio", "key", "kept")


@query("op7_ftrl_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language.identify(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query(
    "op8_tree_merge_dedup",
    """
    WITH d AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents
    )
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t)
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.groups(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query(
    "op9_hyperminhash_dedup",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents
    ), s AS (
      SELECT DISTINCT doc_id, sh FROM (
        SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.doc_id),
    c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
    SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON c.doc_id = n.doc_id
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


@query("op10_diagonal_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), BASE_PHRASES, TEMPLATES)


URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query("op2_url_markov_ratio")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op5_fuzzy_line_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate_lines(table(spark, sf_dir, "documents")).drop("row")


@query("op4_pruned_graph_neighbours")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


@query("op11_adaptive_bound_codes")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(table(spark, sf_dir, "embeddings"))


@query(
    "op12_seed_and_extend_dedup",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    w AS (
      SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)
    ), r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
    gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM r) GROUP BY doc_id),
    kept AS (
      SELECT d.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
        CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END AS k
      FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
    )
    SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.digests(table(spark, sf_dir, "documents"))


@query("op13_generalised_lr_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))
