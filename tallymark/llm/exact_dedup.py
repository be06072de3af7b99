"""Exact deduplication by a tree merge of sorted digest runs.

Texts are equal when they are identical after lower-casing A-Z; null is the empty text. Each input
partition becomes one run: its rows' SHA-256 digests, sorted, on the shared folder. Runs then merge
in rounds: a round of fan-in ``2**bits`` (``bits`` binomial rounds at once) joins neighbouring runs,
keeping for each digest the identifier that stays and the number of rows. A digest is verified at
every level by the text's byte length and a second, independent hash. The last run holds one row
per different text; it stays spread over all partitions by digest.

What moves are digests (some 60 bytes a row), never texts, and a group of copies is one row per run
from the first level on, however large it is. The final join hands each row its group; a hot digest
is a skewed join side, which adaptive execution splits.

Defined results: a null or empty text is a group like any other; rows that repeat an identifier and
a text are copies, of which exactly one stays; a null identifier stays only in a group without
others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.shared import lower_ascii, stored, without_rows

DIGEST = ["digest", "second", "n_bytes"]


def sorted_runs(docs: DataFrame) -> DataFrame:
    """(run, row, doc_id, digest, second, n_bytes): one sorted run per input partition, written once."""
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    runs = docs.select(
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.array(text).alias("texts"),
    ).select("run", "row", "doc_id", F.explode("texts").alias("text")).select(
        "run",
        "row",
        "doc_id",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.xxhash64("text").alias("second"),
        F.octet_length("text").alias("n_bytes"),
    )
    return stored(runs.sortWithinPartitions("digest"), "digest-runs")


def tree_merge(runs: DataFrame, keep: Column, bits: int = 3) -> DataFrame:
    """One row per digest with the largest ``keep`` (a struct) and the number of rows."""
    last = runs.agg(F.max("run")).first()[0] or 0
    merged = runs.groupBy("run", *DIGEST).agg(F.max(keep).alias("keep"), F.count("*").alias("n"))
    while last > 0:
        last >>= bits
        merged = merged.groupBy(F.shiftright("run", bits).alias("run"), *DIGEST).agg(
            F.max("keep").alias("keep"), F.sum("n").alias("n")
        )
    return merged.drop("run")


def groups(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` with its group: row, doc_id, keep_id, group_size, kept, digest.

    The row with the largest ``doc_id`` stays (of repeated rows the last read)."""
    runs = sorted_runs(docs)
    best = tree_merge(runs, F.struct("doc_id", "row"))
    return runs.join(best, DIGEST).select(
        "row",
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "digest",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return without_rows(docs, groups(docs).where(~F.col("kept")).select("row"))
