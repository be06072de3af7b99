"""Parsed-statement JSON: fenced answers, cut answers, flat transaction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import schemas as S
from tallymark.functions.predicates import strip


def unfence(text) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return strip(F.regexp_replace(F.regexp_replace(strip(t), r"^```(?:json)?", ""), r"```$", ""))


def _transactions_array(body: Column) -> Column:
    """The balanced `"transactions": [...]` part of a text, null when it is cut.

    Objects of the contract hold no nested arrays, so the array ends at the first bracket that
    stands outside a string.
    """
    inner = F.regexp_extract(
        body, r'(?s)"transactions": \[((?:[^\[\]"]|"(?:[^"\\]|\\.)*+")*+)\]', 1
    )
    return F.when(
        body.rlike(r'(?s)"transactions": \[(?:[^\[\]"]|"(?:[^"\\]|\\.)*+")*+\]'),
        F.concat(F.lit('{"transactions": ['), inner, F.lit("]}")),
    )


def parse_statement_json(df: DataFrame, text_col: str = "text", out: str = "statement") -> DataFrame:
    """Contract struct of each answer; a cut answer keeps its complete transactions array."""
    body = unfence(text_col)
    staged = df.withColumn("_b", body)
    whole = F.from_json("_b", S.STATEMENT, {"mode": "PERMISSIVE"})
    is_json = F.try_parse_json(F.col("_b")).isNotNull()
    partial = F.from_json(_transactions_array(F.col("_b")), S.STATEMENT)
    return staged.select(
        *df.columns,
        F.when(is_json, whole).otherwise(partial).alias(out),
        F.when(is_json, "complete").when(partial.isNotNull(), "recovered").otherwise("failed").alias("parse_status"),
    )


def statement_transactions(df: DataFrame, key_cols, col: str = "statement") -> DataFrame:
    return df.select(*key_cols, F.posexplode(f"{col}.transactions").alias("pos", "t")).select(
        *key_cols,
        "pos",
        F.col("t.date").alias("txn_date"),
        (F.col("t.amount") * 100).cast("bigint").alias("amount_cents"),
        F.col("t.description").alias("description"),
        F.col("t.type").alias("txn_type"),
    )
