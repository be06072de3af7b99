"""Character n-grams of a column with built-in expressions, linear in the length of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pieces(text: Column, n: int, size: int) -> Column:
    """Array of cuts of ``size`` characters that overlap by n - 1, so that each n-gram lies in one
    piece and no look-up walks through more than a piece."""
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - (n - 1)) / F.lit(size)).cast("int") - 1)
    wide = size * 64
    if size >= 4096:
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.substring(text, c * size + 1, F.lit(size + n - 1)))
    outer = pieces(text, n, wide)
    return F.when(F.length(text) <= size + n - 1, F.array(text)).otherwise(
        F.flatten(
            F.transform(
                outer,
                lambda part: F.transform(
                    F.sequence(
                        F.lit(0),
                        F.greatest(F.lit(0), F.ceil((F.length(part) - (n - 1)) / F.lit(size)).cast("int") - 1),
                    ),
                    lambda c: F.substring(part, c * size + 1, F.lit(size + n - 1)),
                ),
            )
        )
    )


def exploded(df: DataFrame, text: str, n: int, into: str, size: int = 64) -> DataFrame:
    """``df`` with a row per character n-gram of ``text`` (the whole text where it is shorter)."""
    parts = df.withColumn("__piece", F.explode(pieces(F.col(text), n, size)))
    last = F.greatest(F.lit(1), F.length("__piece") - (n - 1))
    return (
        parts.withColumn("__at", F.explode(F.sequence(F.lit(1), last)))
        .withColumn(into, F.substring(F.col("__piece"), F.col("__at"), F.lit(n)))
        .drop("__piece", "__at")
    )
