"""Set-like work on registries: membership, differences, keyword filters, column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.similarity import ratio


def known_accounts(numbers: DataFrame, registry: DataFrame, number: str = "number", known: bool = True) -> DataFrame:
    """Extracted numbers that are (or are not) accounts of the registry."""
    how = "left_semi" if known else "left_anti"
    return numbers.join(registry, numbers[number] == registry["account_number"], how)


def diff_registry(a: DataFrame, b: DataFrame, key: str = "account_number", columns=("bank_name", "routing_number")) -> DataFrame:
    """Accounts of two registries side by side with what differs."""
    left = a.select(F.col(key).alias("_ka"), *[F.col(c).alias(f"a_{c}") for c in columns])
    right = b.select(F.col(key).alias("_kb"), *[F.col(c).alias(f"b_{c}") for c in columns])
    both = left.join(right, F.col("_ka") == F.col("_kb"), "full_outer")
    in_both = F.col("_ka").isNotNull() & F.col("_kb").isNotNull()
    same = [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in columns]
    all_same = same[0]
    for s in same[1:]:
        all_same = all_same & s
    return both.select(
        F.coalesce("_ka", "_kb").alias(key),
        *[F.col(f"a_{c}") for c in columns],
        *[F.col(f"b_{c}") for c in columns],
        *[(in_both & s).alias(f"same_{c}") for c, s in zip(columns, same)],
        F.when(F.col("_kb").isNull(), "only_a")
        .when(F.col("_ka").isNull(), "only_b")
        .when(all_same, "equal")
        .otherwise("changed")
        .alias("diff"),
    )


def name_changes(diff: DataFrame, a: str = "a_bank_name", b: str = "b_bank_name") -> DataFrame:
    """:func:`diff_registry` with the similarity of the two names (lower case) of every changed account. Each
    pair of names is compared once, however many accounts changed alike."""
    named = diff.where((F.col("diff") == "changed") & F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = named.select(F.lower(a).alias("_a"), F.lower(b).alias("_b")).distinct()
    scored = pairs.withColumn("name_similarity", ratio("_a", "_b"))
    on = (F.lower(F.col(a)) == F.col("_a")) & (F.lower(F.col(b)) == F.col("_b")) & (F.col("diff") == "changed")
    return diff.join(scored, on, "left").drop("_a", "_b")


def two_way_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, as often as it lacks them, with the side that has them."""
    only = lambda x, y, side: x.exceptAll(y).withColumn("side", F.lit(side))
    b = b.select(a.columns)
    return only(a, b, "a").union(only(b, a, "b"))


def keyword_filter(registry: DataFrame, contains=None, endswith=None, account=None, accounts=None) -> DataFrame:
    """Rows that meet every given test."""
    out = registry
    if contains is not None:
        out = out.where(F.contains(F.lower("bank_name"), F.lit(contains.lower())))
    if endswith is not None:
        out = out.where(F.endswith("account_number", F.lit(endswith)))
    if account is not None:
        out = out.where(F.col("account_number") == account)
    if accounts is not None:
        out = out.where(F.col("account_number").isin(list(accounts)))
    return out


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, filled and empty cells, smallest and largest value, mean of numbers.

    One aggregation over the table, then its single row is turned into one row per column.
    """
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    aggs = []
    for i, (c, t) in enumerate(df.dtypes):
        is_num = t in numeric or t.startswith("decimal")
        aggs += [
            F.count(F.col(f"`{c}`")).alias(f"n{i}"),
            F.count_if(F.col(f"`{c}`").isNull()).alias(f"z{i}"),
            F.min(F.col(f"`{c}`")).cast("string").alias(f"lo{i}"),
            F.max(F.col(f"`{c}`")).cast("string").alias(f"hi{i}"),
            (F.avg(F.col(f"`{c}`")) if is_num else F.lit(None).cast("double")).alias(f"m{i}"),
        ]
    one = df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(t).alias("dtype"),
                F.col(f"n{i}").alias("non_null"),
                F.col(f"z{i}").alias("nulls"),
                F.col(f"lo{i}").alias("min_value"),
                F.col(f"hi{i}").alias("max_value"),
                F.col(f"m{i}").alias("mean"),
            )
            for i, (c, t) in enumerate(df.dtypes)
        ]
    )
    return one.select(F.explode(rows).alias("x")).select("x.*")


#: Counters of the frequent-item sketch; a frequency is short by at most 3.5 rows in TRACKED, if at all.
TRACKED = 1000
ACCURACY = 10_000
RSD = 0.02


def describe(df: DataFrame, tracked: int = TRACKED, accuracy: int = ACCURACY, rsd: float = RSD) -> DataFrame:
    """A full description of every column that can be ordered, in one aggregation over the table.

    Exact: filled and empty cells, mean, sample deviation, smallest and largest value. By sketches of fixed
    size: ``unique`` (relative standard error ``rsd``), quartiles of numbers, dates and times (rank off by at
    most one row in ``accuracy``) and the most frequent value ``top`` with its ``freq``, which is off by at most
    ``freq_error`` rows (none while a column has fewer than three quarters of ``tracked`` values; null when no
    value is known to be that frequent).
    """
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    ordered = numeric | {"date", "timestamp", "timestamp_ntz"}
    plain = ordered | {"string", "boolean"}
    columns = [(c, t) for c, t in df.dtypes if t in plain or t.startswith(("decimal", "varchar", "char"))]
    none = lambda t: F.lit(None).cast(t)
    aggs = [F.count("*").alias("n")]
    for i, (c, t) in enumerate(columns):
        x = F.col(f"`{c}`")
        number = t in numeric or t.startswith("decimal")
        quartile = F.percentile_approx(x, [0.25, 0.5, 0.75], accuracy) if number or t in ordered else none("array<string>")
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.approx_count_distinct(x, rsd).alias(f"u{i}"),
            F.expr(f"approx_top_k(`{c}`, 1, {tracked})").alias(f"t{i}"),
            (F.avg(x).cast("double") if number else none("double")).alias(f"m{i}"),
            (F.stddev(x).cast("double") if number else none("double")).alias(f"s{i}"),
            F.min(x).cast("string").alias(f"lo{i}"),
            F.max(x).cast("string").alias(f"hi{i}"),
            quartile.cast("array<string>").alias(f"q{i}"),
        ]
    one = df.agg(*aggs)
    rows = []
    for i, (c, t) in enumerate(columns):
        error = F.when(F.col(f"u{i}") * 1.1 < tracked * 0.75, 0).otherwise(F.ceil(F.col(f"n{i}") * 3.5 / tracked))
        best = F.try_element_at(F.filter(f"t{i}", lambda x: x["item"].isNotNull()), F.lit(1))
        sure = best["count"] > error
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(t).alias("dtype"),
                F.col(f"n{i}").alias("non_null"),
                (F.col("n") - F.col(f"n{i}")).alias("nulls"),
                F.col(f"u{i}").alias("unique"),
                F.when(sure, best["item"].cast("string")).alias("top"),
                F.when(sure, best["count"]).alias("freq"),
                error.cast("long").alias("freq_error"),
                F.col(f"m{i}").alias("mean"),
                F.col(f"s{i}").alias("std"),
                F.col(f"lo{i}").alias("min_value"),
                *(F.try_element_at(f"q{i}", F.lit(k + 1)).alias(q) for k, q in enumerate(("q1", "median", "q3"))),
                F.col(f"hi{i}").alias("max_value"),
            )
        )
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
