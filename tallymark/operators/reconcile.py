"""Balances against transactions, transaction profiles and their comment lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import fixed as K
from tallymark.functions.predicates import volume_class
from tallymark.functions.scalars import money_text


def transaction_totals(txns: DataFrame, key_cols, amount: str = "amount_cents") -> DataFrame:
    """Deposits and withdrawals per key; sums combine before the shuffle, so a hot account is safe."""
    a = F.col(amount)
    return txns.groupBy(*key_cols).agg(
        F.sum(F.when(a > 0, a).otherwise(0)).alias("total_deposits"),
        F.sum(F.when(a > 0, 0).otherwise(-a)).alias("total_withdrawals"),
        F.count("*").alias("transaction_count"),
        F.count_if(a > 0).alias("deposit_count"),
        F.count_if(~(a > 0)).alias("withdrawal_count"),
    )


def reconcile(
    balances: DataFrame,
    txns: DataFrame,
    key_cols,
    amount: str = "amount_cents",
    infer_missing: bool = False,
    tolerance: int = 1,
) -> DataFrame:
    """Opening + deposits - withdrawals against closing, all in cents.

    ``balances`` has ``opening`` and ``closing`` (null when unknown). A failed statement is a
    row with status FAILED. ``infer_missing`` computes one missing balance and reports PARTIAL.
    """
    totals = transaction_totals(txns, key_cols, amount)
    joined = balances.join(totals, list(key_cols), "left")
    zero = F.lit(0).cast("bigint")
    for c in ("total_deposits", "total_withdrawals", "transaction_count", "deposit_count", "withdrawal_count"):
        joined = joined.withColumn(c, F.coalesce(F.col(c), zero))
    o, c, d, w = (F.col(x) for x in ("opening", "closing", "total_deposits", "total_withdrawals"))
    suspicious = F.coalesce((F.abs(o - d) < 1) & (o > 100000), F.lit(False))
    known_o = o.isNotNull() & ~suspicious
    known_c = c.isNotNull()
    both = known_o & known_c
    expected = F.when(both, o + d - w)
    if infer_missing:
        expected = F.when(known_o, o + d - w).when(known_c, c)
    diff = F.when(both, F.abs(c - (o + d - w))).otherwise(0)
    balanced = both & (diff <= tolerance)
    if infer_missing:
        status = (
            F.when(both & balanced, "COMPLETE")
            .when(both, "FAILED")
            .when(known_o | known_c, "PARTIAL")
            .otherwise("FAILED")
        )
    else:
        status = F.when(both & balanced, "COMPLETE").when(both, "FAILED").otherwise("INCOMPLETE")
    warnings = F.array_compact(
        F.array(
            F.when(suspicious, "Opening balance likely confused with large deposit"),
            F.when(
                both & ~balanced,
                F.concat(F.lit("Balance reconciliation failed: difference of $"), money_text(diff)),
            ),
        )
    )
    columns = [
        *[F.col(k) for k in key_cols],
        F.coalesce(o, zero).alias("opening_balance"),
        known_o.alias("opening_balance_known"),
        F.coalesce(c, zero).alias("closing_balance"),
        known_c.alias("closing_balance_known"),
        d,
        w,
        expected.alias("expected_closing"),
        diff.alias("difference"),
        balanced.alias("balanced"),
        F.col("transaction_count"),
        F.col("deposit_count"),
        status.alias("reconciliation_status"),
        warnings.alias("warnings"),
    ]
    if not infer_missing:
        return joined.select(*columns)
    inferred_open = F.when(known_o, o).when(known_c, c - d + w)
    codes = F.array_compact(
        F.array(
            F.when(~known_o, "OB_UNKNOWN"),
            F.when(~known_c, "CB_UNKNOWN"),
            F.when(both & ~balanced, "BALANCE_MISMATCH"),
            F.when((both & ~balanced) | (~known_o & ~known_c), "RECON_FAILED"),
        )
    )
    return joined.select(*columns, inferred_open.alias("inferred_opening"), codes.alias("error_codes"))


def balance_comments() -> Column:
    """Comment lines that a reconciliation row puts in front of BAI2 records."""

    def money(c):
        return F.concat(F.lit("$"), money_text(c))

    signed = F.col("closing_balance") - F.col("expected_closing")
    known = F.col("opening_balance_known") & F.col("closing_balance_known")

    def balance(label, value, is_known):
        return F.when(
            is_known, F.concat(F.lit(f"#{label}: "), money(value), F.lit(K.COMMENT_KNOWN))
        ).otherwise(F.lit(f"#{label}{K.COMMENT_MISSING}"))

    status = F.col("reconciliation_status")
    lines = F.array(
        F.concat(F.lit(K.COMMENT_STATUS), status),
        balance(K.COMMENT_OPENING, F.col("opening_balance"), F.col("opening_balance_known")),
        balance(K.COMMENT_CLOSING, F.col("closing_balance"), F.col("closing_balance_known")),
        F.concat(
            F.lit(K.COMMENT_DEPOSITS),
            money(F.col("total_deposits")),
            F.lit(" ("),
            F.col("deposit_count").cast("string"),
            F.lit(K.COMMENT_COUNT),
        ),
        F.concat(F.lit(K.COMMENT_WITHDRAWALS), money(F.col("total_withdrawals"))),
        F.when(known, F.concat(F.lit(K.COMMENT_EXPECTED), money(F.col("expected_closing")))),
        F.when(status == "FAILED", F.concat(F.lit(K.COMMENT_DIFFERENCE), money(signed))),
        F.when(status == "FAILED", F.lit(K.COMMENT_FAILED)),
        F.when(
            F.size("warnings") > 0,
            F.concat(F.lit(K.COMMENT_WARNINGS + K.COMMENT_WARNING), F.array_join("warnings", K.COMMENT_WARNING)),
        ),
        *[F.when(status == of, F.lit(advice)) for of, advice in K.COMMENT_ADVICE.items()],
    )
    return F.array_join(F.array_compact(lines), "\n")


def transaction_profile(txns: DataFrame, key_cols, date: str, amount: str = "amount_cents") -> DataFrame:
    """Counts by sign, date range, missing dates, printed date formats and the volume class."""
    d, a = F.col(date), F.col(amount)
    fmt = (
        F.when(d.isNull() | (d == ""), None)
        .when(F.contains(d, F.lit("/")), "MM/DD/YYYY")
        .when(F.contains(d, F.lit("-")) & (F.length(d) == 10), "YYYY-MM-DD")
        .otherwise("OTHER")
    )
    has = fmt.isNotNull()
    return (
        txns.groupBy(*key_cols)
        .agg(
            F.count("*").alias("transaction_count"),
            F.count_if(a > 0).alias("deposit_count"),
            F.count_if(a < 0).alias("withdrawal_count"),
            F.count_if(~has).alias("missing_dates"),
            F.min(F.when(has, d)).alias("first_date"),
            F.max(F.when(has, d)).alias("last_date"),
            F.array_sort(F.collect_set(fmt)).alias("date_formats"),
        )
        .withColumn("volume", volume_class("transaction_count"))
    )


def count_by_date(txns: DataFrame, key_cols, date: str) -> DataFrame:
    return txns.where(F.col(date).isNotNull()).groupBy(*key_cols, date).agg(F.count("*").alias("n"))
