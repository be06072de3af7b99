"""Scalar text, money and date functions as native Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions import fixed as K
from tallymark.functions.predicates import _col, strip


def mask_digits(c) -> Column:
    """Masked account text to its digits, other text unchanged."""
    s = _col(c)
    return F.when(s.rlike("[*xX#]"), F.regexp_replace(s, "[^0-9]", "")).otherwise(s)


def account_digits(c) -> Column:
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), "[^0-9]", "")


def strip_zeros(c) -> Column:
    return F.ltrim(_col(c), F.lit("0"))


def norm_bank(c) -> Column:
    """Bank name reduced to its comparable core."""
    s = strip(F.upper(F.coalesce(_col(c), F.lit(""))))
    s = F.regexp_replace(s, r"[,\.]+", "")
    s = F.regexp_replace(s, r"\s+", " ")
    s = F.regexp_replace(s, r"\b(?:STOCK\s+YARDS|STOCKYARDS)\b", "STOCK YARDS")
    s = F.regexp_replace(s, r"\s*&\s*", " ")
    s = F.regexp_replace(s, r"\s+AND\s+", " ")
    s = reduce(lambda a, p: F.regexp_replace(a, p, ""), K.BANK_NORM_SUFFIXES, s)
    s = reduce(lambda a, r: F.replace(a, F.lit(r[0]), F.lit(r[1])), K.BANK_NORM_REPLACEMENTS, s)
    return strip(F.regexp_replace(s, r"\s+", " "))


def line_feeds(c) -> Column:
    """Every kind of line break as a line feed. One search settles texts that have no other kind."""
    s = _col(c)
    return F.when(s.rlike(K.ODD_LINE_BREAK), F.regexp_replace(s, K.LINE_BREAK, "\n")).otherwise(s)


def sanitize(c) -> Column:
    """Description safe for a BAI2 record. One search settles texts that need no more than their ends trimmed."""
    s = F.replace(F.coalesce(_col(c), F.lit("")), F.lit("/"), F.lit("-"))
    spaced = F.regexp_replace(F.regexp_replace(s, r"[^\x20-\x7E]", " "), "  +", " ")
    return F.btrim(F.when(s.rlike(r"[^\x20-\x7E]|  "), spaced).otherwise(s))


def sanitize_reasons(c) -> Column:
    s = F.coalesce(_col(c), F.lit(""))
    slash, control, non_ascii = K.SANITIZE_REASONS
    reasons = F.array_compact(
        F.array(
            F.when(F.contains(s, F.lit("/")), slash),
            F.when(s.rlike(r"[\x00-\x1F\x7F]"), control),
            F.when(s.rlike(r"[^\x00-\x7F]"), non_ascii),
        )
    )
    return F.when(s.rlike(r"[^\x20-\x2E\x30-\x7E]"), reasons).otherwise(F.array().cast("array<string>"))


def sanitize_changed(c) -> Column:
    s = F.coalesce(_col(c), F.lit(""))
    return sanitize(s) != s


def int_cents(c, legacy: bool = False) -> Column:
    """Amount text to integer cents (text). Legacy keeps the digits and nothing else. Texts that hold a number
    and nothing else are not cleaned first."""
    s = F.coalesce(_col(c), F.lit(""))
    digits = F.regexp_replace(s, r"\D", "")
    if legacy:
        return digits
    clean = F.regexp_replace(s, r"[^0-9.\-]", "")

    def scaled(number):
        return F.round(number.try_cast("decimal(30,4)") * 100).cast("decimal(30,0)").cast("string")

    return (
        F.when(s.rlike(r"^-?\d+\z"), s)
        .when(s.rlike(r"^-?\d*\.\d+\z"), scaled(s))
        .when(clean.rlike(r"^-?\d+$"), clean)
        .when(clean.rlike(r"^-?\d*\.\d+$"), scaled(clean))
        .otherwise(digits)
    )


def int_cents_changed(c, legacy: bool = False) -> Column:
    return int_cents(c, legacy) != F.coalesce(_col(c), F.lit(""))


def amount(c) -> Column:
    """Printed money to decimal(18,2); unreadable text is 0."""
    clean = F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"[^0-9.\-]", "")
    return F.coalesce(clean.try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def amount_cents(c) -> Column:
    return (amount(c) * 100).cast("bigint")


def money_text(cents) -> Column:
    """1234567 -> 12,345.67 (sign kept in front)."""
    return F.format_number((_col(cents) / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)"), 2)


# --- dates -----------------------------------------------------------------------


def _try_date(s: Column, fmt: str) -> Column:
    return F.to_date(F.try_to_timestamp(s, F.lit(fmt)))


def _short_year(s: Column) -> Column:
    """M/d/yy with the POSIX pivot: 69-99 are 19xx."""
    d = _try_date(s, "M/d/yy")
    return F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)


def slash_date(c) -> Column:
    s = _col(c)
    return (
        F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), _try_date(s, "M/d/yyyy"))
        .when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), _short_year(s))
    )


def loose_date(c) -> Column:
    """Date printed as M/D/Y, M/D/YY, Y-M-D, M-D-Y or `June 30, 2025`."""
    s = _col(c)
    return (
        F.when(s.rlike(r"^\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})$"), slash_date(s))
        .when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), _try_date(s, "yyyy-M-d"))
        .when(s.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"), _try_date(s, "M-d-yyyy"))
        .when(s.rlike(r"^[A-Z][a-z]+ \d{1,2}, \d{4}$"), _try_date(s, "MMMM d, yyyy"))
    )


def filename_date(c) -> Column:
    s = _col(c)
    steps = []
    for pattern, order in K.FILENAME_DATE_PATTERNS:
        g = [F.regexp_extract(s, pattern, i) for i in (1, 2, 3)]
        if order == "ymd":
            text = F.concat_ws("-", g[0], g[1], g[2])
        elif order == "mdy":
            text = F.concat_ws("-", g[2], g[0], g[1])
        else:
            text = F.concat_ws("-", F.concat(F.lit("20"), g[2]), g[0], g[1])
        steps.append(F.when(g[0] != "", _try_date(text, "yyyy-M-d")))
    return F.coalesce(*steps)


def yymmdd(d) -> Column:
    return F.date_format(_col(d), "yyMMdd")


# --- text statistics ---------------------------------------------------------------


def word_count(c) -> Column:
    return F.size(F.filter(F.split(_col(c), r"[\s\xa0]+"), lambda w: w != ""))


def line_count(c) -> Column:
    return F.size(F.split(_col(c), "\n"))


def bank_from_filename(c) -> Column:
    low = F.lower(F.substring_index(_col(c), "/", -1))
    out = F
    for word, name in K.FILENAME_BANKS:
        out = out.when(F.contains(low, F.lit(word)), name)
    return out
