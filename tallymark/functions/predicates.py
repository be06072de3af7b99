"""Column predicates and classifiers. All native expressions, no Python workers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions import fixed as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` with ``value`` bound to a lambda variable.

    An expression named twice is computed twice, and inside another lambda once per element;
    bound this way it is computed once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_over(values: Column, body) -> Column:
    """First non-null ``body(value, index)``; later values are not looked at once one is found."""
    return F.aggregate(
        F.sequence(F.lit(0), F.size(values) - 1),
        F.lit(None).cast("string"),
        lambda acc, i: F.coalesce(acc, body(F.get(values, i), i)),
    )


def strip(c) -> Column:
    """Trim every kind of whitespace from both ends."""
    return F.btrim(_col(c), F.lit(K.WHITESPACE))


def any_contains(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def one_of(c: Column, words) -> Column:
    """Membership in a fixed word list (words without commas), as one native call."""
    return F.find_in_set(c, F.lit(",".join(words))) > 0


def _one_char_only(c: Column) -> Column:
    return F.length(F.replace(c, F.substring(c, 1, 1), F.lit(""))) == 0


def _plain_account_ok(s: Column) -> Column:
    clean = F.regexp_replace(s, "[-_ ]", "")
    return (
        (F.length(clean) >= 4)
        & ~one_of(F.lower(clean), K.ACCOUNT_STOP_WORDS)
        & clean.rlike(r"^[\p{L}\p{N}]+$")
        & ~_one_char_only(clean)
    )


def is_valid_account(c) -> Column:
    """Usable account text: masked with 3+ digits, hyphenated with 4+, or a plain number."""
    s = strip(c)
    n_digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    return (
        F.when(F.coalesce(s, F.lit("")) == "", F.lit(False))
        .when(s.rlike("[*xX#]"), n_digits >= 3)
        .when(F.contains(s, F.lit("-")), n_digits >= 4)
        .otherwise(_plain_account_ok(s))
    )


def is_valid_account_strict(c) -> Column:
    """Earlier rule: no masks, no bare four-digit numbers."""
    s = strip(c)
    clean = F.regexp_replace(s, "[-_ ]", "")
    return (
        F.when(F.coalesce(s, F.lit("")) == "", F.lit(False))
        .when(F.contains(s, F.lit("*")), F.lit(False))
        .when(s.rlike("[xX#]") & (F.length(s) <= 8), F.lit(False))
        .when(clean.rlike(r"^\d{4}$"), F.lit(False))
        .otherwise(_plain_account_ok(s))
    )


def is_valid_routing(c) -> Column:
    """Nine digits, not one repeated digit, ABA 3-7-1 checksum."""
    s = _col(c)

    def d(i):
        return F.substring(s, i, 1).cast("int")

    total = 3 * (d(1) + d(4) + d(7)) + 7 * (d(2) + d(5) + d(8)) + (d(3) + d(6) + d(9))
    return F.when(
        F.coalesce(s, F.lit("")).rlike(r"^\d{9}$"), ~_one_char_only(s) & (total % 10 == 0)
    ).otherwise(F.lit(False))


def is_yymmdd(c) -> Column:
    """A day of 2000 to 2099, by one pattern: a failed parse of a date costs an exception."""
    return F.coalesce(_col(c), F.lit("")).rlike(K.YYMMDD)


def is_valid_bank_name(c, low=None, plain=None) -> Column:
    """Usable bank name. With ``low``, its lower case, ``c`` is taken as trimmed and both as columns that are ready:
    nothing is bound then, so the test is compiled. ``plain`` tells of which names it is known that they are words of
    the letters A-Z in title case with a blank between them."""

    def proper_name(s):
        words, capital = F.regexp_count(s, F.lit(r"[^\s\xa0]+")), F.regexp_count(s, F.lit(r"(?<![^\s\xa0])\p{Lu}"))
        # One pass settles the usual case: one word of four letters or more, or only words with a capital.
        known = F if plain is None else F.when(_col(plain), F.contains(s, F.lit(" ")) | (F.length(s) >= 4))
        return known.when(s.rlike(r"^\p{Lu}(?:[^\s\xa0]{3,}+|[^\s\xa0]*+(?:[\s\xa0]++\p{Lu}[^\s\xa0]*+)++)$"), F.lit(True)).otherwise(
            (words >= 2) & (capital >= words * 0.7)
        )

    def lettered(s):
        return s.rlike(r"\p{L}") if plain is None else _col(plain) | s.rlike(r"\p{L}")

    def check(s):
        return let(F.lower(s), lambda low: checked(s, low))

    def checked(s, low):
        return (
            F.when(F.coalesce(F.length(s), F.lit(0)) < 2, F.lit(False))
            .when((F.length(s) > K.BANK_NAME_CHARS) | ~lettered(s), F.lit(False))
            .when(any_contains(low, K.BANK_NAME_KEYWORDS), ~any_contains(low, K.BANK_NAME_BAD_WORDS))
            .otherwise(proper_name(s))
        )

    return let(strip(c), check) if low is None else checked(_col(c), _col(low))


def incoming_path(subject, url) -> Column:
    """Path below the container taken from an event, null when the event is not for us."""
    parts = F.split(_col(subject), "/")
    below = F.array_join(F.slice(parts, F.lit(7), F.size(parts)), "/")
    url_parts = F.split(_col(url), "/")
    from_subject = F.when(
        (F.size(parts) >= 7) & F.contains(_col(subject), F.lit(K.INCOMING_FOLDER)), below
    )
    from_url = F.array_join(F.slice(url_parts, F.lit(5), F.size(url_parts)), "/")
    path = F.when(F.coalesce(_col(subject), F.lit("")) != "", from_subject).otherwise(from_url)
    return F.when(F.startswith(path, F.lit(K.INCOMING_FOLDER + "/")), path)


def is_incoming_path(subject, url) -> Column:
    return incoming_path(subject, url).isNotNull()


def is_phone_like(c) -> Column:
    return F.coalesce(_col(c), F.lit("")).rlike("^(?:" + "|".join(K.PHONE_PREFIXES) + ")")


def number_class(c) -> Column:
    s = _col(c)
    n = F.length(s)
    return (
        F.when((n == 10) & F.startswith(s, F.lit("8")), "phone")
        .when(n < 6, "too_short")
        .when(n > 15, "masked_or_long")
        .when(n <= 12, "possible_account")
        .otherwise("unknown")
    )


def _rules(low: Column, rules) -> Column:
    out = F
    for code, groups in rules:
        cond = reduce(lambda a, b: a & b, [any_contains(low, g) for g in groups])
        out = out.when(cond, code)
    return out.otherwise(K.ERROR_UNKNOWN)


def error_code_from_message(c) -> Column:
    return _rules(F.lower(F.coalesce(_col(c), F.lit(""))), K.ERROR_RULES)


def error_code_from_message_v0(c) -> Column:
    return _rules(F.lower(F.coalesce(_col(c), F.lit(""))), K.ERROR_RULES_V0)


def error_code_from_exception(message, exc_type) -> Column:
    """Handler rule: own order, also looks at the exception type."""
    low = F.lower(F.coalesce(_col(message), F.lit("")))
    typ = F.coalesce(_col(exc_type), F.lit(""))
    out = F
    for code, words, types in K.EXCEPTION_RULES:
        cond = typ.isin(types) if types else F.lit(False)
        if words:
            cond = any_contains(low, words) | cond
        out = out.when(cond, code)
    return out.otherwise(K.ERROR_UNKNOWN)


def is_retryable(c, fallback: bool = False) -> Column:
    words = K.RETRYABLE_WORDS_FALLBACK if fallback else K.RETRYABLE_WORDS
    return any_contains(F.lower(F.coalesce(_col(c), F.lit(""))), words)


def volume_class(n) -> Column:
    out = F
    for least, name in K.VOLUME_CLASSES:
        out = out.when(_col(n) >= least, name)
    return out.otherwise("low")


def content_class(content, sniff_bytes: int | None = K.SNIFF_BYTES, kind_bytes: int | None = K.KIND_BYTES) -> Column:
    """Kind of a downloaded file (binary column). JSON is judged by both ends of the whole value, the
    delimiter of CSV by its first ``sniff_bytes`` bytes, text or binary by its first ``kind_bytes`` (None: by all)."""
    b = _col(content)
    first = lambda n: b if n is None else F.substring(b, 1, n)
    head = first(kind_bytes)
    text = F.decode(first(sniff_bytes), "ISO-8859-1")
    whole = strip(F.decode(b, "ISO-8859-1"))
    hex8 = F.hex(F.substring(b, 1, 8))
    per_line = lambda ch: (
        F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))
    ) / (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))))
    has_line = F.contains(text, F.lit("\n"))
    ascii_head = ~F.decode(head, "ISO-8859-1").rlike(r"[^\x00-\x7f]")
    return (
        F.when(F.startswith(text, F.lit("<!DOCTYPE")) | F.startswith(text, F.lit("<html")), "html")
        .when(
            F.startswith(hex8, F.lit("504B0304"))
            & F.contains(F.decode(head, "ISO-8859-1"), F.lit("xl/")),
            "xlsx",
        )
        .when(hex8 == "D0CF11E0A1B11AE1", "xls")
        .when(
            (F.startswith(whole, F.lit("{")) & F.endswith(whole, F.lit("}")))
            | (F.startswith(whole, F.lit("[")) & F.endswith(whole, F.lit("]"))),
            "json",
        )
        .when(ascii_head & has_line & (per_line(",") > 1), "csv_comma")
        .when(ascii_head & has_line & (per_line(";") > 1), "csv_semicolon")
        .when(ascii_head & has_line & (per_line("\t") > 1), "csv_tab")
        .when(ascii_head, "text")
        .otherwise("unknown")
    )


def account_fields(raw_fields) -> Column:
    """Only the map entries whose name says they hold an account number."""
    return F.map_filter(_col(raw_fields), lambda k, v: one_of(F.lower(k), K.ACCOUNT_FIELD_NAMES))
