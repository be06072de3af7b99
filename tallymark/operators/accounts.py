"""Account, routing number and token extraction from whole statement texts.

Every extractor is one Column expression over the text (or a map of model fields), so a
cascade is a ``coalesce`` inside one projection: no exchange, and later stages run only for
texts the earlier ones left empty. ``low`` is an optional ready-made lower-case text column,
so that one lower() serves all patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import fixed as K
from tallymark.functions.predicates import (
    account_fields,
    first_over,
    is_phone_like,
    is_valid_account,
    is_valid_account_strict,
    is_valid_routing,
    let,
    strip,
)
from tallymark.operators.lines import counted


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _all(text: Column, pattern: str, flags: str = "i", group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?{flags}){pattern}" if flags else pattern), F.lit(group))


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


# A pattern that spells one of these words can only match a text that contains it; the plain
# substring test is far cheaper than the regex and spares most texts most patterns.
GUARD_WORDS = [
    "account", "acct", "a/c", "ending", "ends", "last", "final", "digit",
    "routing", "aba", "transit",
]


def _guarded(text: Column, pattern: str, value: Column) -> Column:
    for word in GUARD_WORDS:
        if word in pattern:
            return F.when(F.contains(text, F.lit(word)), value)
    return value


def _first_valid(text: Column, patterns, valid, shape=lambda m: m, flags: str = "i") -> Column:
    """First usable match, patterns in order, matches of one pattern in text order."""
    return F.coalesce(
        *[
            _guarded(text, p, _first(F.filter(F.transform(_all(text, p, flags), shape), valid)))
            for p in patterns
        ]
    )


def _compact(m: Column) -> Column:
    return F.replace(F.replace(F.upper(m), F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))


def _n_digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


def _not_repeated(m: Column) -> Column:
    return F.replace(m, F.substring(m, 1, 1), F.lit("")) != ""


# --- labelled account ---------------------------------------------------------------


def _account_near_label(text: Column) -> Column:
    """Number on a labelled line or on one of the three lines after it; first label wins."""

    def six_plus(s, pattern):
        return let(F.regexp_extract(s, pattern, 1), lambda m: F.when((m != "") & _not_repeated(m), m))

    def rest_of(line):
        out = F
        for p in K.ACCOUNT_LABEL_PATTERNS:
            out = out.when(line.rlike(p), strip(F.regexp_replace(line, p, "")))
        return out

    def search(lines):
        def at_label(line, i):
            follow = [
                six_plus(strip(F.try_element_at(lines, i + F.lit(2 + k))), r"^(\d{6,})(?:\s|$)") for k in range(3)
            ]
            return let(
                rest_of(F.lower(line)),
                lambda rest: F.when(rest.isNotNull(), F.coalesce(six_plus(rest, r"(\d{6,})"), *follow)),
            )

        return first_over(lines, at_label)

    has_label = F.lower(text).rlike("|".join(K.ACCOUNT_LABEL_PATTERNS))
    return F.when(has_label, let(F.split(text, "\n"), search))


def labeled_account(text, low=None) -> Column:
    t = _col(text)
    low = F.lower(t) if low is None else _col(low)
    masked = _first_valid(
        low,
        K.LABELED_MASKED_PATTERNS,
        lambda m: (F.length(m) >= 4) & (_n_digits(m) >= 3) & m.rlike("[*X]"),
        _compact,
    )
    numeric = _first_valid(
        low,
        K.LABELED_NUMERIC_PATTERNS,
        lambda m: F.when(F.contains(m, F.lit("-")), _n_digits(m) >= 4).otherwise(
            (F.length(m) >= 6) & _not_repeated(m)
        ),
    )
    partial = F.coalesce(
        *[
            _guarded(low, p, F.nullif(F.regexp_extract(low, f"(?i){p}", 1), F.lit("")))
            for p in K.LABELED_PARTIAL_PATTERNS
        ]
    )
    return F.coalesce(masked, numeric, _account_near_label(t), F.concat(F.lit("XXXXXX"), partial))


# --- account from the shape of lines ---------------------------------------------------


def _leading_number(line: Column, least: int) -> Column:
    hyphen = F.regexp_extract(line, K.LINE_HYPHEN_NUMBER, 1)
    plain = F.regexp_extract(line, rf"^[^0-9]*([0-9]{{{least},}})", 1)
    return F.when(hyphen != "", hyphen).when(plain != "", plain)


def _stars(digits: Column) -> Column:
    return F.when(digits != "", F.concat(F.lit("***"), digits))


def _below_number(line: Column) -> Column:
    hyphen = F.regexp_extract(line, K.LINE_HYPHEN_NUMBER, 1)
    run = F.regexp_extract(line, r"^[^0-9]*([0-9]+)", 1)
    return F.when(hyphen != "", hyphen).when(F.length(run) >= 4, run)


def account_from_lines(text, header_lines: int | None = K.HEADER_LINES) -> Column:
    """Header first (`ACCOUNT` alone, number below), then masks, endings and labels line by line.

    A lone label counts within the first ``header_lines`` lines (None: in all of them); the other forms are looked
    for in every line."""
    t = _col(text)
    lone, masked_run = K.LINE_LONE_LABEL, K.LINE_MASKED_RUN

    def from_tail(tail):
        digits = F.regexp_replace(tail, r"[^\d]", "")
        return (
            F.when(tail.rlike(r"[xX*]"), F.nullif(F.regexp_extract(tail, K.LINE_MASKED_TAIL, 1), F.lit("")))
            .when(tail.rlike(K.LINE_HYPHEN_ONLY), tail)
            .when(F.length(digits) >= 4, digits)
        )

    def in_header(head):
        def under_lone_label(line, i):
            below = F.try_element_at(head, i + F.lit(2))
            return F.when(line.rlike(lone) & (below != ""), _leading_number(below, 4))

        return first_over(head, under_lone_label)

    def anywhere(lines):
        def on_line(line, i):
            below = F.try_element_at(lines, i + F.lit(2))
            tail = F.regexp_extract(line, K.LINE_LABEL_TAIL, 1)
            next_line = F.when(
                below != "", F.coalesce(_stars(F.regexp_extract(below, masked_run, 1)), _below_number(below))
            )
            return F.coalesce(
                _stars(F.regexp_extract(line, masked_run, 1)),
                _stars(F.regexp_extract(line, K.LINE_ENDING, 1)),
                F.when(
                    line.rlike(K.LINE_LABEL) & ~line.rlike(lone),
                    F.coalesce(let(tail, from_tail), next_line),
                ),
            )

        return first_over(lines, on_line)

    def search(lines):
        head = lines if header_lines is None else F.slice(lines, 1, header_lines)
        return F.coalesce(let(head, in_header), anywhere(lines))

    any_hint = F.lower(t).rlike(K.LINE_HINT)
    return F.when(any_hint, let(F.transform(F.split(t, "\n"), strip), search))


def account_after_label(text) -> Column:
    """Earlier form: first number after the word, else at the start of the next line."""
    t = _col(text)
    word = r"(?i)(?U:\b)account(?U:\b)"

    def search(lines):
        def on_line(line, i):
            after = F.regexp_extract(line, rf"{word}(.*)$", 1)
            here = F.nullif(F.regexp_extract(after, r"^[^0-9]*(\d+)", 1), F.lit(""))
            below = F.regexp_extract(F.coalesce(F.try_element_at(lines, i + F.lit(2)), F.lit("")), r"^(\d+)", 1)
            number = F.coalesce(here, below)
            return F.when(line.rlike(word), let(number, lambda n: F.when(F.length(n).between(4, 20), n)))

        return first_over(lines, on_line)

    return F.when(F.lower(t).contains("account"), let(F.transform(F.split(t, "\n"), strip), search))


# --- whole-text regex cascades -----------------------------------------------------------


def regex_account(text, low=None) -> Column:
    low = F.lower(_col(text)) if low is None else _col(low)
    masked = _first_valid(
        low,
        K.REGEX_MASKED_PATTERNS,
        lambda m: m.rlike("[*X#]") & (F.length(m) >= 4) & (_n_digits(m) >= 3),
        _compact,
    )
    last = _first_valid(low, K.REGEX_LAST_DIGITS_PATTERNS, lambda m: ~is_phone_like(m))
    numeric = _first_valid(low, K.REGEX_NUMERIC_PATTERNS, is_valid_account)

    # A masked or four-digit text token answers at once; a plain one waits for later
    # patterns and gives way to any numeric account.
    def now(m):
        return (
            F.when(m.rlike("[*X#]") & (F.length(m) >= 4), F.when(_n_digits(m) >= 3, m))
            .when(is_valid_account(m), F.lit(None).cast("string"))
            .when(m.rlike(r"^\d{4}$"), F.concat(F.lit("XXXXXX"), m))
        )

    def plain_ok(m):
        return ~(m.rlike("[*X#]") & (F.length(m) >= 4)) & is_valid_account(m)

    at_once = F.coalesce(
        *[
            _guarded(
                low,
                p,
                _first(
                    F.filter(F.transform(F.transform(_all(low, p), _compact), now), lambda x: x.isNotNull())
                ),
            )
            for p in K.REGEX_TEXT_PATTERNS
        ]
    )
    plain = _first_valid(low, K.REGEX_TEXT_PATTERNS, plain_ok, _compact)
    return F.coalesce(
        masked, F.concat(F.lit("XXXXXX"), last), at_once, numeric, plain
    )


def regex_account_v0(text, low=None) -> Column:
    """Previous cascade: numeric labels, then text labels, four digits become `*dddd`."""
    low = F.lower(_col(text)) if low is None else _col(low)
    numeric = _first_valid(low, K.REGEX_NUMERIC_PATTERNS, is_valid_account_strict)

    def shaped(m):
        return (
            F.when(is_valid_account_strict(m), m)
            .when(F.contains(m, F.lit("*")) & (F.length(m) >= 4), m)
            .when(m.rlike(r"^\d{4}$"), F.concat(F.lit("*"), m))
        )

    text_hit = F.coalesce(
        *[
            _guarded(
                low, p, _first(F.filter(F.transform(_all(low, p), shaped), lambda x: x.isNotNull()))
            )
            for p in K.REGEX_TEXT_PATTERNS_V0
        ]
    )
    return F.coalesce(numeric, text_hit)


# --- model fields and the full cascade ---------------------------------------------------


def account_from_field(value) -> Column:
    raw = _col(value)
    bare = F.replace(F.replace(raw, F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None).cast("string"))
        .when(raw.rlike("[*xX]"), F.when(F.length(bare) >= 4, bare))
        .when(F.contains(raw, F.lit("-")), F.when(is_valid_account(raw), raw))
        .when(bare.rlike(r"^\d{6,}$") & is_valid_account(bare), bare)
    )


def account_from_raw_fields(raw_fields) -> Column:
    """First usable account-named field of the model output."""

    def usable(v):
        s = v["content"]
        bare = F.replace(F.replace(s, F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))
        return F.when(
            F.length(s) > 4,
            F.when(F.contains(s, F.lit("-")) & is_valid_account(s), s)
            .when(bare.rlike("[*X]") & (F.length(bare) >= 4), bare)
            .when(bare.rlike(r"^\d{4,}$") & is_valid_account(bare), bare),
        )

    hits = F.filter(F.transform(F.map_values(account_fields(raw_fields)), usable), lambda x: x.isNotNull())
    return _first(hits)


def account_cascade(text, model_account=None, raw_fields=None, low=None) -> Column:
    """Labelled, then line shapes, then the model's own field, then its other account fields."""
    steps = [labeled_account(text, low), account_from_lines(text)]
    if model_account is not None:
        steps.append(account_from_field(model_account))
    if raw_fields is not None:
        steps.append(account_from_raw_fields(raw_fields))
    return F.coalesce(*steps)


# --- reports -------------------------------------------------------------------------------


def _tagged(hits: Column, value: str, **tags) -> Column:
    """Array of hits as an array of structs with constant tags."""
    return F.transform(
        hits, lambda m: F.struct(*[F.lit(v).alias(k) for k, v in tags.items()], m.alias(value))
    )


def account_token_array(text_col: str = "text") -> Column:
    """Every account-like token of a text with its class, duplicates kept."""
    upper = F.upper(text_col)
    found = []
    for cls, pattern in K.FREQUENCY_PATTERNS:
        ok = is_valid_account if cls == "numeric" else (lambda m: _n_digits(m) >= 3)
        hits = F.filter(_all(upper, pattern, "U"), ok)
        found.append(_tagged(hits, "token", **{"class": cls}))
    return F.concat(*found)


def account_tokens(docs: DataFrame, text_col: str = "text", key_cols=("doc_id",)) -> DataFrame:
    """Every account-like token as a row."""
    return docs.select(*key_cols, F.inline(account_token_array(text_col)))


def account_frequency(docs: DataFrame, text_col: str = "text", key_cols=("doc_id",)) -> DataFrame:
    """How often each token occurs in its document, counted in the row."""
    return docs.select(*key_cols, F.inline(counted(account_token_array(text_col), "_t"))).select(*key_cols, "_t.*", "n")


def number_candidates(text) -> Column:
    """All digit runs of six and more that stand alone."""
    return F.filter(_all(_col(text), K.CANDIDATE_NUMBER, "U"), lambda m: F.length(m) >= 6)


def _with(tags: list[Column], name: str):
    return lambda m: F.struct(*tags, m.alias(name))


def _line_hits(line: Column, place: Column) -> Column:
    """All hits of one lower-cased line."""
    labelled = line.rlike(K.SCAN_LINE_LABEL)
    found = []
    for kind, patterns in (("labelled", K.SCAN_PATTERNS), ("partial", K.SCAN_PARTIAL_PATTERNS)):
        for i, p in enumerate(patterns):
            hits = _all(strip(line), p, "")
            if kind == "labelled":
                hits = F.when(labelled, F.filter(hits, lambda m: F.length(m) >= 4)).otherwise(
                    F.array().cast("array<string>")
                )
            tags = [F.lit(kind).alias("kind"), F.lit(i + 1).alias("pattern_no"), place.alias("line_no")]
            found.append(F.transform(hits, _with(tags, "number")))
    return F.concat(*found)


def account_scan_array(text_col: str = "text") -> Column:
    """Hits (kind, pattern_no, line_no, number) on labelled lines and partial forms."""
    marked = F.transform(F.split(F.lower(text_col), "\n"), lambda x, i: F.struct(i.alias("p"), x.alias("l")))
    near = F.filter(marked, lambda e: e["l"].rlike(K.SCAN_LINE_HINT))
    return F.flatten(F.transform(near, lambda e: _line_hits(e["l"], e["p"] + 1)))


def account_scan(docs: DataFrame, text_col: str = "text", key_cols=("doc_id",)) -> DataFrame:
    """Line report: number, pattern and line number."""
    return docs.select(*key_cols, F.inline(account_scan_array(text_col))).select(
        *key_cols, "line_no", "kind", "pattern_no", "number"
    )


def first_scanned(docs: DataFrame, text_col: str = "text", key_cols=("doc_id",)) -> DataFrame:
    """The number of the first hit by kind, pattern, line and value, chosen in the row."""
    first = F.array_min(account_scan_array(text_col))
    found = F.filter(F.array(first), lambda b: b.isNotNull())
    return docs.select(*key_cols, F.inline(found)).select(*key_cols, "number")


def routing_from_text(text, low=None) -> Column:
    """First nine-digit number, by label pattern, that passes the routing checksum."""
    low = F.lower(_col(text)) if low is None else _col(low)
    return _first_valid(low, K.ROUTING_PATTERNS, is_valid_routing, flags="iU")
