"""Bank names and statement dates from statement texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import fixed as K
from tallymark.functions.predicates import any_contains, is_valid_bank_name, let, one_of, strip
from tallymark.functions.scalars import filename_date, loose_date, slash_date, yymmdd

LINE_STOPS = K.BANK_STOP_WORDS + K.BANK_LINE_STOP_WORDS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s\xa0]+"), lambda w: w != "")


def _bare(words: Column) -> Column:
    return F.filter(
        F.transform(words, lambda w: F.btrim(w, F.lit(K.BANK_TOKEN_STRIP))), lambda w: w != ""
    )


def _strong(w: Column) -> Column:
    return one_of(F.coalesce(F.lower(w), F.lit("")), K.BANK_STRONG_ENDINGS)


def _stop(w: Column) -> Column:
    return one_of(F.coalesce(F.lower(w), F.lit("")), LINE_STOPS)


def _capital(w: Column) -> Column:
    return F.coalesce(w, F.lit("")).rlike(r"^\p{Lu}")


def _extension(word: Column, n1: Column, n2: Column, n3: Column) -> Column:
    """How many of the next words belong to a name that just reached ``word``; -1 ends the name.

    Order of the cases is part of the rule: adjective endings run on, then places, compound
    endings, "and ..." endings, and last the endings that close a name.
    """
    low, l1, l2 = F.lower(word), F.lower(n1), F.lower(n2)
    adjective = low.isin("national", "federal") & _strong(n1)
    place = (
        n2.isNotNull()
        & one_of(l1, K.BANK_CONNECTORS)
        & _capital(n2)
        & (F.length(n2) >= 3)
        & ~_stop(n2)
    )
    long_place = (l1 == "of") & (l2 == "the") & _capital(n3) & ~_stop(n3)
    joined = (l2 == "and") & _strong(n3)
    and_ending = (l1 == "and") & _strong(n2)
    return (
        F.when(~_strong(word) | adjective, 0)
        .when(place, F.when(long_place, 3).otherwise(2))
        .when(_strong(n1), F.when(low.isin("credit", "savings"), F.when(joined, 3).otherwise(1)).otherwise(0))
        .when(and_ending, F.when(_strong(n3), 3).otherwise(2))
        .when(one_of(low, K.BANK_FINAL_ENDINGS), -1)
        .otherwise(F.lit(-2))
    )


def _name_from_tokens(tokens: Column, most: int) -> Column:
    """Fold over the first words of a line; a name has at most ``most``.

    A name is a run of words from the start, so the state is only (words taken, done). Without an ending among
    them nothing but a stop word or the length closes the run, and no fold is needed.
    """
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc, i):
        w, n1, n2, n3 = [F.try_element_at(tokens, i + F.lit(k)) for k in range(4)]

        def extended(ext):
            extra = F.greatest(ext, F.lit(0))
            # -2: an ending that closes the name only once six words are in it
            ends = (ext == -1) | ((ext == -2) & (i >= 6))
            after_place = (extra > 0) & (F.lower(n1) == "of")
            return F.struct((i + extra).alias("n"), (ends | after_place).alias("done"))

        return (
            F.when(acc["done"] | (i <= acc["n"]), acc)
            .when((acc["n"] >= most) | _stop(w), F.struct(acc["n"].alias("n"), F.lit(True).alias("done")))
            .otherwise(let(_extension(w, n1, n2, n3), extended))
        )

    folded = F.aggregate(F.sequence(F.lit(1), F.size(tokens)), start, step, lambda acc: acc["n"])
    first = F.slice(tokens, 1, most)
    stop_at = F.array_position(F.transform(first, _stop), True).cast("int")
    plain = F.when(stop_at > 0, stop_at - 1).otherwise(F.size(first))
    taken = F.when(F.size(tokens) > 0, F.when(F.exists(first, _strong), folded).otherwise(plain))

    def named(n, name):
        ok = n.between(1, most) & F.length(name).between(3, 100) & name.rlike(r"\p{L}") & ~_stop(name)
        return F.when(ok, name)

    return let(taken, lambda n: let(F.array_join(F.slice(tokens, 1, n), " "), lambda name: named(n, name)))


def bank_name_from_line(line, window: int | None = K.BANK_LINE_WINDOW, most: int = K.BANK_NAME_WORDS) -> Column:
    """Bank name of at most ``most`` words at the start of one line.

    Its first ``window`` words are read (None: all). A name starts at the first word and a step looks at most three
    words ahead, so a window of ``most`` + 4 and more loses nothing."""
    def kept(words):
        return F.filter(_bare(words), lambda w: ~w.rlike(r"^\p{Nd}+$") & ~one_of(w, K.BANK_SYMBOL_TOKENS))

    def named(tokens):
        return let(tokens, lambda t: _name_from_tokens(t, most))

    line = _col(line)
    if window is None:
        return named(kept(_words(line)))
    # The window mostly lies within so many words; the last piece holds the rest of a longer line.
    cut = 2 * window + 1
    whole = F.slice(kept(_words(line)), 1, window)

    def opening(pieces):
        return let(
            F.slice(kept(F.filter(F.slice(pieces, 1, cut - 1), lambda w: w != "")), 1, window),
            lambda head: F.when((F.size(head) == window) | (F.size(pieces) < cut), head).otherwise(whole),
        )

    return named(let(F.split(line, r"[\s\xa0]+", cut), opening))


def bank_name_from_words(text, words: int = K.BANK_OPENING_WORDS, run: int = K.BANK_OPENING_RUN) -> Column:
    """Fallback over the first ``words`` words of a text: a run of at most ``run`` of them, up to a stop word or
    through the first ending. A leading number doesn't count."""

    def first_at(words, names):
        return F.array_position(F.transform(words, lambda w: one_of(F.lower(w), names)), True)

    def named(run):
        stop_at, end_at = first_at(run, K.BANK_STOP_WORDS), first_at(run, K.BANK_STRONG_ENDINGS)
        limit = F.least(
            F.when(stop_at > 0, stop_at - 1), F.when(end_at > 0, end_at), F.size(run).cast("bigint")
        ).cast("int")
        return let(
            F.array_join(F.slice(run, 1, limit), " "),
            lambda name: F.when(
                F.length(name).between(2, 80) & name.rlike(r"\p{L}") & ~one_of(F.lower(name), K.BANK_STOP_WORDS), name
            ),
        )

    def from_words(opening):
        numbered = F.coalesce(
            F.btrim(F.try_element_at(opening, F.lit(1)), F.lit(K.BANK_TOKEN_STRIP)).rlike(r"^\p{Nd}+$"), F.lit(False)
        ) & (F.size(opening) > 1)
        return let(F.slice(_bare(opening), F.when(numbered, 2).otherwise(1), run), named)

    # The first words end within as many of the text's first runs of non-blanks.
    opening = F.regexp_extract(_col(text), rf"(?s)^[\s\xa0]*((?:[^\s\xa0]+[\s\xa0]*){{0,{words}}})", 1)
    return let(F.slice(_words(opening), 1, words), from_words)


def bank_name(text, lines: int = K.BANK_HEAD_LINES) -> Column:
    """First of the first ``lines`` lines that yields a name, else the opening words."""
    t = _col(text)
    head = F.filter(
        F.transform(F.split(F.substring_index(t, "\n", lines), "\n"), strip),
        lambda x: (F.length(x) >= 3) & ~any_contains(F.lower(x), K.BANK_HEADER_SKIP_WORDS),
    )
    # The fold leaves the lines behind the first name alone.
    first = F.aggregate(
        head, F.lit(None).cast("string"), lambda acc, line: F.coalesce(acc, bank_name_from_line(line))
    )
    return F.coalesce(first, bank_name_from_words(t))


# --- pattern form ---------------------------------------------------------------------


def clean_bank_name(c) -> Column:
    return let(_squeezed(_col(c)), lambda s: let(_title(s), _spelled))


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(strip(F.regexp_replace(c, r"[\s\xa0]+", " ")), r"[.,;:!?]+$", "")


def _spelled(t: Column) -> Column:
    """Spelling of a squeezed name in title case. Only "And" gets shorter, to a third."""
    s = F.regexp_replace(t, r"\bAnd\b", "&")
    s = F.regexp_replace(s, r"\bFcu\b", "FCU")
    s = F.regexp_replace(s, r"\bUsa\b", "USA")
    return F.when(any_contains(t, ["And", "Fcu", "Usa"]), s).otherwise(t)


def _ascii_title(s: Column) -> Column:
    """:func:`_title` of a text without letters beyond A-Z, which the patterns give, without a lambda: a mark and a
    blank open a word behind each other character for as long as the built-in takes."""
    marked = F.regexp_replace(s, r"(?<=[^\sA-Za-z])(?=[A-Za-z])", "\x01 ")
    by_part = F.replace(F.initcap(marked), F.lit("\x01 "), F.lit(""))
    return F.when(s.rlike(r"[^\sA-Za-z][A-Za-z]"), by_part).otherwise(F.initcap(s))


def _text_title(text: Column) -> Column:
    """A text whose matches by the patterns, which are blind to case, are those of ``text`` in title case: capital after
    all but A-Z, small letters elsewhere. Other letters, of which no match holds any, give way to a mark."""
    plain = F.regexp_replace(text, r"[^\x00\x02-\x7f]+", "\x02")
    marked = F.regexp_replace(plain, r"(?<=[^A-Za-z ])(?=[A-Za-z])", "\x01 ")
    return F.replace(F.initcap(marked), F.lit("\x01 "), F.lit(""))


# A squeezed name in title case of words of letters: all but a few.
_PLAIN_NAME = r"^[A-Z][a-z]*+(?: [A-Z][a-z]*+)*+$"
# Longer squeezed names can't be spelled in as few characters as a valid name has.
_LONGEST = 3 * K.BANK_NAME_CHARS + 10


def _title(s: Column) -> Column:
    """Capital after every non-letter, small letters elsewhere."""
    parts = F.regexp_extract_all(s, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    by_part = F.array_join(
        F.transform(
            parts,
            lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p)))),
        ),
        "",
    )
    # Where letters follow only blanks and letters, the built-in does the same.
    return F.when(s.rlike(r"[^\s\p{L}]\p{L}"), by_part).otherwise(F.initcap(s))


_NAME_CHARS = r"[A-Za-z0-9\s&\.,\-']+"
# Patterns that take any run of name characters around a keyword (by position). In a run such a
# pattern matches at most once, from its first letter, so it is tried once per run and anchored:
# searched freely it would rescan the run from every letter.
_RUN_PATTERNS = {0, 3, 4}


# Words of which a match of a pattern (by position) holds one, in small letters: texts and runs without them are
# not searched.
_NEEDED = {
    0: ["bank", "trust", "credit union", "fcu", "savings", "financial", "association", "corp", "company", "inc"],
    1: ["bank"],
    2: ["bank"],
    3: [
        "national", "state", "federal", "community", "regional", "local", "first", "second", "third", "citizens",
        "farmers", "merchants", "commercial", "industrial",
    ],
    4: ["n.a.", "na", "llc", "ltd", "limited"],
}


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_NAME_CHARS), F.lit(0))


def _pattern_matches(text: Column, i: int, runs: Column | None = None) -> Column:
    """Matches of one pattern; ``runs``: the text's runs of name characters, if they are at hand."""
    pattern = K.BANK_NAME_PATTERNS[i]
    if i not in _RUN_PATTERNS:
        hits = F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(1))
        if i not in _NEEDED:
            return hits
        return F.when(any_contains(F.lower(text), _NEEDED[i]), hits).otherwise(F.array().cast("array<string>"))
    runs = _runs(text) if runs is None else runs
    hits = F.transform(
        F.filter(runs, lambda r: let(F.lower(r), lambda low: any_contains(low, _NEEDED[i]))),
        lambda r: F.regexp_extract(r, "(?i)^[^A-Za-z]*+" + pattern, 1),
    )
    return F.filter(hits, lambda x: x != "")


def _found(text: Column) -> Column:
    return let(
        _runs(text), lambda runs: F.flatten(F.array(*[_pattern_matches(text, i, runs) for i in range(len(K.BANK_NAME_PATTERNS))]))
    )


def _header_found(text: Column) -> Column:
    header = F.filter(F.split(F.substring_index(text, "\n", 10), "\n"), lambda x: strip(x) != "")
    return F.flatten(F.transform(header, _found))


def _best(found: Column, later: bool) -> Column:
    """The longest valid name, the earliest among equals, as a struct (later, neg_len, pos, name).

    Cleaning never makes a name longer, so the matches are taken by falling length and left alone once they are
    shorter than the best name."""
    none = F.lit(None).cast("struct<later:boolean,neg_len:int,pos:int,name:string>")
    by_length = F.array_sort(F.transform(found, lambda n, i: F.struct((-F.length(n)).alias("l"), i.alias("pos"), n.alias("n"))))

    def named(x):
        def valid(name):
            best = F.struct(F.lit(later).alias("later"), (-F.length(name)).alias("neg_len"), x["pos"].alias("pos"), name.alias("name"))
            return F.when(is_valid_bank_name(name), best)

        return let(
            _squeezed(x["n"]),
            lambda s: F.when(F.length(s) <= _LONGEST, let(_ascii_title(s), lambda t: let(_spelled(t), valid))),
        )

    def step(best, x):
        return F.when(best.isNotNull() & (best["neg_len"] < x["l"]), best).otherwise(F.least(best, named(x)))

    return F.aggregate(by_length, none, step)


def bank_name_candidates(docs: DataFrame, text_col: str = "text", key_cols=("doc_id",)) -> DataFrame:
    """Valid names found by the generic patterns, in the header lines and in the whole text.

    Texts are put in title case before they are searched, once instead of once per match. The matches of a text are
    rows before they are cleaned and tested: plain columns are compiled, the bodies of lambdas are interpreted. Each
    step is a generator's output, so the next one doesn't repeat it. One look at a match tells if it is plain words in
    title case, which most are: nothing is left to clean then, and each of its words has a capital."""

    def numbered(found, is_header):
        return F.transform(found, lambda n, i: F.struct(F.lit(is_header).alias("is_header"), i.alias("pos"), n.alias("_n")))

    def step(rows, keep=(), **values):
        made = F.inline(F.array(F.struct(*[v.alias(name) for name, v in values.items()])))
        return rows.select(*key_cols, "is_header", "pos", *keep, made)

    docs = docs.select(*key_cols, F.explode(F.array(_text_title(F.col(text_col)))).alias("_text"))
    t = F.col("_text")
    found = F.concat(numbered(_header_found(t), True), numbered(_found(t), False))
    rows = docs.select(*key_cols, F.inline(found))
    # a match may begin within a word
    first = F.concat(F.upper(F.substring("_n", 1, 1)), F.substring(F.col("_n"), F.lit(2), F.length("_n")))
    rows = step(rows, _t=F.when(F.col("_n").rlike(r"^[a-z]"), first).otherwise(F.col("_n")))
    rows = step(rows, keep=["_t"], _plain=F.col("_t").rlike(_PLAIN_NAME))
    rows = step(rows, keep=["_plain"], _s=F.when(F.col("_plain"), F.col("_t")).otherwise(_squeezed(F.col("_t"))))
    rows = step(rows.where(F.length("_s") <= _LONGEST), keep=["_plain", "_s"], name=_spelled(F.col("_s")))
    bare = F.when(F.col("_plain"), F.col("name")).otherwise(strip("name"))
    rows = step(rows, keep=["name"], _plain=F.col("_plain") & (F.col("name") == F.col("_s")), _s=bare)
    rows = step(rows, keep=["name", "_plain", "_s"], _low=F.lower("_s"))
    return rows.where(is_valid_bank_name("_s", "_low", "_plain")).select(*key_cols, "is_header", "pos", "name")


def bank_name_by_patterns(docs: DataFrame, text_col: str = "text", key_cols=("doc_id",)) -> DataFrame:
    """Header names before others, the longest first, the earliest among equals."""
    t = F.col(text_col)
    # The whole text is searched only for documents whose header gave nothing.
    best = F.coalesce(_best(_header_found(t), False), _best(_found(t), True))
    # As a generator's output: a filter on a plain column would be pushed down and search twice.
    found = F.filter(F.array(best), lambda b: b.isNotNull())
    return docs.select(*key_cols, F.inline(found)).select(
        *key_cols, F.col("name").alias("bank_name"), (~F.col("later")).alias("from_header")
    )


def distinct_ignore_case(values: Column, name: str) -> Column:
    """Array of (pos, name): the distinct values ignoring case, the first spelling kept. In the row."""
    folded = F.array_sort(
        F.transform(values, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("pos"), x.alias("x")))
    )
    return let(
        folded,
        lambda s: F.transform(
            F.filter(s, lambda e, i: (i == 0) | ~F.get(s, i - 1)["low"].eqNullSafe(e["low"])),
            lambda e: F.struct(e["pos"].alias("pos"), e["x"].alias(name)),
        ),
    )


def dedupe_ignore_case(values: Column) -> Column:
    """Distinct ignoring case, the first spelling kept, order kept."""
    low = F.transform(values, F.lower)
    return F.filter(values, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


# --- statement date ---------------------------------------------------------------------


def period_end(text) -> Column:
    """End date of a printed statement period."""
    low = F.lower(_col(text))
    steps = [slash_date(F.regexp_extract(low, p, 1)) for p in K.PERIOD_PATTERNS]
    return F.when(low.rlike(r"\d{1,2}/\d{1,2}/\d{2,4}\s+(?:through|to)\s"), F.coalesce(*steps))


def statement_date(end_field=None, text=None, period_end_field=None, closing_date=None, filename=None) -> Column:
    """yyMMdd of the statement end; the first source that gives a date wins."""
    steps = []
    if end_field is not None:
        steps.append(loose_date(end_field))
    if text is not None:
        steps.append(period_end(text))
    if period_end_field is not None:
        s = _col(period_end_field)
        steps.append(F.when(~s.rlike(r"/\d{2}$"), loose_date(s)))
    if closing_date is not None:
        s = _col(closing_date)
        steps.append(F.when(s.rlike(r"^\d{4}-|/\d{4}$"), loose_date(s)))
    if filename is not None:
        steps.append(filename_date(filename))
    return yymmdd(F.coalesce(*steps))


# --- date tokens ------------------------------------------------------------------------

DATE_TOKEN = (
    r"(\d{1,2}/\d{1,2}/\d{4}|\d{1,2}/\d{1,2}/\d{2}|\d{1,2}/\d{1,2}"
    r"|(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    r" \d{1,2}, \d{4})"
)


def date_token_array(text_col: str = "text") -> Column:
    """Each date occurrence of a text with its line and the lines around it."""
    token = r"(?<![\d/])" + DATE_TOKEN + r"(?![\d/])"

    def search(lines):
        return F.flatten(
            F.transform(
                lines,
                lambda line, i: F.transform(
                    F.regexp_extract_all(line, F.lit(token), F.lit(1)),
                    lambda tok: F.struct(
                        (i + 1).alias("line_no"),
                        tok.alias("token"),
                        line.alias("line"),
                        F.when(i > 0, F.try_element_at(lines, i)).alias("prev_line"),
                        F.try_element_at(lines, i + 2).alias("next_line"),
                    ),
                ),
            )
        )

    return let(F.split(F.col(text_col), "\n"), search)


def date_tokens(docs: DataFrame, text_col: str = "text", key_cols=("doc_id",)) -> DataFrame:
    """Each date occurrence as a row, with its normal form."""
    return (
        docs.select(*key_cols, F.explode(date_token_array(text_col)).alias("_x"))
        .select(*key_cols, "_x.*")
        .withColumn("normalized", loose_date("token"))
    )


def date_summary(docs: DataFrame, text_col: str = "text", key_cols=("doc_id",)) -> DataFrame:
    """Distinct tokens, dates and years of every document that has any, found in its row."""
    tokens = F.array_distinct(F.col("_t.token"))
    found = docs.select(*key_cols, date_token_array(text_col).alias("_t")).where(F.size("_t") > 0)
    found = found.select(*key_cols, F.sort_array(tokens).alias("raw_date_tokens"))
    dates = F.sort_array(F.array_distinct(F.array_compact(F.transform("raw_date_tokens", loose_date))))
    return found.withColumn("normalized_dates", dates).select(
        *key_cols,
        "raw_date_tokens",
        "normalized_dates",
        F.sort_array(F.array_distinct(F.transform("normalized_dates", F.year))).alias("years_detected"),
        F.array_min("normalized_dates").alias("period_start"),
        F.array_max("normalized_dates").alias("period_end"),
    )
