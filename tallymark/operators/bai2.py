"""BAI2 cash-management files: parse, repair, rebuild, audit, validate, generate.

A file is one row. Its text is cut at 02 records into groups and at 03 records into accounts, and
the result is a nested column (header, groups, accounts, entries). Repair, trailers, audit and
rendering are expressions over that column, so fixing a corpus of files is a map-only job; the
four relational views are plain explodes of it. Only building files from a ledger shuffles, once,
on the file key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import fixed as K
from tallymark.functions.predicates import is_yymmdd, let
from tallymark.functions.scalars import int_cents, line_feeds, sanitize, sanitize_reasons
from tallymark.operators.lines import counted, record_fields


def _field(fields: Column, i: int, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(fields, F.lit(i + 1)), F.lit(default))


#: Records that a parse looks at; other lines are left out.
RECORDS = ("01", "02", "03", "16", "49", "98", "99")


def _records(text: Column) -> Column:
    """Record lines of a file in order: a code alone, with a closing slash, or with fields. The text is cut at a
    plain line feed, once; what follows compares codes instead of searching the text with patterns again."""

    def is_record(line):
        tail = F.substring(line, 3, 2)
        return F.substring(line, 1, 2).isin(*RECORDS) & (F.startswith(tail, F.lit(",")) | tail.isin("", "/"))

    return F.filter(F.split(text, "\n"), is_record)


def _is(line: Column, code: str) -> Column:
    return F.startswith(line, F.lit(code))


def _places(records: Column, code: str) -> Column:
    """Places of a kind of record, from 0."""
    return F.array_compact(F.transform(records, lambda x, i: F.when(_is(x, code), i)))


def _before(records: Column, code: str) -> Column:
    """The records before the first of a kind, all of them without one."""
    return F.slice(records, F.lit(1), F.coalesce(F.get(_places(records, code), F.lit(0)), F.size(records)))


def _pieces(records: Column, places: Column) -> Column:
    """The records from each place up to the next one, the last piece up to the end."""
    return F.transform(
        places,
        lambda at, k: F.slice(records, at + 1, F.coalesce(F.get(places, k + 1), F.size(records)) - at),
    )


def _fields_of(records: Column, code: str, last: bool = False) -> Column:
    """Fields of the first (or last) record of a kind, null when absent."""
    line = F.try_element_at(F.filter(records, lambda x: _is(x, code)), F.lit(-1 if last else 1))
    return record_fields(line)


def parse(files: DataFrame, text_col: str = "text", out: str = "bai2") -> DataFrame:
    """Add the nested form of each file; null for a file without an 01 header."""

    def entry(f):
        return F.struct(
            _field(f, 1).alias("type_code"),
            _field(f, 2).alias("amount"),
            _field(f, 4).alias("ref_num"),
            _field(f, 6).alias("description_field"),
            F.array_join(F.slice(f, F.lit(7), F.size(f)), ",").alias("description_rest"),
        )

    def account_parts(a):
        """Fields of the head, of the entries before the first 49, and of that 49."""
        return F.struct(
            record_fields(F.get(a, F.lit(0))).alias("head"),
            F.transform(F.filter(_before(a, "49"), lambda x: _is(x, "16")), record_fields).alias("entries"),
            _fields_of(a, "49").alias("trailer"),
        )

    def account(a):
        head, trailer = a["head"], a["trailer"]
        return F.struct(
            _field(head, 1).alias("account_number"),
            _field(head, 2).alias("currency"),
            _field(head, 3).alias("type_code"),
            _field(head, 6).alias("continuation"),
            F.transform(a["entries"], entry).alias("entries"),
            F.when(trailer.isNotNull() & (F.size(trailer) > 1), _field(trailer, 1)).alias("trailer_balance"),
            F.when(trailer.isNotNull() & (F.size(trailer) > 2), _field(trailer, 2)).alias("trailer_count"),
        )

    def group_parts(g):
        """Fields of the head, the accounts, and the fields of the 98. 98 closes the group, yet its last account
        stays open for entries behind it."""
        return F.struct(
            record_fields(F.get(g, F.lit(0))).alias("head"),
            F.transform(let(_places(_before(g, "98"), "03"), lambda at: _pieces(g, at)), account_parts).alias("accounts"),
            _fields_of(g, "98").alias("trailer"),
        )

    def group(g):
        head = g["head"]
        return F.struct(
            _field(head, 1).alias("receiver_id"),
            _field(head, 2).alias("originator_id"),
            _field(head, 3).alias("sequence"),
            _field(head, 4).alias("group_date"),
            _field(head, 6).alias("currency"),
            F.coalesce(F.try_element_at(head, F.lit(8)), F.lit("")).alias("record_length"),
            F.transform(g["accounts"], account).alias("accounts"),
            g["trailer"].alias("trailer"),
        )

    header = F.col("_h")
    nested = F.struct(
        F.struct(
            _field(header, 1).alias("originator_id"),
            _field(header, 2).alias("receiver_id"),
            _field(header, 3).alias("file_date"),
            _field(header, 4).alias("file_time"),
            _field(header, 5).alias("file_sequence"),
            _field(header, 8).alias("record_length"),
        ).alias("header"),
        F.transform(F.transform("_p", group_parts), group).alias("groups"),
        _fields_of(F.col("_r"), "99", last=True).alias("trailer"),
    )
    staged = files.withColumn("_r", _records(line_feeds(text_col)))
    staged = staged.withColumns({"_h": _fields_of(F.col("_r"), "01", last=True), "_02": _places(F.col("_r"), "02")})
    staged = staged.withColumn("_p", _pieces(F.col("_r"), F.col("_02")))
    return staged.withColumn(out, F.when(F.col("_h").isNotNull(), nested)).drop("_r", "_h", "_02", "_p")


def rejects(parsed: DataFrame, col: str = "bai2") -> DataFrame:
    """Files that cannot be rebuilt, with the reason."""
    return parsed.where(F.col(col).isNull()).withColumn("reason", F.lit("Missing 01 header")).drop(col)


def fix(
    parsed: DataFrame,
    as_of_date: str,
    col: str = "bai2",
    legacy: bool = False,
) -> DataFrame:
    """Repair a parsed file.

    Bad dates become ``as_of_date`` (yyMMdd), amounts integer cents, descriptions safe text,
    reference numbers 00001.. per account, the ending balance an integer or 0. ``legacy`` keeps
    only the digits of amounts and only the first piece of a description with commas.
    """
    b = F.col(col)
    day = F.lit(as_of_date)

    def date_or(v):
        return F.when(is_yymmdd(v), v).otherwise(day)

    def raw_description(e):
        return e["description_field"] if legacy else e["description_rest"]

    def entry_of(e, i, cents, clean):
        d = raw_description(e)
        return F.struct(
            e["type_code"].alias("type_code"),
            cents.alias("amount"),
            (cents != e["amount"]).alias("amount_changed"),
            F.lpad((i + 1).cast("string"), 5, "0").alias("ref_num"),
            clean.alias("description"),
            (clean != d).alias("description_changed"),
            sanitize_reasons(d).alias("reasons"),
        )

    def entry(e, i):
        return let(
            int_cents(e["amount"], legacy),
            lambda cents: let(sanitize(raw_description(e)), lambda clean: entry_of(e, i, cents, clean)),
        )

    def account(a):
        given = a["trailer_balance"]
        cents = int_cents(given, legacy)
        ending = F.when(F.coalesce(cents, F.lit("")) == "", F.lit("0")).otherwise(cents)
        return F.struct(
            a["account_number"].alias("account_number"),
            a["currency"].alias("currency"),
            a["type_code"].alias("type_code"),
            a["continuation"].alias("continuation"),
            F.transform(a["entries"], entry).alias("entries"),
            F.when(given.isNull(), F.lit("0")).otherwise(ending).alias("ending_balance"),
            F.coalesce(cents != given, F.lit(False)).alias("ending_balance_fixed"),
        )

    def group(g):
        return F.struct(
            g["receiver_id"].alias("receiver_id"),
            g["originator_id"].alias("originator_id"),
            g["sequence"].alias("sequence"),
            date_or(g["group_date"]).alias("group_date"),
            (~is_yymmdd(g["group_date"])).alias("date_corrected"),
            g["currency"].alias("currency"),
            g["record_length"].alias("record_length"),
            F.transform(g["accounts"], account).alias("accounts"),
        )

    h = b["header"]
    fixed = F.struct(
        F.struct(
            h["originator_id"].alias("originator_id"),
            h["receiver_id"].alias("receiver_id"),
            date_or(h["file_date"]).alias("file_date"),
            h["file_time"].alias("file_time"),
            h["file_sequence"].alias("file_sequence"),
            h["record_length"].alias("record_length"),
            (~is_yymmdd(h["file_date"])).alias("date_corrected"),
        ).alias("header"),
        F.transform(b["groups"], group).alias("groups"),
    )
    return parsed.where(b.isNotNull()).withColumn(col, fixed)


def _sum(arr: Column, value) -> Column:
    zero = F.lit(0).cast("decimal(38,0)")
    return F.aggregate(
        F.transform(arr, value), zero, lambda acc, x: (acc + F.coalesce(x, zero)).cast("decimal(38,0)")
    )


def _n_entries(a: Column) -> Column:
    return F.size(a["entries"])


def _balance(a: Column) -> Column:
    return a["ending_balance"].try_cast("decimal(38,0)")


# How the trailers count records: (added to 49, added per account to 98, added to 98, 99 rule).
# inclusive counts every record with its headers and trailers; the other forms are the layouts of
# the generator specification and of the previous release.
CONVENTIONS = ("inclusive", "spec", "previous")


def account_records(a: Column, convention: str = "inclusive") -> Column:
    return _n_entries(a) + 2 if convention == "inclusive" else _n_entries(a)


def group_records(g: Column, convention: str = "inclusive") -> Column:
    body = _sum(g["accounts"], lambda a: (_n_entries(a) + 2).cast("decimal(38,0)"))
    return body + 2 if convention == "inclusive" else body + 1


def file_records(b: Column, convention: str = "inclusive") -> Column:
    inner = _sum(
        b["groups"],
        lambda g: _sum(g["accounts"], lambda a: (_n_entries(a) + 2).cast("decimal(38,0)")) + 2,
    )
    if convention == "inclusive":
        return inner + 2
    if convention == "spec":
        return _sum(b["groups"], lambda g: group_records(g, "spec"))
    return inner


def group_total(g: Column) -> Column:
    return _sum(g["accounts"], _balance)


def _t(c: Column) -> Column:
    return c.cast("string")


def render_lines(b: Column, convention: str = "inclusive") -> Column:
    """All records of a fixed file in order, as an array of lines."""
    h = b["header"]

    def entry(e):
        return F.concat(
            F.lit("16,"), e["type_code"], F.lit(","), e["amount"], F.lit(",Z,"), e["ref_num"], F.lit(",,"),
            e["description"], F.lit("/"),
        )

    def account(a):
        return F.concat(
            F.array(
                F.concat(
                    F.lit("03,"), a["account_number"], F.lit(","), a["currency"], F.lit(","), a["type_code"],
                    F.lit(",,,"), a["continuation"], F.lit("/"),
                )
            ),
            F.transform(a["entries"], entry),
            F.array(
                F.concat(
                    F.lit("49,"), a["ending_balance"], F.lit(","), _t(account_records(a, convention)), F.lit("/")
                )
            ),
        )

    def group(g):
        return F.concat(
            F.array(
                F.concat(
                    F.lit("02,"), g["receiver_id"], F.lit(","), g["originator_id"], F.lit(","), g["sequence"],
                    F.lit(","), g["group_date"], F.lit(",,"), g["currency"], F.lit(","), g["record_length"],
                    F.lit("/"),
                )
            ),
            F.flatten(F.transform(g["accounts"], account)),
            F.array(
                F.concat(
                    F.lit("98,"), _t(group_total(g)), F.lit(","), _t(F.size(g["accounts"])), F.lit(","),
                    _t(group_records(g, convention)), F.lit("/"),
                )
            ),
        )

    return F.concat(
        F.array(
            F.concat(
                F.lit("01,"), h["originator_id"], F.lit(","), h["receiver_id"], F.lit(","), h["file_date"],
                F.lit(","), h["file_time"], F.lit(","), h["file_sequence"], F.lit(",,,"), h["record_length"],
                F.lit("/"),
            )
        ),
        F.flatten(F.transform(b["groups"], group)),
        F.array(
            F.concat(
                F.lit("99,"), _t(_sum(b["groups"], group_total)), F.lit(","), _t(F.size(b["groups"])), F.lit(","),
                _t(file_records(b, convention)), F.lit("/"),
            )
        ),
    )


def rebuild(fixed: DataFrame, col: str = "bai2", out: str = "fixed_text", convention: str = "inclusive") -> DataFrame:
    return fixed.withColumn(out, F.concat(F.array_join(render_lines(F.col(col), convention), "\n"), F.lit("\n")))


# --- relational views ------------------------------------------------------------------------


def groups_view(parsed: DataFrame, key_cols=("file_id",), col: str = "bai2") -> DataFrame:
    return parsed.select(*key_cols, F.posexplode(f"{col}.groups").alias("_i", "g")).select(
        *key_cols, (F.col("_i") + 1).alias("group_no"), "g"
    )


def accounts_view(parsed: DataFrame, key_cols=("file_id",), col: str = "bai2") -> DataFrame:
    return groups_view(parsed, key_cols, col).select(
        *key_cols, "group_no", F.posexplode("g.accounts").alias("_j", "a")
    ).select(*key_cols, "group_no", (F.col("_j") + 1).alias("account_no"), "a")


def entries_view(parsed: DataFrame, key_cols=("file_id",), col: str = "bai2") -> DataFrame:
    return accounts_view(parsed, key_cols, col).select(
        *key_cols, "group_no", "account_no", F.posexplode("a.entries").alias("_k", "e")
    ).select(*key_cols, "group_no", "account_no", (F.col("_k") + 1).alias("entry_no"), "e.*")


def trailers(fixed: DataFrame, key_cols=("file_id",), col: str = "bai2", convention: str = "inclusive") -> DataFrame:
    """49, 98 and 99 totals of each file as rows (level, group, account, total, items, records)."""
    b = F.col(col)
    null_int = F.lit(None).cast("int")

    def row(level, group_no, account_no, total, items, records):
        return F.struct(
            F.lit(level).alias("level"),
            group_no.alias("group_no"),
            account_no.alias("account_no"),
            total.cast("bigint").alias("total"),
            items.cast("bigint").alias("items"),
            records.cast("bigint").alias("records"),
        )

    accounts = F.flatten(
        F.transform(
            b["groups"],
            lambda g, i: F.transform(
                g["accounts"],
                lambda a, j: row("49", i + 1, j + 1, _balance(a), _n_entries(a), account_records(a, convention)),
            ),
        )
    )
    groups = F.transform(
        b["groups"],
        lambda g, i: row("98", i + 1, null_int, group_total(g), F.size(g["accounts"]), group_records(g, convention)),
    )
    whole = F.array(
        row("99", null_int, null_int, _sum(b["groups"], group_total), F.size(b["groups"]), file_records(b, convention))
    )
    return fixed.select(*key_cols, F.explode(F.concat(accounts, groups, whole)).alias("_x")).select(*key_cols, "_x.*")


def _reason_stats(rank: int, reason: str) -> Column:
    """First entry and number of entries a sanitising reason applies to, over column ``_e``."""

    def applies(e):
        return e["description_changed"] & F.array_contains(e["reasons"], reason)

    return F.struct(
        F.array_position(F.transform("_e", applies), True).alias("first_at"),
        F.lit(rank).alias("rank"),
        F.lit(reason).alias("reason"),
        F.size(F.filter("_e", applies)).alias("n"),
    )


def audit(fixed: DataFrame, key_cols=("file_id",), col: str = "bai2") -> DataFrame:
    """What the repair changed, as counters per file and as the audit text."""
    b = F.col(col)
    staged = fixed.select(
        *key_cols,
        b["header"]["date_corrected"].alias("file_date_corrected"),
        b["header"]["file_date"].alias("_fd"),
        F.size(b["groups"]).alias("groups"),
        F.size(F.filter(b["groups"], lambda g: g["date_corrected"])).alias("group_dates_corrected"),
        F.flatten(F.transform(b["groups"], lambda g: g["accounts"])).alias("_a"),
    ).withColumn("_e", F.flatten(F.transform("_a", lambda a: a["entries"])))
    counted = staged.select(
        *key_cols,
        "file_date_corrected",
        "_fd",
        "groups",
        "group_dates_corrected",
        F.size("_a").alias("accounts_renumbered"),
        F.size(F.filter("_e", lambda e: e["amount_changed"])).alias("amounts_normalized"),
        F.size(F.filter("_e", lambda e: e["description_changed"])).alias("descriptions_sanitized"),
        F.size(F.filter("_a", lambda a: a["ending_balance_fixed"])).alias("ending_balances_fixed"),
        F.array(*[_reason_stats(i, r) for i, r in enumerate(K.SANITIZE_REASONS)]).alias("_r"),
    )
    seen = F.array_sort(F.filter("_r", lambda x: x["n"] > 0))
    reason_text = F.array_join(
        F.transform(seen, lambda x: F.concat(x["reason"], F.lit("="), x["n"].cast("string"))), ", "
    )
    reason_text = F.when(reason_text == "", "sanitized descriptions").otherwise(reason_text)

    def note(n, before, after):
        return F.when(F.col(n) > 0, F.concat(F.lit(before), F.col(n).cast("string"), F.lit(after)))

    text = F.array_join(
        F.array_compact(
            F.array(
                F.when(
                    F.col("file_date_corrected"), F.concat(F.lit("- corrected 01 file date -> "), F.col("_fd"))
                ),
                note("group_dates_corrected", "- corrected ", " group date(s) in 02"),
                note("accounts_renumbered", "- renumbered REF_NUMs for ", " account(s)"),
                note("amounts_normalized", "- normalized ", " amount(s) to integer cents"),
                F.when(
                    F.col("descriptions_sanitized") > 0,
                    F.concat(
                        F.lit("- sanitized "), F.col("descriptions_sanitized").cast("string"),
                        F.lit(" description(s) ("), reason_text, F.lit(")"),
                    ),
                ),
                note("ending_balances_fixed", "- fixed non-integer ending balances in ", " account(s)"),
                F.concat(
                    F.lit("- rebuilt trailers: 49="), F.col("accounts_renumbered").cast("string"),
                    F.lit(", 98="), F.col("groups").cast("string"), F.lit(", 99=1"),
                ),
            )
        ),
        "\n",
    )
    reasons = F.map_from_entries(
        F.transform(
            F.filter("_r", lambda x: x["n"] > 0),
            lambda x: F.struct(x["reason"].alias("key"), x["n"].cast("bigint").alias("value")),
        )
    )
    return counted.select(
        *key_cols,
        "file_date_corrected",
        "group_dates_corrected",
        "accounts_renumbered",
        "amounts_normalized",
        "descriptions_sanitized",
        "ending_balances_fixed",
        reasons.alias("reasons"),
        text.alias("audit_text"),
    )


def record_types(files: DataFrame, key_cols=("file_id",), text_col: str = "text") -> DataFrame:
    """Records by type code, counted in the row."""
    lines = F.split(line_feeds(text_col), "\n")
    codes = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.substring_index(x, ",", 1))
    return files.select(*key_cols, F.inline(counted(codes, "rec")))


def violations(parsed: DataFrame, key_cols=("file_id",), text_col: str = "text", col: str = "bai2",
               convention: str = "inclusive") -> DataFrame:
    """One row per broken rule of a file; a clean file yields none. Lines, accounts and entries are columns of their
    own before the rules look at them: each rule would build its own otherwise."""
    b = F.col("_b")
    lines, accounts, entries = F.col("_l"), F.col("_a"), F.col("_e")
    staged = parsed.select(
        *key_cols,
        F.filter(F.split(line_feeds(text_col), "\n"), lambda x: F.trim(x) != "").alias("_l"),
        F.col(col).alias("_b"),
    )
    staged = staged.withColumn("_a", F.flatten(F.transform(b["groups"], lambda g: g["accounts"])))
    staged = staged.withColumn("_e", F.flatten(F.transform(accounts, lambda a: a["entries"])))

    def num(s):
        return s.try_cast("decimal(38,0)")

    def count(arr, cond):
        return F.size(F.filter(arr, cond))

    def refs_bad(a):
        return F.exists(
            F.transform(a["entries"], lambda e, i: e["ref_num"] != F.lpad((i + 1).cast("string"), 5, "0")),
            lambda x: x,
        )

    def acc_bad(a):
        return ~F.coalesce(num(a["trailer_count"]) == account_records(a, convention), F.lit(False))

    def grp_total(g):
        return _sum(g["accounts"], lambda a: num(a["trailer_balance"]))

    def grp_bad(g):
        t = g["trailer"]
        ok = (
            (num(_field(t, 1)) == grp_total(g))
            & (num(_field(t, 2)) == F.size(g["accounts"]))
            & (num(_field(t, 3)) == group_records(g, convention))
        )
        return ~F.coalesce(ok, F.lit(False))

    t99 = b["trailer"]
    file_ok = (
        (num(_field(t99, 1)) == _sum(b["groups"], grp_total))
        & (num(_field(t99, 2)) == F.size(b["groups"]))
        & (num(_field(t99, 3)) == file_records(b, convention))
    )
    rules = [
        ("starts_with_01", F.when(F.startswith(F.try_element_at(lines, F.lit(1)), F.lit("01,")), 0).otherwise(1)),
        ("ends_with_slash", count(lines, lambda x: ~F.endswith(x, F.lit("/")))),
        ("integer_amount", count(entries, lambda e: ~e["amount"].rlike(r"^\d+$"))),
        ("slash_in_description", count(entries, lambda e: F.contains(e["description_rest"], F.lit("/")))),
        ("reference_sequence", count(accounts, refs_bad)),
        ("account_trailer", count(accounts, acc_bad)),
        ("group_trailer", count(b["groups"], grp_bad)),
        ("file_trailer", F.when(F.coalesce(file_ok, F.lit(False)), 0).otherwise(1)),
    ]
    checks = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.coalesce(v, F.lit(0)).cast("bigint").alias("n")) for n, v in rules]
    )
    return (
        staged.select(*key_cols, F.explode(F.filter(checks, lambda x: x["n"] > 0)).alias("_x"))
        .select(*key_cols, "_x.rule", "_x.n")
    )


def code_mismatch(type_code, description) -> Column:
    """Deposit text under a withdrawal code or the other way round; a flag, never a change."""
    t = F.col(type_code) if isinstance(type_code, str) else type_code
    low = F.lower(F.col(description) if isinstance(description, str) else description)
    says_in = low.rlike("deposit|credit")
    says_out = low.rlike("withdrawal|debit|payment|purchase")
    return F.coalesce(
        ((t == K.BAI2_CODE_DEPOSIT) & says_out & ~says_in) | ((t == K.BAI2_CODE_WITHDRAWAL) & says_in & ~says_out),
        F.lit(False),
    )


# --- generation --------------------------------------------------------------------------------


def type_code(is_fee: Column, is_deposit: Column) -> Column:
    return (
        F.when(is_fee, K.BAI2_CODE_FEE).when(is_deposit, K.BAI2_CODE_DEPOSIT).otherwise(K.BAI2_CODE_WITHDRAWAL)
    )


def from_transactions(
    txns: DataFrame,
    files: DataFrame,
    key_cols=("file_id",),
    order_cols=("txn_date", "txn_id"),
    receiver_id: str = K.BAI2_RECEIVER,
    col: str = "bai2",
) -> DataFrame:
    """Files from resolved statements.

    ``txns``: key, order columns, amount_cents (signed), description, is_fee. ``files``: one row per
    key with account_number, originator_id, file_date, file_time, ending_balance. A key is one
    statement; the caller bounds the transactions of a statement, the shuffle is on that key.
    """
    code = type_code(F.col("is_fee"), F.col("amount_cents") > 0)
    rows = txns.groupBy(*key_cols).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    *order_cols,
                    code.alias("type_code"),
                    F.abs("amount_cents").cast("string").alias("amount"),
                    sanitize("description").alias("description"),
                )
            )
        ).alias("_rows")
    )
    entries = F.transform(
        F.coalesce(F.col("_rows"), F.array().cast(_entry_rows_type(txns, order_cols))),
        lambda x, i: F.struct(
            x["type_code"].alias("type_code"),
            x["amount"].alias("amount"),
            F.lpad((i + 1).cast("string"), 5, "0").alias("ref_num"),
            x["description"].alias("description"),
        ),
    )
    nested = file_column(
        entries,
        *[F.col(c) for c in ("account_number", "originator_id", "file_date", "file_time")],
        F.col("ending_balance").cast("string"),
        receiver_id,
    )
    return files.join(rows, list(key_cols), "left").select(*key_cols, nested.alias(col))


def file_column(
    entries: Column,
    account_number: Column,
    originator_id: Column,
    file_date: Column,
    file_time: Column,
    ending_balance: Column,
    receiver_id: str = K.BAI2_RECEIVER,
) -> Column:
    """Nested form of a file with one group and one account."""
    account = F.struct(
        account_number.alias("account_number"),
        F.lit("USD").alias("currency"),
        F.lit("010").alias("type_code"),
        F.lit("Z").alias("continuation"),
        entries.alias("entries"),
        ending_balance.alias("ending_balance"),
    )
    group = F.struct(
        F.lit(receiver_id).alias("receiver_id"),
        originator_id.alias("originator_id"),
        F.lit("1").alias("sequence"),
        file_date.alias("group_date"),
        F.lit("USD").alias("currency"),
        F.lit("2").alias("record_length"),
        F.array(account).alias("accounts"),
    )
    return F.struct(
        F.struct(
            originator_id.alias("originator_id"),
            F.lit(receiver_id).alias("receiver_id"),
            file_date.alias("file_date"),
            file_time.alias("file_time"),
            F.lit("1").alias("file_sequence"),
            F.lit("2").alias("record_length"),
        ).alias("header"),
        F.array(group).alias("groups"),
    )


def _entry_rows_type(txns: DataFrame, order_cols) -> str:
    kinds = dict(txns.dtypes)
    inner = ",".join([f"{c}:{kinds[c]}" for c in order_cols] + ["type_code:string", "amount:string", "description:string"])
    return f"array<struct<{inner}>>"
