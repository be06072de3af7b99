"""Transactions from statement text, section totals and the text reduction of long documents.

A document is one row, so the parser works inside the row: the text is cut at section names,
each section at its dates, and every piece is one candidate transaction. No line table, no
window and no exchange is needed; a long document costs its own length and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions import fixed as K
from tallymark.functions.predicates import any_contains, let, strip
from tallymark.functions.scalars import amount_cents


def clean_lines(c) -> Column:
    """Text with every line trimmed and blank lines removed."""
    c = F.col(c) if isinstance(c, str) else c
    ws = K.WHITESPACE.replace("\n", "")
    one = F.regexp_replace(c, K.LINE_BREAK, "\n")
    one = F.regexp_replace(one, "[" + ws + "]*\n[" + ws + "\n]*", "\n")
    # One search settles texts that have nothing around their line feeds.
    odd = rf"[{ws}\n{K.ODD_LINE_BREAK}](?:(?<={K.ODD_LINE_BREAK})|(?<=\n)(?=[{ws}\n])|(?<=[{ws}])(?=\n))"
    return strip(F.when(c.rlike(odd), one).otherwise(c))


def _names(names) -> str:
    return "|".join(names)


def transactions_array(text, reset_sections: bool = True) -> Column:
    """Transactions of a text as an array of structs, in printed order."""
    t = F.col(text) if isinstance(text, str) else text
    heads = K.SECTION_TERMINATORS if reset_sections else K.SECTION_NAMES
    cut_section = rf"(?dim)^(?=(?:{_names(heads)})$)"
    cut_entry = rf"(?dim)^(?=(?:{K.TXN_DATE_LINE}|{_names(K.SECTION_TERMINATORS)})$)"
    through_amount = rf"(?dms)\A.*?^{K.TXN_AMOUNT_LINE}$"

    def txn(section, entry_no, day, printed, description):
        kind = (
            F.when(let(F.upper(description), lambda d: any_contains(d, K.FEE_MARKERS)), "fee")
            .when(section["name"] == "debits", "debit")
            .otherwise("credit")
        )
        return F.struct(
            section["name"].alias("section"),
            section["no"].alias("section_no"),
            entry_no.alias("entry_no"),
            day.alias("txn_date"),
            kind.alias("txn_type"),
            printed.alias("amount"),
            amount_cents(printed).alias("amount_cents"),
            description.alias("description"),
        )

    def between(found, printed):
        """Lines between the date and the first amount, of what both enclose."""
        inner = F.substring(found, F.lit(6), F.length(found) - F.length(printed) - 5)
        return F.replace(F.btrim(inner, F.lit("\n")), F.lit("\n"), F.lit(" | "))

    def entries(section):
        def parse(entry, no):
            def read(found):
                return let(
                    F.substring_index(found, "\n", -1),
                    lambda printed: let(
                        between(found, printed), lambda d: txn(section, no, F.substring(entry, 1, 5), printed, d)
                    ),
                )

            return F.when(
                entry.rlike(rf"(?d)^{K.TXN_DATE_LINE}\n"),
                let(F.regexp_extract(entry, through_amount, 0), lambda found: F.when(found != "", read(found))),
            )

        return F.filter(F.transform(F.split(section["body"], cut_entry), parse), lambda x: x.isNotNull())

    sections = F.transform(
        F.split(clean_lines(t), cut_section),
        lambda body, no: F.struct(
            no.alias("no"), F.lower(F.substring_index(body, "\n", 1)).alias("name"), body.alias("body")
        ),
    )
    wanted = F.filter(sections, lambda x: x["name"].isin([n.lower() for n in K.SECTION_NAMES]))
    return F.flatten(F.transform(wanted, entries))


def extract_transactions(
    docs: DataFrame, text_col: str = "text", key_cols=("doc_id",), reset_sections: bool = True
) -> DataFrame:
    """One row per transaction printed under a DEBITS or CREDITS heading.

    ``reset_sections=True`` ends a section at DAILY BALANCES and the fee block, which keeps
    daily balances out of the credits; ``False`` lets the section run on, as older outputs do.
    """
    return docs.select(*key_cols, F.inline(transactions_array(text_col, reset_sections)))


def section_totals(txns: DataFrame, key_cols=("doc_id",)) -> DataFrame:
    """Sum and count per section. Sums are combined before the shuffle."""
    is_debit = F.col("section") == "debits"
    return txns.groupBy(*key_cols).agg(
        F.sum(F.when(is_debit, F.col("amount_cents")).otherwise(0)).alias("total_debits_cents"),
        F.sum(F.when(~is_debit, F.col("amount_cents")).otherwise(0)).alias("total_credits_cents"),
        F.count_if(is_debit).alias("count_debits"),
        F.count_if(~is_debit).alias("count_credits"),
    )


def dense_text(
    text,
    own_names=(),
    least: int = K.DENSE_MIN_CHARS,
    edge: int = K.DENSE_EDGE_LINES,
    keep_below: float = K.DENSE_KEEP_RATIO,
) -> Column:
    """Transaction-dense lines of a long text; short texts and weak reductions stay whole.

    ``own_names`` adds words, such as the account holder's company name, that mark a line. Texts of up to
    ``least`` characters stay as they are; of the balance lines the first and last ``edge`` are kept; a reduction
    counts if it is shorter than ``keep_below`` of the text.
    """
    t = F.col(text) if isinstance(text, str) else text
    lines = F.split(t, "\n")
    words = K.DENSE_TXN_WORDS + [w.lower() for w in own_names]

    def kind(low):
        return F.when(
            any_contains(low, words) | (F.contains(low, F.lit("$")) & low.rlike(r"\p{Nd}")), "txn"
        ).when(any_contains(low, K.DENSE_BALANCE_WORDS), "balance")

    def of_kind(tagged, name):
        return F.transform(F.filter(tagged, lambda x: x["kind"] == name), lambda x: x["line"])

    def focus(tagged):
        return let(
            of_kind(tagged, "balance"),
            lambda balance: F.array_join(
                F.concat(
                    F.slice(balance, 1, edge),
                    of_kind(tagged, "txn"),
                    F.slice(balance, F.greatest(F.size(balance) - F.lit(edge) + 1, F.lit(1)), F.lit(edge)),
                ),
                "\n",
            ),
        )

    shorter = let(
        let(
            F.transform(lines, lambda x: F.struct(let(F.lower(x), kind).alias("kind"), x.alias("line"))), focus
        ),
        lambda f: F.when(F.length(f) < F.length(t) * keep_below, f).otherwise(t),
    )
    return F.when(F.length(t) <= least, t).otherwise(shorter)


def dense_documents(docs: DataFrame, text_col: str = "text", out: str = "dense", **options) -> DataFrame:
    return docs.withColumn(out, dense_text(text_col, **options))


def text_after_marker(messages, marker: str = K.PROMPT_MARKER) -> Column:
    """Text behind the marker in the last user message of a prompt payload."""
    m = F.col(messages) if isinstance(messages, str) else messages
    user = F.filter(m, lambda x: x["role"] == "user")
    content = F.try_element_at(user, F.lit(-1))["content"]
    at = F.locate(marker, content) if isinstance(marker, str) else F.instr(content, marker)
    return F.when(at > 0, F.substring(content, at + len(marker), F.length(content))).otherwise(content)
