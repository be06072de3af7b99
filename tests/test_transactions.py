from pyspark.sql import functions as F

from tallymark.operators import transactions as T

STATEMENT = """RIVER VALLEY BANK
Account number
0001234567 Beginning balance
DEBITS
Date
06-02
Preauthorized Wd

390.00
06-10
 Maintenance Fee
52.04
CREDITS
06-03
Deposit
Main office
1,200.10
ignored after the amount
06-04
no amount before the next date
06-05
77.5
DAILY BALANCES
06-02
610.00
"""


def rows(df):
    return sorted(
        (r.section, r.entry_no, r.txn_date, r.txn_type, r.amount_cents, r.description) for r in df.collect()
    )


def test_sections_end_at_daily_balances(texts):
    got = rows(T.extract_transactions(texts(STATEMENT)))
    assert got == [
        ("credits", 1, "06-03", "credit", 120010, "Deposit | Main office"),
        ("debits", 1, "06-02", "debit", 39000, "Preauthorized Wd"),
        ("debits", 2, "06-10", "fee", 5204, "Maintenance Fee"),
    ]


def test_legacy_reads_daily_balances_as_credits(texts):
    got = rows(T.extract_transactions(texts(STATEMENT), reset_sections=False))
    assert [r for r in got if r[5] == ""] == [("credits", 5, "06-02", "credit", 61000, "")]
    assert len(got) == 4


def test_amount_forms_that_do_not_count(texts):
    text = "DEBITS\n01-02\nx\n$5.00\n1234.56\n-7.00\n01-03\ny\n9.99"
    assert [r.amount for r in T.extract_transactions(texts(text)).collect()] == ["9.99"]


def test_an_entry_is_searched_once_for_its_amount(texts):
    assert str(T.transactions_array("text")).replace("\\\\", "\\").count(T.K.TXN_AMOUNT_LINE) == 1
    text = "DEBITS\n06-02\n390.00x\nx390.00\n\u20ac\U0001f600 a\n390.00\n390.00\n06-03\n06-04\n5.00\nCredits\n06-05\n1.00"
    assert rows(T.extract_transactions(texts(text))) == [
        ("credits", 1, "06-05", "credit", 100, ""),
        ("debits", 1, "06-02", "debit", 39000, "390.00x | x390.00 | \u20ac\U0001f600 a"),
        ("debits", 3, "06-04", "debit", 500, ""),
    ]


def test_clean_lines(column):
    raw = ["a\nb", " a \n\n b ", "a\r\nb\rc\x85d", "a\u00a0\nb", "a\n", None, "a b\u2028c", "\n\n"]
    assert column(T.clean_lines("s"), raw) == ["a\nb", "a\nb", "a\nb\nc\nd", "a\nb", "a", None, "a b\nc", ""]


def test_totals(texts):
    r = T.section_totals(T.extract_transactions(texts(STATEMENT))).collect()[0]
    assert (r.total_debits_cents, r.total_credits_cents, r.count_debits, r.count_credits) == (44204, 120010, 2, 1)


def test_windows_over_lines_agree_with_the_row_form(texts):
    from tallymark.operators import lines as L

    table = L.explode_lines(L.with_segment(L.with_section(L.line_arrays(texts(STATEMENT), clean=True))))
    # In the window form a segment is a transaction when it starts with a date and has an amount.
    seg = (
        table.groupBy("segment", "section")
        .agg(
            F.min_by("line", "pos").alias("head"),
            F.min(F.when(F.col("line").rlike(r"^\d{1,3}(?:,\d{3})*\.\d{2}$"), F.struct("pos", "line"))).alias("a"),
        )
        .where(F.col("a").isNotNull() & F.col("section").isNotNull() & F.col("head").rlike(r"^\d\d-\d\d$"))
    )
    window = sorted((r.section, r.head, r.a.line) for r in seg.collect())
    in_row = sorted(
        (r.section, r.txn_date, r.amount) for r in T.extract_transactions(texts(STATEMENT), reset_sections=False).collect()
    )
    assert window == in_row


def test_dense_text(column):
    filler = "\n".join(["nothing to see here"] * 700)
    keep = ["Deposit 5", "cost $3"]
    balances = [f"Total line {i}" for i in range(25)]
    long = "\n".join(balances[:12]) + "\n" + filler + "\n" + "\n".join(keep) + "\n" + "\n".join(balances[12:])
    short, dense = column(T.dense_text("s"), ["tiny $1", long])
    assert short == "tiny $1"
    assert dense.split("\n") == balances[:10] + keep + balances[-10:]


def test_dense_text_at_its_limits(column):
    lines = "\n".join(["fee 1", "total a", "other", "total b", "total c"])
    run = lambda **options: column(T.dense_text("s", **options), [lines])[0]
    assert run(least=len(lines), edge=1, keep_below=1.0) == lines
    assert run(least=len(lines) - 1, edge=1, keep_below=1.0).split("\n") == ["total a", "fee 1", "total c"]
    assert run(least=0, edge=1, keep_below=0.1) == lines and run(least=0, edge=5, keep_below=1.0) == lines


def test_marker(spark):
    df = spark.createDataFrame(
        [([("user", "a"), ("user", "p FULL OCR TEXT: body"), ("assistant", "z")],), ([("user", "bare")],)],
        "messages array<struct<role:string,content:string>>",
    )
    assert [r[0] for r in df.select(T.text_after_marker("messages")).collect()] == [" body", "bare"]
