import datetime

import pytest
from pyspark.sql import functions as F

from tallymark.functions import scalars as S
from tallymark.operators import banks as B


@pytest.mark.parametrize(
    "line,name",
    [
        ("First National Bank of Rivertown Page 1", "First National Bank of Rivertown"),
        ("Bank of The Hills North", "Bank of The Hills"),
        ("Bank of the West Hills", "Bank"),
        ("Lakeside Federal Credit Union PO Box 12", "Lakeside Federal Credit Union"),
        ("Mesa Trust and Savings Association", "Mesa Trust and Savings Association"),
        ("Harbor Bank 123 Main Street", "Harbor Bank"),
        ("1 First United Bank & Trust", "First United Bank & Trust"),
        ("Statement of account", None),
        ("12 34 $", None),
        ("Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda", "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa"),
    ],
)
def test_line(column, line, name):
    assert column(B.bank_name_from_line("s"), [line]) == [name]


def test_words_and_choice(column):
    assert column(B.bank_name_from_words("s"), ["1 Harbor Savings Bank x", "page one", "Acme Union Bank"]) == [
        "Harbor", None, "Acme Union",
    ]
    text = "Page 1\n\nAccount 5\nHarbor Bank\nOther Bank"
    assert column(B.bank_name("s"), [text]) == ["Harbor Bank"]


def test_windows_are_parameters(column):
    long = "Alpha Beta Gamma Delta Epsilon Zeta Eta Theta Iota Kappa Lambda"
    assert column(B.bank_name_from_line("s", most=11), [long]) == [long]
    wide, whole = B.bank_name_from_line("s"), B.bank_name_from_line("s", window=None)
    lines = [long, "1 First United Bank & Trust", "Harbor Bank " + "x " * 50]
    assert column(wide, lines) == column(whole, lines)
    late = "Page 1\nDate 2\nPage 3\nPage 4\nPage 5\nHarbor Bank"
    assert column(B.bank_name("s"), [late]) == [None]
    assert column(B.bank_name("s", lines=6), [late]) == ["Harbor Bank"]
    words = "One Two Three Four Five Six Seven Eight Nine Ten Eleven Bank"
    assert column(B.bank_name_from_words("s"), [words]) == ["One Two Three Four Five Six Seven Eight"]
    assert column(B.bank_name_from_words("s", words=12, run=12), [words]) == [words]


def test_patterns_prefer_header_and_length(texts):
    body = "\n" * 11 + "The Very Long Name Of Another Trust Company"
    r = B.bank_name_by_patterns(texts("x\nharbor bank\n" + body)).collect()[0]
    assert (r.bank_name, r.from_header) == ("Harbor Bank", True)


def test_run_patterns_equal_the_free_search(spark):
    """Anchored search per run gives what a free search of the pattern gives."""
    import re

    from tallymark.functions import fixed as K

    samples = [
        "Harbor Bank and Trust, 12 Mesa Savings; Bank\n9 a Corp x", "aBank Bank of x Trust", "National City, a State B.",
        "x LLC, y N.A. z; q NA", "- ' Trust", "b Inc\n& trust company 5",
    ]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    for i in sorted(B._RUN_PATTERNS):
        got = [list(r[0]) for r in df.select(B._pattern_matches(F.col("s"), i)).collect()]
        assert got == [re.findall(K.BANK_NAME_PATTERNS[i], s, re.IGNORECASE) for s in samples]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_are_cleaned_as_rows(texts):
    """Cleaning and testing run on plain columns, not once per match inside a lambda, and give what they gave."""
    docs = texts("O'brien-smith Bank And Trust Company.\nUsa Fcu  x1y", "harbor FCU and co., N.A. " * 9, "Bank of the\tHills", None)
    got = B.bank_name_candidates(docs)
    assert "initcap(lambda" not in _plan(got) and "initcap(named" not in _plan(got)
    rows = got.collect()
    assert {"O'Brien-Smith Bank & Trust Company", "USA FCU X1Y", "X1Y", "Brien"} & {r.name for r in rows if r.doc_id == 0}
    assert {r.name for r in rows if r.doc_id == 2} >= {"Bank Of The Hills"}
    assert all(len(r.name) <= 100 and r.doc_id < 3 for r in rows)
    best = {r.doc_id: r.bank_name for r in B.bank_name_by_patterns(docs).collect()}
    for k, name in best.items():
        mine = [r for r in rows if r.doc_id == k and r.is_header == any(q.is_header for q in rows if q.doc_id == k)]
        assert name == min(mine, key=lambda r: (-len(r.name), r.pos)).name


def test_candidates_of_texts_in_title_case(texts, spark):
    """The text is put in title case once; names are those of matches that are cleaned one by one."""
    docs = texts(
        "Eurobank of x1y hills\n\xa0\n\tBANKING bank of the AND and .", "éabcde ÉCOLE ßtrust \u017favings \u0131ncorp \u212a na, İstanbul bank",
        "USA fcu x1y\x01 a\x02b and, N.A.\tthe  usa And first National  trust ;", None, "", "12abcde 3fg 𐐀 Corp, a b c d e f",
    )
    got = B.bank_name_candidates(docs)
    assert _plan(got).count("initcap(") == 1
    t = F.col("text")
    every = F.concat(*[F.transform(f, lambda n, i: F.struct(F.lit(h).alias("h"), i.alias("i"), n.alias("n"))) for h, f in ((True, B._header_found(t)), (False, B._found(t)))])
    each = docs.select("doc_id", F.inline(every)).select("doc_id", "h", "i", B.clean_bank_name("n").alias("name"))
    want = sorted(tuple(r) for r in each.where(B.is_valid_bank_name("name")).collect())
    assert len(want) > 40 and sorted(tuple(r) for r in got.collect()) == want


def test_long_lines_without_an_ending_need_no_fold(spark):
    """The window is cut from the first words, wherever numbers and symbols stand between them."""
    lines = ["x " * 12, "1 # 2 $ " * 20 + "Harbor Bank", "  Alpha Beta page " + "y " * 99, "A b c d e f g h i j Bank", "Bank", "", "%" * 9]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string")
    made = df.select("i", B.bank_name_from_line("s").alias("n"))
    assert "exists(" in _plan(made)
    wide = B.bank_name_from_line("s", window=None)
    got = {r.i: (r.n, r.w) for r in df.select("i", B.bank_name_from_line("s").alias("n"), wide.alias("w")).collect()}
    assert all(a == b for a, b in got.values())
    assert [got[i][0] for i in (0, 1, 2, 3, 4, 5)] == ["x x x x x x x x x x", "Harbor Bank", "Alpha Beta", "A b c d e f g h i j", "Bank", None]


def test_a_step_of_the_fold_works_out_its_extension_once():
    assert str(B.bank_name_from_line("s", window=None)).count(",".join(B.K.BANK_CONNECTORS)) == 1


def test_norm(column):
    names = ["First National Bank, N.A.", "Mesa Bank & Trust Company", "STOCKYARDS bank", "Lake Federal Credit Union", None]
    assert column(S.norm_bank("s"), names) == ["FIRST BANK", "MESA BANK", "STOCK YARDS BANK", "LAKE FCU", ""]


def test_dates(column):
    vals = ["6/30/25", "06/30/2025", "2025-06-30", "06-30-2025", "June 30, 2025", "6/30/75", "13/40/2025", None]
    d = datetime.date(2025, 6, 30)
    assert column(S.loose_date("s"), vals) == [d, d, d, d, d, datetime.date(1975, 6, 30), None, None]
    names = ["stmt_20250731.pdf", "x-07-31-25.pdf", "a-2025-07-31", "none"]
    assert column(S.yymmdd(S.filename_date("s")), names) == ["250731", "250731", "250731", None]


def test_statement_date_order(spark):
    df = spark.createDataFrame(
        [
            (None, "period 07/01/25 through 07/31/25", None, "x-2024-01-02"),
            ("bad", "none", "2025-05-31", "x"),
            ("06/30/2025", "period 07/01/25 through 07/31/25", None, "x"),
            (None, "none", None, "x-2024-01-02"),
        ],
        "e string, t string, p string, f string",
    )
    got = [r[0] for r in df.select(B.statement_date("e", "t", "p", None, "f")).collect()]
    assert got == ["250731", "250531", "250630", "240102"]


def test_date_tokens(texts):
    t = B.date_tokens(texts("a\n6/2/2025 and 6/3\nJune 4, 2025"))
    got = [(r.line_no, r.token, r.prev_line, r.next_line) for r in t.orderBy("line_no", "token").collect()]
    assert got == [
        (2, "6/2/2025", "a", "June 4, 2025"), (2, "6/3", "a", "June 4, 2025"),
        (3, "June 4, 2025", "6/2/2025 and 6/3", None),
    ]


def test_dedupe(spark):
    df = spark.createDataFrame([(["Ab", "x", "aB", "X", "y"],)], "v array<string>")
    assert df.select(B.dedupe_ignore_case(F.col("v"))).collect()[0][0] == ["Ab", "x", "y"]
