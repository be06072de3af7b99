import pytest
from pyspark.sql import functions as F

from tallymark.operators import bai2 as B
from tallymark.operators import error_files as E
from tallymark.operators import lines as L

MESSY = """01,ORIG,WORKDAY,251340,1200,1,,,2/
16,301,1,Z,1,,before any group/
03,000,USD,010,,,Z/
02,WORKDAY,ORIG,1,250631,,USD,2/
03,111,USD,010,,,Z/
16,301,12.50,Z,9,,Deposit, River Town/
16,451,-300,Z,9,,A/B é/

49,-10.5,2/
16,301,5,Z,1,,after 49/
03,222,USD,010,,,Z/
16,301,7,Z,1,,in 222/
98,0,0,0/
03,333,USD,010,,,Z/
16,301,8,Z,1,,late in 222/
02,WORKDAY,ORIG,2,250630,,USD,2/
03,444,USD,010,,,Z/
99,0,0,0/
"""


@pytest.fixture
def files(spark):
    return spark.createDataFrame([("m", MESSY), ("r", "02,x/\n03,1/")], "file_id string, text string")


def fixed_text(files, **kw):
    return {r.file_id: r.fixed_text for r in B.rebuild(B.fix(B.parse(files), "250701", **kw)).collect()}


def test_hierarchy(files):
    e = B.entries_view(B.parse(files).where("bai2 is not null")).collect()
    assert [(r.group_no, r.account_no, r.description_rest) for r in e] == [
        (1, 1, "Deposit, River Town"), (1, 1, "A/B é"), (1, 2, "in 222"), (1, 2, "late in 222"),
    ]
    assert [r.file_id for r in B.rejects(B.parse(files)).collect()] == ["r"]


def test_window_form_agrees(files):
    h = L.with_hierarchy(L.record_arrays(files.where("file_id = 'm'")))
    got = [(r.group_no, r.account_no) for r in h.where("rec = '16'").orderBy("pos").collect()]
    assert got == [(None, None), (1, 1), (1, 1), (1, None), (1, 2), (None, 2)]


def test_fix_and_rebuild(files):
    assert fixed_text(files)["m"].split("\n") == [
        "01,ORIG,WORKDAY,250701,1200,1,,,2/",
        "02,WORKDAY,ORIG,1,250701,,USD,2/",
        "03,111,USD,010,,,Z/",
        "16,301,1250,Z,00001,,Deposit, River Town/",
        "16,451,-300,Z,00002,,A-B/",
        "49,-1050,4/",
        "03,222,USD,010,,,Z/",
        "16,301,7,Z,00001,,in 222/",
        "16,301,8,Z,00002,,late in 222/",
        "49,0,4/",
        "98,-1050,2,10/",
        "02,WORKDAY,ORIG,2,250630,,USD,2/",
        "03,444,USD,010,,,Z/",
        "49,0,2/",
        "98,0,1,4/",
        "99,-1050,2,16/",
        "",
    ]


def test_records_are_told_by_their_codes_alone(spark):
    """One cut at line feeds; no pattern is searched again in the pieces of a file."""
    text = "99,7\r\n01,A\x8502//\n02\n16,0,before an account/\n03/\n16,1,2\n49x\n 16,x\n49/\n16,3\n98,9/\n16,4\n03,5\n02/,6\n02,7/\n98/\n03,8/"
    parsed = B.parse(spark.createDataFrame([("a", text), ("b", None), ("c", "01")], "file_id string, text string"))
    got = {r.file_id: r.bai2 for r in parsed.collect()}
    assert got["b"] is None and got["c"].groups == [] and got["c"].trailer is None
    first, second = got["a"].groups
    assert [(a.account_number, [e.amount for e in a.entries], a.trailer_balance) for a in first.accounts] == [("", ["2"], None)]
    assert first.trailer == ["98", "9"] and second.receiver_id == "7" and second.accounts == []
    assert second.trailer == ["98"] and got["a"].trailer == ["99", "7"] and got["a"].header.originator_id == "A"
    assert "(?dm)" not in parsed._jdf.queryExecution().analyzed().toString()


def test_rules_share_the_entries_of_a_file(files):
    """Lines, accounts and entries are built once for all rules."""
    plan = B.violations(B.parse(files))._jdf.queryExecution().analyzed().toString()
    assert plan.count("flatten(") == 2


def test_legacy_keeps_digits_and_first_piece(files):
    lines = fixed_text(files, legacy=True)["m"].split("\n")
    assert lines[3:6] == ["16,301,1250,Z,00001,,Deposit/", "16,451,300,Z,00002,,A-B/", "49,105,4/"]


def test_rebuild_is_idempotent(spark, files):
    once = fixed_text(files)["m"]
    again = spark.createDataFrame([("m", once)], "file_id string, text string")
    assert fixed_text(again)["m"] == once
    left = {(r.rule, r.n) for r in B.violations(B.parse(again)).collect()}
    assert left == {("integer_amount", 1)}


def test_conventions(files):
    fixed = B.fix(B.parse(files), "250701")
    get = lambda c: [
        (r.level, r.records) for r in B.trailers(fixed, convention=c).orderBy("level", "group_no", "account_no").collect()
    ]
    assert get("inclusive") == [("49", 4), ("49", 4), ("49", 2), ("98", 10), ("98", 4), ("99", 16)]
    assert get("spec") == [("49", 2), ("49", 2), ("49", 0), ("98", 9), ("98", 3), ("99", 12)]
    assert get("previous") == [("49", 2), ("49", 2), ("49", 0), ("98", 9), ("98", 3), ("99", 14)]


def test_audit(files):
    a = B.audit(B.fix(B.parse(files), "250701")).collect()[0]
    assert a.audit_text.split("\n") == [
        "- corrected 01 file date -> 250701",
        "- corrected 1 group date(s) in 02",
        "- renumbered REF_NUMs for 3 account(s)",
        "- normalized 1 amount(s) to integer cents",
        "- sanitized 1 description(s) (replace slash with dash=1, non-ascii -> space=1)",
        "- fixed non-integer ending balances in 1 account(s)",
        "- rebuilt trailers: 49=3, 98=2, 99=1",
    ]
    assert a.reasons == {"replace slash with dash": 1, "non-ascii -> space": 1}


def test_violations(files):
    got = {r.rule: r.n for r in B.violations(B.parse(files).where("file_id = 'm'")).collect()}
    assert got["integer_amount"] == 2 and got["slash_in_description"] == 1 and got["reference_sequence"] == 2
    assert {"account_trailer", "group_trailer", "file_trailer"} <= set(got)


def test_generate(spark):
    t = spark.createDataFrame(
        [("f", 1, 100, "Pay in / x", False), ("f", 2, -40, "Service fee", True), ("f", 3, -5, "Out", False)],
        "file_id string, txn_id int, amount_cents long, description string, is_fee boolean",
    )
    f = spark.createDataFrame(
        [("f", "123", "O", "250630", "1200", 55), ("empty", "9", "O", "250630", "1200", 0)],
        "file_id string, account_number string, originator_id string, file_date string, file_time string, ending_balance long",
    )
    out = B.rebuild(B.from_transactions(t, f, order_cols=("txn_id",)), out="text")
    text = {r.file_id: r.text.strip().split("\n") for r in out.collect()}
    assert text["f"][3:7] == [
        "16,301,100,Z,00001,,Pay in - x/", "16,475,40,Z,00002,,Service fee/", "16,451,5,Z,00003,,Out/", "49,55,5/",
    ]
    assert text["empty"][-3:] == ["49,0,2/", "98,0,1,4/", "99,0,1,6/"]


def test_code_check(column):
    got = column(B.code_mismatch(F.lit("301"), "s"), ["card purchase", "deposit of payment", "deposit"])
    assert got == [True, False, False]


def test_error_file(spark):
    df = spark.createDataFrame([("No account number on page", "a.pdf")], "m string, f string")
    text = df.select(
        E.error_file_text(F.col("m"), F.col("f"), F.lit("250630"), F.lit("1200"), F.lit("2025-07-01"), details=F.array(F.lit("k: v")))
    ).collect()[0][0]
    assert "# Error Code: ERROR_NO_ACCOUNT" in text and "# k: v" in text
    records = [x for x in text.split("\n") if x and not x.startswith("#")]
    assert records[3] == "88,999,ERROR_NO_ACCOUNT,,Z/" and records[-1] == "99,0,1,7/" and len(records) == 7
    assert text.endswith("/\n")


def test_routing_and_fence(column):
    assert column(E.file_status("s"), ["03,ERROR,USD", "x ERROR_NO_ACCOUNT", "03,1"]) == ["ERROR", "ERROR", "OK"]
    assert column(E.strip_fence("s"), ["```\nsay\n01,a/\n98,\n99,0/\n```", "01,x/"]) == ["01,a/\n98,\n99,0/", "01,x/"]


def test_long_description_is_kept_whole(spark):
    tail = ",".join(f"d{i}" for i in range(100_050))
    text = f"01,A,B,250630,1200,1,,,2/\n02,B,A,1,250630,,USD,2/\n03,1,USD,010,,,Z/\n16,301,1,Z,1,,{tail}/\n49,1,1/\n98,0,0,0/\n99,0,0,0/"
    e = B.entries_view(B.parse(spark.createDataFrame([("l", text)], "file_id string, text string"))).collect()
    assert [r.description_rest for r in e] == [tail]
