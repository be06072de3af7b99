import pytest
from pyspark.sql import functions as F

from tallymark.functions import predicates as P
from tallymark.functions import scalars as S
from tallymark.operators import accounts as A


@pytest.mark.parametrize(
    "value,loose,strict",
    [
        (None, False, False), ("", False, False), ("***123", True, False), ("***12", False, False),
        ("12-345-6", True, True), ("1-2", False, False), ("12345678", True, True), ("0000", False, False),
        ("1234", True, False), ("unknown", False, False), ("AB12_34", True, True), ("12.34", False, False),
        ("XX12", False, False), ("#1234", True, False),
    ],
)
def test_validity(column, value, loose, strict):
    assert column(P.is_valid_account("s"), [value]) == [loose]
    assert column(P.is_valid_account_strict("s"), [value]) == [strict]


def test_routing(column):
    assert column(P.is_valid_routing("s"), ["110001119", "110001110", "111111111", "12", None]) == [
        True, False, False, False, False,
    ]


def test_labeled_stages(column):
    cases = {
        "Account Number: 000123456": "000123456",
        "ACCOUNT # : 44-628-4": "44-628-4",
        "acct # xxxx9876 and account number: 1234567": "XXXX9876",
        "Savings Account Number\nRiver Road\n555666777 Joint": "555666777",
        "Account number 111111\nnothing": None,
        "card ending in 4321": "XXXXXX4321",
        "**** 8765": "XXXXXX8765",
        "no label 123456789": None,
    }
    assert column(A.labeled_account("s"), list(cases)) == list(cases.values())


def test_line_shapes(column):
    cases = {
        "Top\nACCOUNT\nNo 50-550-1 x": "50-550-1",
        "ACCOUNT\nabc 12345": "12345",
        "code XXX45": "***45",
        "ending with: ***77": "***77",
        "your account: 12-34": "12-34",
        "main account 9a8765": None,
        "the account\n***55": "***55",
        "the account\nref 4455 66": "4455",
        "accounts 12345": None,
    }
    assert column(A.account_from_lines("s"), list(cases)) == list(cases.values())


def test_header_lines_are_a_parameter(column):
    at = lambda n: "\n" * (n - 2) + "ACCOUNT\nno 12-345"  # noqa: E731  label in line n - 1, number in line n
    texts = [at(30), at(31), at(400)]
    assert column(A.account_from_lines("s"), texts) == ["12-345", None, None]
    assert column(A.account_from_lines("s", header_lines=31), texts) == ["12-345", "12-345", None]
    assert column(A.account_from_lines("s", header_lines=None), texts) == ["12-345"] * 3


def test_regex_cascade(column):
    cases = {
        "account: ***12345 ok": "***12345",
        "last 8005": None,
        "last 4761": "XXXXXX4761",
        "acct 1234567 and abcd12345678": "1234567",
        "account AB-12345 x": "AB12345",
        "a/c 1111 x": "XXXXXX1111",
    }
    assert column(A.regex_account("s"), list(cases)) == list(cases.values())
    assert column(A.regex_account_v0("s"), ["account 4321 x", "account *4321 x", "nothing"]) == ["*4321", "*4321", None]


def test_cascade_falls_back_to_fields(spark):
    df = spark.createDataFrame(
        [
            ("Account Number: 000123456", "999999", None),
            ("nothing", "99 99-99 12".replace("-", ""), None),
            ("nothing", "12", {"Account": ("55-0001", 0.9), "City": ("123456", 0.9)}),
            ("nothing", "12", {"City": ("123456", 0.9)}),
        ],
        "text string, model string, f map<string,struct<content:string,confidence:double>>",
    )
    got = [r[0] for r in df.select(A.account_cascade("text", "model", "f")).collect()]
    assert got == ["000123456", "99999912", "55-0001", None]


def test_reports(texts):
    docs = texts("call 123456 or 123456, XXXX1234\nref AB#12345 HU1279 000000")
    got = {(r["class"], r.token, r.n) for r in A.account_frequency(docs).collect()}
    assert got == {
        ("numeric", "123456", 2), ("masked", "XXXX1234", 1), ("reference", "AB#12345", 1), ("reference", "HU1279", 1),
        ("reference", "XXXX1234", 1),
    }
    scan = {(r.line_no, r.kind, r.number) for r in A.account_scan(texts("x\nAcct no. 7788 ending 4321")).collect()}
    assert scan == {(2, "labelled", "7788"), (2, "labelled", "4321"), (2, "partial", "4321")}


def test_scalars(column):
    assert column(S.int_cents("s"), ["-12.50", "100", "12.5", "1,234.56", "n/a"]) == ["-1250", "100", "1250", "123456", ""]
    assert column(S.int_cents("s", legacy=True), ["-12.50", "100", "12.5"]) == ["1250", "100", "125"]
    assert column(S.sanitize("s"), ["a/b\tc  é d "]) == ["a-b c d"]
    assert column(F.array_join(S.sanitize_reasons("s"), ";"), ["a/b\té"]) == [
        "replace slash with dash;remove control chars;non-ascii -> space"
    ]
    assert column(S.mask_digits("s"), ["XX12", "12a"]) == ["12", "12a"]
    assert column(S.int_cents("s"), ["12\n", "-.5", "5.", "$-7.005", ".", "-"]) == ["12", "-50", "5", "-701", "", ""]
    assert column(S.sanitize("s"), ["a b", " a", "a  b", "\x00", None]) == ["a b", "a", "a b", "", ""]
    assert column(F.size(S.sanitize_reasons("s")), ["a b", "\x7f", "", None]) == [0, 1, 0, 0]
    assert column(P.is_yymmdd("s"), ["000229", "010229", "251131", "251130", "250630\n", None]) == [True, False, False, True, False, False]
    assert "try_to_timestamp" not in str(P.is_yymmdd("s")).lower()
    assert column(P.is_yymmdd("s"), ["250229", "240229", "25063", "751231"]) == [False, True, False, True]


def test_account_numbers_are_unicode_bounded(column):
    assert column(F.array_join(A.number_candidates("s"), ","), ["é1234567 1234567, 12345 (7654321)"]) == ["1234567,7654321"]
