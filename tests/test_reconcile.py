import pytest

from tallymark.operators import reconcile as R


@pytest.fixture
def run(spark):
    def go(opening, closing, amounts, **kw):
        b = spark.createDataFrame([("a", opening, closing)], "k string, opening long, closing long")
        t = spark.createDataFrame([("a", x) for x in amounts], "k string, amount_cents long")
        return R.reconcile(b, t, ["k"], **kw).collect()[0]

    return go


def test_balanced_and_tolerance(run):
    r = run(100000, 175525, [50000, 30000, -4475, 0])
    assert (r.reconciliation_status, r.balanced, r.expected_closing, r.deposit_count) == ("COMPLETE", True, 175525, 2)
    assert run(100, 111, [10]).reconciliation_status == "COMPLETE"
    bad = run(100, 112, [10])
    assert (bad.reconciliation_status, bad.difference) == ("FAILED", 2)
    assert bad.warnings == ["Balance reconciliation failed: difference of $0.02"]


def test_missing_and_suspicious(run):
    assert run(None, 5, [5]).reconciliation_status == "INCOMPLETE"
    assert run(5, None, [5]).difference == 0
    s = run(200000, 1, [200000])
    assert (s.reconciliation_status, s.opening_balance_known, s.opening_balance) == ("INCOMPLETE", False, 200000)
    assert s.warnings == ["Opening balance likely confused with large deposit"]
    assert run(100000, 200000, [100000]).reconciliation_status == "COMPLETE"


def test_infer(run):
    r = run(None, 150, [100, -20], infer_missing=True)
    assert (r.reconciliation_status, r.inferred_opening, r.error_codes) == ("PARTIAL", 70, ["OB_UNKNOWN"])
    r = run(70, None, [100, -20], infer_missing=True)
    assert (r.reconciliation_status, r.expected_closing, r.error_codes) == ("PARTIAL", 150, ["CB_UNKNOWN"])
    r = run(None, None, [1], infer_missing=True)
    assert (r.reconciliation_status, r.error_codes) == ("FAILED", ["OB_UNKNOWN", "CB_UNKNOWN", "RECON_FAILED"])


def test_no_transactions(spark):
    b = spark.createDataFrame([("a", 5, 5)], "k string, opening long, closing long")
    t = spark.createDataFrame([], "k string, amount_cents long")
    r = R.reconcile(b, t, ["k"]).collect()[0]
    assert (r.reconciliation_status, r.transaction_count) == ("COMPLETE", 0)


def test_comments(spark):
    b = spark.createDataFrame([("a", 80000, 90000)], "k string, opening long, closing long")
    t = spark.createDataFrame([("a", 20000), ("a", -7500)], "k string, amount_cents long")
    text = R.reconcile(b, t, ["k"]).select(R.balance_comments()).collect()[0][0].split("\n")
    assert text[:6] == [
        "#RECONCILIATION_STATUS: FAILED", "#OPENING_BALANCE: $800.00 (from statement)",
        "#CLOSING_BALANCE: $900.00 (from statement)", "#TOTAL_DEPOSITS: $200.00 (1 transactions)",
        "#TOTAL_WITHDRAWALS: $75.00", "#EXPECTED_CLOSING: $925.00",
    ]
    assert "#BALANCE_DIFFERENCE: $-25.00" in text
