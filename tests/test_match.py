import difflib
import itertools
import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from tallymark.operators import match as M
from tallymark.operators import registry as G

REG = [
    (1, "Harbor Bank", "0001234567", "110000001"),
    (2, "Mesa Community Bank", "0007654567", "110000002"),
    (3, "Harbor Bank & Trust", "55501", "110000003"),
    (4, "Lake Federal Credit Union", "99001234", "110000004"),
    (5, "Harbor Bank", "0001234567", "110000005"),
]


@pytest.fixture
def reg(spark):
    return spark.createDataFrame(REG, "ordinal long, bank_name string, account_number string, routing_number string")


def docs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id int, account string, bank_name string")


def test_match_types(spark, reg):
    d = docs(
        spark,
        ("0001234567", None), ("1234567", None), ("XXXXXX4567", "Harbor Bank"), ("XXXXXX4567", "Zzz Qqq"),
        ("XXXXXX4567", None), ("***01", None), ("***99", "x"), ("*5501", None), ("000", None), ("XXXXXX9999", "x"),
        (None, None), ("***1", None),
    )
    got = {r.doc_id: (r.match_type, r.matched_ordinal) for r in M.match_account(d, reg).collect()}
    assert got == {
        0: ("exact", 1), 1: ("normalized", 1), 2: ("partial_disambiguated", 1),
        3: ("multiple_accounts_low_similarity", None), 4: ("multiple_accounts_no_bank_name", None),
        5: ("masked_single", 3), 6: ("no_account_match", None), 7: ("legacy_partial", 3), 8: ("none", None),
        9: ("none", None), 10: ("no_account", None), 11: ("none", None),
    }


def test_earlier_suffix_beats_later_equal(spark):
    reg = spark.createDataFrame(
        [(1, "A", "9912345", "r1"), (2, "B", "12345", "r2")],
        "ordinal long, bank_name string, account_number string, routing_number string",
    )
    r = M.match_account(docs(spark, ("12345", None)), reg).collect()[0]
    assert (r.match_type, r.matched_ordinal) == ("legacy_partial", 1)


def test_status_and_candidates(spark, reg):
    m = M.match_account(docs(spark, ("XXXXXX4567", None), ("***99", "x"), ("55501", "y")), reg)
    s = {r.doc_id: r.status for r in M.match_status(m).collect()}
    assert s == {0: "multiple_accounts_no_bank_name", 1: "error", 2: "own_account"}
    rows = M.candidate_rows(m, reg).collect()
    assert sorted(r.ordinal for r in rows) == [1, 2, 5]
    d = M.candidate_details(m, reg).collect()[0]
    assert (d.ending_digits, d.candidate_count, d.candidate_banks) == ("4567", 3, 2)


def test_routing(spark, reg):
    d = docs(
        spark, ("xx4567", "Mesa Comunity Bank"), ("xx4567", "Qq"), ("0007654567", "Harbor"), ("501", "Harbor"),
        ("0007654567", None), ("01", "Harbor"),
    )
    got = {r.doc_id: (r.routing_stage, r.matched_ordinal) for r in M.match_routing(d, reg).collect()}
    assert got == {
        0: ("masked_best_name", 2), 1: ("masked_first", 1), 2: ("exact", 2), 3: ("suffix_first", 3), 4: (None, None),
        5: (None, None),
    }


def test_account_first(spark, reg):
    d = docs(spark, ("0007654567", "x"), ("4567", "Mesa Community Bank"), ("777", "Lake Federal Credit Unions"), ("777", None))
    got = {r.doc_id: (r.match_type, r.matched_ordinal, r.resolved_account) for r in M.match_account_first(d, reg).collect()}
    assert got == {
        0: ("exact_account_match", 2, "0007654567"), 1: ("partial_account_match", 2, "0007654567"),
        2: ("customer_statement", 4, "777"), 3: ("no_match", None, None),
    }


def test_name_pairs_lose_nothing(spark):
    """The prefix join against all pairs, on random names."""
    rnd = random.Random(7)
    words = ["HARBOR", "MESA", "LAKE", "BANK", "TRUST", "FCU", "CITY", "OF", "STATE", "A", "ZQ"]
    make = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
    left = sorted({make() for _ in range(120)})
    right = sorted({make() for _ in range(80)})
    for t in (0.7, 0.8):
        want = {
            (a, b) for a, b in itertools.product(left, right) if difflib.SequenceMatcher(None, a, b).ratio() >= t
        }
        frame = lambda v: spark.createDataFrame([(x,) for x in v], "norm string")
        got = {(r.a_norm, r.b_norm) for r in M.similar_name_pairs(frame(left), frame(right), t).collect()}
        assert got == want and want


def invented_names(seed, n):
    """Names of invented places and kinds, as a registry of thousands of banks has them."""
    rnd = random.Random(seed)
    parts = ["BAR", "MES", "LAK", "COL", "TUR", "VIN", "POR", "HEL", "GRA", "DON", "SIL", "KEN", "WOO", "FER", "ZAN", "QUI",
             "OAK", "RIV", "ELM", "ASH", "TON", "VILLE", "FIELD", "BURG", "MONT", "LAND", "HAM", "PORT", "É", "9"]
    kinds = ["BANK", "TRUST", "FCU", "STATE", "SAVINGS", "NATIONAL", "FIRST", "CITY", "COMMUNITY", "OF"]
    out = set()
    while len(out) < n:
        words = ["".join(rnd.choices(parts, k=rnd.randint(1, 3))) for _ in range(rnd.randint(1, 2))]
        words += rnd.sample(kinds, rnd.randint(0, 2))
        rnd.shuffle(words)
        out.add(" ".join(words))
    return sorted(out)


def test_candidates_of_thousands_of_names(spark):
    """Equal to all pairs on 2,000 x 2,000 names, with under a tenth of the pairs formed."""
    left, right = invented_names(1, 2000), invented_names(2, 1990) + ["", "A", "AB", "A" * 60, "AB" * 40, "X Y", "Z", "QQ", "BA", "É"]
    signs = sorted({c for n in left + right for c in n})
    counts = [np.array([[n.count(c) for c in signs] for n in names]) for names in (left, right)]
    common = sum(np.minimum.outer(counts[0][:, k], counts[1][:, k]) for k in range(len(signs)))
    total = np.add.outer(counts[0].sum(1), counts[1].sum(1))
    want = set()
    for i, j in zip(*np.nonzero(2 * common >= 0.7 * total)):
        if total[i, j] and difflib.SequenceMatcher(None, left[i], right[j]).ratio() >= 0.7:
            want.add((left[i], right[j]))
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "norm string")
    formed = M.name_candidates(frame(left), frame(right), 0.7).collect()
    assert len(formed) < len(left) * len(right) / 10
    assert want <= {(r.a_norm, r.b_norm) for r in formed} | {(n, n) for n in left}
    best = {}
    for a, b in want:
        best[a] = max(best.get(a, 0), difflib.SequenceMatcher(None, a, b).ratio())
    got = {}
    for r in M.best_name_pairs(frame(left), frame(right), 0.7).collect():
        got[r.a_norm] = max(got.get(r.a_norm, 0), r.similarity)
    assert got == best


def test_hot_lookup_stays_one_lookup(spark, reg):
    d = spark.range(20000).select(
        F.col("id").cast("int").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "XXXXXX4567").otherwise(F.concat(F.col("id").cast("string"), F.lit("98"))).alias("account"),
        F.lit("Harbor Bank").alias("bank_name"),
    )
    m = M.match_account(d, reg)
    assert m.count() == 20000
    assert m.where("matched_ordinal = 1").count() == 6667
    assert M.lookups(d).count() == 13334


def test_registry_sets(spark, reg):
    nums = spark.createDataFrame([("55501",), ("1",)], "number string")
    assert [r.number for r in G.known_accounts(nums, reg).collect()] == ["55501"]
    assert [r.number for r in G.known_accounts(nums, reg, known=False).collect()] == ["1"]
    b = reg.where("ordinal > 1").withColumn("bank_name", F.upper("bank_name"))
    kinds = {r.account_number: r.diff for r in G.diff_registry(reg.where("ordinal < 4"), b).collect()}
    assert kinds == {"0001234567": "changed", "0007654567": "changed", "55501": "changed", "99001234": "only_b"}
    p = {r.column: (r.non_null, r.nulls) for r in G.profile(reg).collect()}
    assert p["ordinal"] == (5, 0)


def test_rank(spark, reg):
    r = M.rank_similarity(reg, "harbor bank").collect()
    assert [x.ordinal for x in r[:2]] == [1, 5] and r[0].score == 100.0 and r[0].similar


def test_description_against_plain_counts(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 60), rnd.choice(["x", "x", "y", None]), rnd.gauss(0, 1), i % 2 == 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, s string, x double, b boolean").withColumn("a", F.array("k"))
    got = {r.column: r for r in G.describe(df).collect()}
    assert set(got) == {"k", "s", "x", "b"}
    k = sorted(r[0] for r in rows)
    mode = max(set(k), key=lambda v: (k.count(v), 0))
    assert int(got["k"].freq) == k.count(mode) and k.count(int(got["k"].top)) == k.count(mode) and got["k"].freq_error == 0
    assert [int(got["k"][q]) for q in ("q1", "median", "q3")] == [k[749], k[1499], k[2249]]
    assert abs(got["k"].unique - 61) <= 4 and (got["s"].top, got["s"].freq) == ("x", sum(r[1] == "x" for r in rows))
    assert got["s"].nulls == sum(r[1] is None for r in rows) and got["s"].mean is None
    x = np.array([r[2] for r in rows])
    assert abs(got["x"]["std"] - x.std(ddof=1)) < 1e-9 and abs(got["x"].unique - 3000) < 300
    assert got["x"].top is None and got["x"].freq_error == 11
    empty = {r.column: (r.non_null, r.unique, r.top, r.median) for r in G.describe(df.where("false")).collect()}
    assert empty["k"] == (0, 0, None, None)


def test_name_changes_and_two_way_difference(spark, reg):
    other = reg.withColumn("bank_name", F.when(F.col("ordinal") == 2, "Mesa Comunity Bank").otherwise(F.col("bank_name")))
    other = other.where("ordinal < 5").union(other.where("ordinal = 1"))
    d = G.name_changes(G.diff_registry(reg.where("ordinal <> 5"), other.where("ordinal <> 1"), columns=("bank_name",)))
    got = {r.account_number: (r.diff, r.name_similarity) for r in d.collect()}
    want = difflib.SequenceMatcher(None, "mesa community bank", "mesa comunity bank").ratio()
    assert got["0007654567"] == ("changed", want) and got["55501"] == ("equal", None) and got["0001234567"] == ("only_a", None)
    rows = [(r.ordinal, r.side) for r in G.two_way_difference(reg, other).collect()]
    assert sorted(rows) == [(1, "b"), (2, "a"), (2, "b"), (5, "a")]
