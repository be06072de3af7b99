"""Exact copies, near copies, lines and components against plain versions."""

import hashlib
import random
import time
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import exact_dedup, line_dedup, near_dedup
from tallymark.llm.graph import components
from tallymark.llm.shared import CLEANUP, stored, written

from .conftest import LOWER, changed, joined, prose, shingles


def pandas_rows(df):
    return [tuple(r) for r in df.collect()]


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i + 1, i) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(pandas_rows(components(spark.createDataFrame(pairs, "a long, b long"))))
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_groups(spark, messy, no_rows):
    rows = [(r.doc_id, (r.text or "").translate(LOWER)) for r in messy.collect()]
    best, size = {}, Counter(t for _, t in rows)
    for i, t in rows:
        known = [j for j in (i, best.get(t)) if j is not None]
        best[t] = max(known) if known else None
    want = Counter((i, best[t], size[t], hashlib.sha256(t.encode()).digest()) for i, t in rows)
    got = exact_dedup.groups(messy).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.digest)) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(size) and all(r.doc_id == r.keep_id for r in kept)
    left = exact_dedup.deduplicate(messy)
    assert left.columns == messy.columns and left.count() == len(size)
    assert exact_dedup.groups(no_rows).count() == 0 and exact_dedup.deduplicate(no_rows).count() == 0


def test_exact_tree_over_many_runs(spark):
    df = spark.range(3000).selectExpr("id doc_id", "cast(id % 37 as string) text").repartition(23)
    got = exact_dedup.groups(df).groupBy("keep_id", "group_size").count().collect()
    assert len(got) == 37 and all(r["count"] == r.group_size for r in got)
    assert {r.keep_id for r in got} == set(range(2963, 3000))


def near_brute(texts, percent=85):
    sets = [shingles(t) for t in texts]
    links = [
        (a, b)
        for a, b in combinations(range(len(sets)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return sets, joined(len(texts), links)


def test_near_components(spark, messy, no_rows):
    rows = messy.collect()
    sets, root = near_brute([r.text for r in rows])
    least = {}
    for r, c in zip(rows, root):
        known = [i for i in (least.get(c), r.doc_id) if i is not None]
        least[c] = min(known) if known else None
    want = Counter((r.doc_id, len(s), least[c], r.doc_id == least[c]) for r, s, c in zip(rows, sets, root))
    got = near_dedup.near_duplicates(messy)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == want
    assert near_dedup.deduplicate(messy).columns == messy.columns
    assert near_dedup.near_duplicates(no_rows).count() == 0


def test_near_group_whose_members_are_not_all_linked(spark, monkeypatch):
    """Many different copies of one text around the threshold: stars, then blocks, find every component."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base = prose(5, 150)
    texts = [changed(base, i, 1 + i % 5) for i in range(60)] + [prose(100 + i, 60) for i in range(20)]
    _, root = near_brute(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == root


def test_sketches_estimate_the_similarity():
    rng = np.random.default_rng(1)
    for size in (3, 40, 5000):
        pool = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
        for share in (0.5, 0.9):
            both = int(size * share)
            a, b = pool[:size], np.concatenate([pool[:both], pool[size : 2 * size - both]])
            true = both / (2 * size - both)
            rows = near_dedup.sketches(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, size, 2 * size]))
            assert abs(near_dedup.estimate(rows[0], rows[1], size, size) - true) < 0.17


@pytest.mark.parametrize("text", ["", "   ", "\n\n"])
def test_empty_sets(text):
    hashes, offsets = near_dedup.shingle_sets([text, "a b"])
    assert offsets.tolist() == [0, 0, 1]
    assert near_dedup.sketches(hashes, offsets).shape == (2, near_dedup.REGISTERS)


def lines_brute(rows, k=12, least=0.8):
    first, every = {}, []
    for doc, (_, text) in enumerate(rows):
        for pos, line in enumerate((text or "").split("\n")):
            line = line.strip(" ").translate(LOWER)
            every.append((doc, pos, line))
            if line:
                first.setdefault(line, len(every) - 1)
    lines = sorted(first, key=first.get)
    sets = [{x[i : i + k] for i in range(max(1, len(x) - k + 1))} for x in lines]
    links = [
        (a, b)
        for a, b in combinations(range(len(lines)), 2)
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])
    ]
    root = joined(len(lines), links)
    keep = {line: first[lines[root[i]]] for i, line in enumerate(lines)}
    gone = {}
    for n, (doc, pos, line) in enumerate(every):
        if line and keep[line] != n:
            gone.setdefault(doc, []).append(pos)
    return [gone.get(i, []) for i in range(len(rows))]


def test_fuzzy_lines(spark, messy, no_rows):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    want = Counter((i, len((t or "").split("\n")), tuple(g)) for (i, t), g in zip(rows, lines_brute(rows)))
    one = messy.coalesce(1)
    got = line_dedup.deduplicate_lines(one).collect()
    assert Counter((r.doc_id, r.n_lines, tuple(r.removed)) for r in got) == want
    assert all(r.n_kept == r.n_lines - len(r.removed) for r in got)
    clean = line_dedup.cleaned(one)
    assert clean.columns == messy.columns and clean.count() == len(rows)
    assert line_dedup.deduplicate_lines(no_rows).count() == 0


def test_fuzzy_lines_of_one_family(spark):
    base = prose(9, 60)
    texts = ["\n".join([changed(base, i, 1 + i % 4), prose(50 + i, 12), "same line"]) for i in range(25)]
    rows = list(enumerate(texts))
    got = line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {r.doc_id: list(r.removed) for r in got} == dict(enumerate(lines_brute(rows)))


def test_pairs_of_a_large_bucket(spark):
    """3,000 lines with one beginning, all in one bucket: no similar pair is lost, few others are formed."""
    start = "transfer received from the account with number "
    lines = [start + "".join(random.Random(i // 3).choices("0123456789", k=40)) + "xyz"[i % 3] * (1 + i % 2) for i in range(3000)]
    known = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "occurrence long, line string")
    got = {tuple(r) for r in line_dedup.across(known.selectExpr("7L key", "occurrence", "occurrence root"), known, 0.8).collect()}
    near = {(i + a, i + b) for i in range(0, 3000, 3) for a, b in ((0, 1), (0, 2), (1, 2))}
    assert near <= got and len(got) < 0.02 * 3000 * 2999 / 2
    links = {tuple(r) for r in line_dedup.verified(spark.createDataFrame(sorted(got), "a long, b long"), known, 0.8).collect()}
    assert links == near


def test_lines_of_one_passage_do_not_give_all_pairs(spark):
    """30 lines of one bucket that share a passage, at 0.5 to 0.8 of each other, and a copy of the first: one pair."""
    passage = prose(7, 60)
    lines = [f"{prose(300 + i, 12)} {passage} {prose(400 + i, 12)}" for i in range(30)]
    lines.append(lines[0] + " x")
    known = spark.createDataFrame(list(enumerate(lines)), "occurrence long, line string")
    still = known.selectExpr("7L key", "occurrence", "occurrence root")
    assert {tuple(r) for r in line_dedup.across(still, known, 0.8).collect()} == {(0, 30)}


def test_fuzzy_lines_run_no_python(spark, messy, monkeypatch):
    plans = []

    def keep(df, *rest):
        plans.append(df._jdf.queryExecution().toString())
        return stored(df, *rest)

    monkeypatch.setattr(line_dedup, "stored", keep)
    plans.append(line_dedup.deduplicate_lines(messy)._jdf.queryExecution().toString())
    assert len(plans) > 5 and not any(x in p for p in plans for x in ("InArrow", "InPandas", "EvalPython"))


def test_lines_of_few_different_shingles(spark):
    """Lines of many shingles, most of which repeat: no hash of some is small enough to be looked at."""
    rows = []
    for i in range(6):
        unit = prose(500 + i, 3) + " "
        rows += [(3 * i + j, unit * n) for j, n in enumerate((20, 90, 900))]
    want = dict(enumerate(lines_brute(rows)))
    assert sum(map(len, want.values())) == 12
    assert removed_lines(spark, rows) == want


def removed_lines(spark, rows):
    got = line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    return {r.doc_id: list(r.removed) for r in got}


def family_lines():
    """Rows of lines of one beginning, some near copies of each other, some only alike, and a few lines on their own."""
    base = prose(9, 60)
    texts = ["\n".join([changed(base, i, 2 + i % 9), prose(50 + i, 12)]) for i in range(24)]
    return list(enumerate(texts))


def test_small_groups_are_compared_without_their_rarest_shingles(spark, monkeypatch):
    """Lines of a key with few pairs are compared as they are; no join on all their shingles is made."""

    def never(*args):
        raise AssertionError("joined on shingles")

    monkeypatch.setattr(line_dedup, "across", never)
    rows = family_lines()
    assert removed_lines(spark, rows) == dict(enumerate(lines_brute(rows)))


def test_large_groups_meet_by_their_rarest_shingles(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST", 0)
    monkeypatch.setattr(line_dedup, "PARTS", 2)
    rows = family_lines()
    assert removed_lines(spark, rows) == dict(enumerate(lines_brute(rows)))


def test_sifted_pairs_lose_none_that_is_similar(spark):
    """Of lines with edits, repeats and letters beyond ASCII only pairs far below the threshold are left out."""
    lines = []
    for i in range(8):
        base = prose(700 + i, 40)
        plain = base.translate({233: "e", 252: "u"})
        phrase = f"{plain[:50]} "
        lines += [base, changed(base, i, 1), changed(base, i, 3), plain, changed(plain, i, 1), changed(plain, i, 2)]
        lines += [phrase * 3, phrase * 40, f"{phrase * 9}{plain}", plain[:11], ""]
    lines.append("é" + prose(700, 40).translate({233: "e", 252: "u"}))
    known = spark.createDataFrame(list(enumerate(lines)), "occurrence long, line string")
    pairs = list(combinations(range(len(lines)), 2))
    every = spark.createDataFrame(pairs, "a long, b long")
    got = {tuple(r) for r in line_dedup.sifted(every, line_dedup.bitmaps(known), 0.8).collect()}
    sets = [{t[i : i + 12] for i in range(max(1, len(t) - 11))} for t in lines]
    near = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(near) > 30 and near <= got
    one_kind = {(a, b) for a, b in pairs if lines[a].isascii() == lines[b].isascii()}
    assert len(got & one_kind) < 0.2 * len(one_kind)
    assert {tuple(r) for r in line_dedup.verified(spark.createDataFrame(sorted(got), "a long, b long"), known, 0.8).collect()} == near


def test_lines_of_two_are_not_looked_up_again(spark):
    """Keys that two lines share are pairs already; only the lines of other keys are listed."""
    bases = [prose(800 + i, 60) for i in range(6)]
    lines = [t for b in bases[:4] for t in (b, b + " x")] + [bases[4], bases[4] + " y", bases[4] + " z", bases[5]]
    known = spark.createDataFrame(list(enumerate(lines)), "occurrence long, line string")
    two, members = line_dedup.candidates(known)
    pairs = {tuple(r) for r in two.distinct().collect()}
    assert {(0, 1), (2, 3), (4, 5), (6, 7)} <= pairs
    assert {(r.occurrence, r["first"]) for r in members.collect()} == {(8, 8), (9, 8), (10, 8)}


def test_fuzzy_lines_of_repeated_phrases(spark):
    rows = []
    for i in range(4):
        phrases = [prose(100 + 3 * i + j, 4) for j in range(3)]
        rows += [(2 * i + j, " ".join(f"{p} " * n for p in phrases)) for j, n in enumerate((300, 40))]
    want = dict(enumerate(lines_brute(rows)))
    assert sum(map(len, want.values())) == 4
    assert removed_lines(spark, rows) == want


def test_fuzzy_lines_of_long_letter_runs(spark):
    rows = []
    for i in range(4):
        run = "".join(random.Random(i).choices("acgt", k=600))
        rows += [(3 * i, run), (3 * i + 1, "x" + run), (3 * i + 2, run[:5] + "x" + run[6:])]
    want = dict(enumerate(lines_brute(rows)))
    assert sum(map(len, want.values())) == 8
    assert removed_lines(spark, rows) == want


def test_long_words_that_a_polynomial_hash_takes_for_equal(spark):
    rows = []
    for n in (256, 1024, 4096):
        word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        other = word.translate({97: 98, 98: 97})
        rows += [(n, word), (n + 1, other), (n + 2, f"{word} one two three four five"), (n + 3, f"{other} one two three four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.kept and r.component_id == r.doc_id for r in near_dedup.near_duplicates(docs).collect())
    assert near_dedup.reaches([rows[0][1]] * 2, 85, 5) and not near_dedup.reaches([rows[0][1], rows[1][1]], 85, 5)


def test_pairs_just_above_eighty_percent(spark):
    """Texts of 105 distinct shingles each that share 94 of 116 (0.81), and of 94 against 92 of 118 (0.78)."""
    rows = []
    for i in range(12):
        words = prose(1000 + i, 400).split()
        words = list(dict.fromkeys(words))[:109]
        assert len(words) == 109
        near, far = [*words[:98], *(f"y{i}x{j}" for j in range(11))], [*words[:96], *(f"z{i}x{j}" for j in range(13))]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
    texts = [t for _, t in rows]
    a, b, c = (shingles(t) for t in texts[:3])
    assert (len(a & b), len(a | b)) == (94, 116) and 100 * len(a & c) < 80 * len(a | c)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, root = near_brute(texts, 80)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, percent=80).collect()}
    assert got == dict(enumerate(root)) and got[1] == 0


def test_only_lines_that_share_a_band_are_looked_up(spark, monkeypatch):
    """The texts of lines without a neighbour in any band go to no comparison."""
    kept = {}

    def keep(df, name, *args):
        kept.setdefault(name, stored(df, name, *args))
        return kept[name]

    monkeypatch.setattr(line_dedup, "stored", keep)
    base = prose(3, 60)
    rows = [(0, base), (1, changed(base, 1, 1)), *((i, prose(100 + i, 40)) for i in range(2, 40))]
    got = removed_lines(spark, rows)
    assert [i for i, gone in sorted(got.items()) if gone] == [1]
    assert kept["line-signatures"].count() == 40
    assert 2 <= kept["line-banded"].count() < 10


def test_shuffle_files_of_a_written_table_go(spark):
    """What a write shuffled is deleted with its end, whether or not the driver collects garbage."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    before, setting = files(), spark.conf.get(CLEANUP)
    rows = spark.range(20000).groupBy((F.col("id") % 7000).alias("k")).agg(F.count("*").alias("n"))
    found, _ = written(rows, "few")
    for _ in range(40):
        left = files() - before
        if not left:
            break
        time.sleep(0.25)
    assert not left and spark.conf.get(CLEANUP) == setting
    assert found.count() == 7000
