"""Vector codes against plain integer k-means."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallymark.llm import vector_codes

from .conftest import CLASHES, NAMES


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Contract rows by loops over Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return Counter()
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(scale * x) for x in r[1]] for r in kept]
    width = len(whole[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, book: min(range(len(book)), key=lambda k: (far(v, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for v in cut:
                groups[near(v[p], books[p])].append(v[p])
            books[p] = [
                tuple(sum(c) // len(groups[k]) for c in zip(*groups[k])) if k in groups else e
                for k, e in enumerate(books[p])
            ]
    codes = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    errors = [sum(far(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(cut, codes)]
    by_label = Counter()
    for r, e in zip(kept, errors):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter(
        (r[0], "".join(f"{k:02x}" for k in c), e, by_label[r[2]], sha) for r, c, e in zip(kept, codes, errors)
    )


def check(spark, rows, **options):
    df = spark.createDataFrame(
        [(*r, *[None] * len(NAMES)) for r in rows], "vec_id long, embedding array<float>, label int, " + CLASHES
    )
    got = vector_codes.digests(df.repartition(3), **options)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = plain([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows])
    assert Counter(tuple(r) for r in got.collect()) == want


def test_codes_of_clusters_ties_and_odd_rows(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], rng.choice([1, 1, 2, None])) for i in range(700)]
    rows += [(i, rows[0][1], 1) for i in range(700, 900)] + [rows[3], rows[3]]
    rows += [(i, [rng.choice([-1, 0, 1]) / 4096 for _ in range(16)], 3) for i in range(900, 1100)]
    rows += [(1200, None, 1), (1201, [None] * 16, 1), (1202, [float("nan")] * 16, 2), (1203, [float("inf")] + [0.0] * 15, 2)]
    rows += [(None, centres[0], None), (None, centres[1], 5), (-4, centres[2], 2), (1300, [0.0] * 16, 4)]
    check(spark, rows)


def test_few_and_no_vectors(spark):
    check(spark, [(i, [i / 7 + j for j in range(8)], 1) for i in range(5)])
    check(spark, [(7, [0.5] * 8, None)])
    check(spark, [])
    check(spark, [(1, None, 1)])


def test_other_lengths_have_no_code_and_odd_lengths_are_filled_up(spark):
    rows = [(i, [float(i % 5), 1.0, -1.0], 1) for i in range(40)] + [(99, [1.0], 1), (98, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vector_codes.digests(df).collect()}
    assert got[99].code is None and got[99].error is None and got[98].code is None
    assert sum(r.code is not None for r in got.values()) == 40 and got[0].label_error == sum(
        r.error for r in got.values() if r.error is not None
    )


@pytest.mark.parametrize("b", [1, 3, 15])
def test_bounds_keep_the_nearest_entry_through_any_moves(b):
    rng = np.random.default_rng(b)
    x = rng.integers(-50, 50, (500, 4))
    book = rng.integers(-50, 50, (16, 4))
    state = vector_codes.Bounds.fresh(x, book, b)
    for turn in range(12):
        new = book + rng.integers(-3, 4, book.shape) * (rng.random((16, 1)) < 0.5)
        state.moved(np.sqrt(((new - book) ** 2).sum(1)) * (1 + 1e-6))
        book = new
        if turn == 6:
            b = max(1, b // 2)
            state = state.narrowed(b)
        needed = state.assign(x, book)
        dist = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (state.near[:, 0] == dist.argmin(1)).all() and needed.sum() <= len(x)
        others = np.sqrt(np.delete(np.sort(dist, 1), 0, 1))
        assert (state.upper >= np.sqrt(dist.min(1))).all() and (state.lower.min(1) <= others[:, 0]).all()


def test_sure_parts_are_not_measured():
    x = np.concatenate([np.full((50, 2), 0), np.full((50, 2), 1000)])
    book = np.array([[0, 0], [1000, 1000], [500, 0]])
    state = vector_codes.Bounds.fresh(x, book, 1)
    state.moved(np.array([1.0, 1.0, 1.0]))
    assert state.assign(x, book + 1).sum() == 0
