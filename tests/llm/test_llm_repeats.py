"""Repeated spans against all windows of all texts."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tallymark.llm import repeated_spans, spans
from tallymark.llm.shared import table

from .conftest import prose


def plain(rows, length=35):
    """Contract rows and removed spans by a dictionary of all windows."""
    texts = [re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rows]
    seen = Counter(tuple(w[i : i + length]) for w in texts for i in range(len(w) - length + 1))
    out, spans = [], []
    for r, w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r.doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
        edges = [i for i in range(len(w) + 1) if (i in gone) != (i - 1 in gone)]
        spans.append((r.doc_id, tuple(zip(edges[::2], edges[1::2]))))
    return Counter(out), Counter(spans)


def check(df, **options):
    want, spans = plain(df.collect(), options.get("length", 35))
    got = repeated_spans.digests(df, **options)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want
    rows = repeated_spans.remove_repeats(df, **options).collect()
    assert Counter((r.doc_id, tuple((s.start, s.end) for s in r.spans)) for r in rows) == spans


def test_messy_and_empty_tables(messy, no_rows):
    check(messy)
    check(messy, length=8, gram=4)
    assert repeated_spans.digests(no_rows).count() == 0


def test_given_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    check(docs)
    check(docs, length=12, gram=5)


@pytest.mark.parametrize("few", [2, 3, 12])
def test_few_words_ties_and_overlapping_repeats(spark, monkeypatch, few):
    """Texts over a handful of words repeat themselves and each other at every offset."""
    rng = random.Random(few)
    passages = [prose(i, 60).split() for i in range(3)]
    rows = []
    for i in range(60):
        words = [rng.choice("abcdefghijkl"[:few]) for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            words = ["z"] * rng.randint(30, 80) + words
        for p in passages:
            if rng.random() < 0.5:
                cut = p[rng.randint(0, 20) : rng.randint(40, 60)]
                at = rng.randint(0, len(words))
                words[at:at] = cut
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    monkeypatch.setattr(repeated_spans, "BLOCK", 3000)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_edges_extend_word_by_word(spark):
    """Passages that agree on different stretches around one anchor, in pairs that no third row shares."""
    base = prose(5, 90).split()
    rows = []
    for i in range(40):
        a, b = i % 30, 50 + i
        rows.append((i, " ".join([f"l{i}", *base[a:b], f"r{i}"])))
    rows += [(100, " ".join(base[20:54])), (101, " ".join(base[20:55])), (102, " ".join(base[:35]))]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_long_words_that_a_polynomial_hash_takes_for_equal(spark):
    sign = lambda n: "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    rows = []
    for n in (256, 1024, 4096):
        one = sign(n)
        two = one.translate({97: 98, 98: 97})
        words = prose(n, 40).split()
        rows += [(n, " ".join(words[:20] + [one] + words[20:])), (n + 1, " ".join(words[:20] + [two] + words[20:]))]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_words_are_hashed_in_slices(monkeypatch):
    """A large block gets the hashes of its texts and takes no table of powers of its own size."""
    asked = []
    powers = spans._powers
    monkeypatch.setattr(spans, "_powers", lambda bits, base: asked.append(bits) or powers(bits, base))
    texts = [prose(i, 3000).encode() for i in range(40)] + [b"", b"  ", b"x" * 70000 + b" y"]
    sliced = repeated_spans.Words(texts)
    assert sum(map(len, texts)) > 10 * repeated_spans.SLICE
    assert max(asked[:4]) <= 16 and sum(bits > 16 for bits in asked) <= 4  # only the long word
    monkeypatch.setattr(repeated_spans, "SLICE", 1 << 40)
    whole = repeated_spans.Words(texts)
    assert whole.texts.tolist() == sliced.texts.tolist()
    for lane in (0, 1):
        assert whole.hashes[lane].tolist() == sliced.hashes[lane].tolist()
