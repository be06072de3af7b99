import random
import re

import pytest

CLASHES = "row long, digest string, key string, bin int, block int, line string, keep_id long, root string, __row long"
NAMES = [c.split()[0] for c in CLASHES.split(", ")]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, n):
    rng = random.Random(seed)
    syllables = ["an", "ther", "in", "ou", "ble", "tion", "ed", "wh", "st", "é", "ün"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


def changed(text, seed, edits):
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns with other uses' names."""
    long = prose(1, 6000)
    near = prose(2, 120)
    rows = [
        (1, "The Quick brown fox, it's\n\n  here\tand THERE"),
        (2, "the quick brown fox, it's\n\n  here\tand there"),
        (3, None),
        (4, ""),
        (5, "   \n\t "),
        (6, long),
        (7, long.upper()),
        (8, near),
        (8, near),
        (9, changed(near, 1, 2)),
        (10, changed(near, 2, 3)),
        (None, "no identifier"),
        (None, "no identifier"),
        (11, "É Ü é ü 漢字 ½ 12345 'S don't we'll"),
        (12, "one two"),
        (13, "ONE two"),
        (14, "<|endoftext|> x"),
        (-5, near + "\n" + near),
        (15, "a"),
    ]
    data = [(i, t, "en" if i != 11 else None, "s", 0, *[None] * len(NAMES)) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHES
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def no_rows(messy):
    return messy.where("false")


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def joined(n, links):
    """Component (smallest index) of each of n items."""
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return [top(i) for i in range(n)]
