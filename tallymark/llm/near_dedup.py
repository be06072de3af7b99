"""Near-duplicate documents by HyperMinHash.

A document's set holds its distinct shingles of ``words`` words (A-Z lower-cased, words split at
ASCII white space); with fewer words, the whole sequence is the one shingle. Shingles are hashed
twice (128 bits) where links are confirmed and where few of them make a set, else once.

1. One pass over the texts: digest of the set, its size, and ``REGISTERS`` registers. A shingle falls
   into a bucket; the bucket keeps its smallest hash as a count of leading zeros and the next ten
   bits. Buckets that stay empty are filled by further rounds with fresh hashes, so small sets have
   full sketches too. Equal sets are one class from here on, however many copies there are.
2. Bands of as many registers as miss a pair at the threshold in at most one of 100,000 cases (seven at
   0.85, about one in a million; six at 0.80, about three): classes with an equal band are candidates.
3. Candidates pass an estimate of the similarity, corrected for registers that agree by chance, with
   five standard errors of slack, and are then verified on the full sets of their texts.
4. A band's bucket is first compared with one class only, so a large group costs one pair per
   member. Verified links are joined to components; buckets that still hold several components take
   another class in the next of ``STARS`` rounds. What then remains in different components is compared
   in full, block by block: each task holds two blocks of ``BLOCK`` classes and returns at most the
   links that join their components. Blocks of one component are left out. So no link between
   components is lost, and no pairs of a group are written out.
5. Components of all links by distributed union-find; every row gets the smallest identifier.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; rows
that repeat an identifier are rows of their own; a null identifier takes its component's smallest
known one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.graph import components
from tallymark.llm.shared import chunks, stored, without_rows
from tallymark.llm.spans import mix, span_hashes, utf8

REGISTERS, MANTISSA = 256, 10
MISS = 1e-5
FEW = 8
ROUNDS = 24
STARS = 2
BLOCK = 128
CHUNK = 400_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@cache
def _byte_table() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return lower, space


def shingle_sets(texts: list[str], words: int = 5, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, joined; and their offsets. ``lane`` picks one
    of two independent hashes of words."""
    lower, space = _byte_table()
    units, text_starts = utf8(texts)
    blank = space[units]
    before = np.ones_like(blank)
    before[1:] = blank[:-1]
    starts = np.flatnonzero(~blank & before)
    ends = np.flatnonzero(blank & ~before)
    w = span_hashes(lower[units], starts, ends, lane)
    doc = np.searchsorted(text_starts, starts, side="right") - 1
    counts = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(counts) - counts
    odd = mix(np.arange(1, 2 * words + 1, dtype=np.uint64)) | np.uint64(1)

    def joined(at: np.ndarray, n: int) -> np.ndarray:
        total = np.full(len(at), np.uint64(n), np.uint64)
        for k in range(n):
            total += mix(w[at + k] * odd[k] + odd[words + k])
        return mix(total)

    at = np.arange(max(0, len(w) - words + 1))
    at = at[doc[at] == doc[at + words - 1]] if len(at) else at
    parts, owners = [joined(at, words)], [doc[at]]
    for n in range(1, words):
        short = np.flatnonzero(counts == n)
        parts.append(joined(first[short], n))
        owners.append(short)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def _compressed(rest: np.ndarray) -> np.ndarray:
    """Leading-zero count and the bits after the first one, as one number."""
    zeros = 53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1]
    tail = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return (zeros.astype(np.uint64) << np.uint64(MANTISSA)) | tail


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Registers (uint16) of each set, a row per set; zeros for an empty set."""
    sizes = np.diff(offsets)
    m = len(sizes)
    out = np.zeros(m * REGISTERS, np.uint16)
    empty = np.repeat(sizes > 0, REGISTERS)
    owner = np.repeat(np.arange(m), sizes)
    own = hashes
    shift = np.uint64(REGISTERS.bit_length() - 1)
    for t in range(ROUNDS):
        x = mix(own ^ mix(np.uint64(t + 1) * np.ones(1, np.uint64)))
        low = np.full(m * REGISTERS, EMPTY, np.uint64)
        np.minimum.at(low, owner * REGISTERS + (x >> (np.uint64(64) - shift)).astype(np.int64), x << shift)
        fill = np.flatnonzero(empty & (low != EMPTY))
        code = _compressed(low[fill])
        out[fill] = code if t == 0 else mix(code + np.uint64(t << 32)) >> np.uint64(48)
        empty[fill] = False
        open_sets = empty.reshape(m, REGISTERS).any(1)
        if not open_sets.any():
            return out.reshape(m, REGISTERS)
        keep = open_sets[owner]
        own, owner = own[keep], owner[keep]
    left = np.flatnonzero(empty)
    of = left // REGISTERS
    n = sizes[of]
    first = np.cumsum(n) - n
    at = np.repeat(offsets[of] - first, n) + np.arange(int(n.sum()))
    x = mix(hashes[at] ^ np.repeat(mix((left % REGISTERS + 1000).astype(np.uint64)), n))
    out[left] = mix(_compressed(np.minimum.reduceat(x, first))) >> np.uint64(48)
    return out.reshape(m, REGISTERS)


@lru_cache(4096)
def chance(log_a: int, log_b: int) -> float:
    """How often registers of unrelated sets of about 2**log_a and 2**log_b members agree."""
    zeros = np.repeat(np.arange(40), 1 << MANTISSA)
    tail = np.tile(np.arange(1 << MANTISSA), 40)
    low = 2.0 ** -(zeros + 1) * (1 + tail / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1 + MANTISSA)
    cell = lambda n: (1 - low / REGISTERS) ** n - (1 - high / REGISTERS) ** n
    return float((cell(2.0**log_a) * cell(2.0**log_b)).sum())


def estimate(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> float:
    """Jaccard similarity from two rows of registers, corrected for chance."""
    by_chance = chance(round(np.log2(size_a)), round(np.log2(size_b)))
    return (float((a == b).mean()) - by_chance) / (1 - by_chance)


def reaches(texts: list[str], percent: int, words: int) -> bool:
    """Do the full sets of two texts reach the threshold? Counted by both lanes: a shingle is 128 bits."""
    for lane in (0, 1):
        hashes, offsets = shingle_sets(texts, words, lane)
        size = int(offsets[-1])
        both = size - len(np.unique(hashes))
        if 100 * both < percent * (size - both):
            return False
    return True


def set_digests(texts: list[str], hashes: np.ndarray, offsets: np.ndarray, words: int) -> list[bytes | None]:
    """A digest of each set (null: empty). Sets of few shingles are told apart by both lanes."""
    few = np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) <= FEW))
    other, at = shingle_sets([texts[i] for i in few], words, lane=1)
    more = {int(i): other[a:b].tobytes() for i, a, b in zip(few, at[:-1], at[1:])}
    return [
        hashlib.blake2b(hashes[a:b].tobytes() + more.get(i, b""), digest_size=16).digest() if b > a else None
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
    ]


def fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """(row, doc_id, digest, n_shingles, registers) of each row; digest and registers null for an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text", CHUNK):
            hashes, offsets = shingle_sets(texts, words)
            rows = sketches(hashes, offsets)
            sizes = np.diff(offsets)
            digests = set_digests(texts, hashes, offsets, words)
            registers = [r.tobytes() if n else None for r, n in zip(rows, sizes)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(registers, pa.binary()),
                ],
                names=["row", "doc_id", "digest", "n_shingles", "registers"],
            )

    own = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    return own.mapInArrow(work, "row long, doc_id long, digest binary, n_shingles long, registers binary")


def band_rows(percent: int) -> int:
    """The most registers a band may have for a pair at the threshold to be missed by all bands with a
    chance of at most ``MISS``."""
    level = percent / 100
    fits = [r for r in range(1, 33) if (1 - level**r) ** (REGISTERS // r) <= MISS]
    return max(fits, default=1)


def band_keys(classes: DataFrame, size: int) -> DataFrame:
    """(key, digest): a row per class and band of ``size`` registers."""
    bands = REGISTERS // size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
        base = mix(np.arange(1000, 1000 + bands, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16)
            rows = rows.reshape(-1, REGISTERS)[:, : bands * size].reshape(-1, bands, size).astype(np.uint64)
            keys = mix((mix(rows * odd + odd) * odd).sum(2, dtype=np.uint64) + base).ravel()
            digests = batch.column("digest").take(pa.array(np.repeat(np.arange(batch.num_rows), bands)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), digests], names=["key", "digest"])

    return classes.select("digest", "registers").mapInArrow(work, "key long, digest binary")


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate is within five standard errors of the threshold."""
    level = percent / 100
    least = level - 5 * (level * (1 - level) / REGISTERS) ** 0.5
    side = lambda c: classes.select(
        F.col("digest").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("registers").alias(f"registers_{c}")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()
            rows = zip(batch.column("registers_a").to_pylist(), batch.column("registers_b").to_pylist(), n_a, n_b)
            good = [
                100 * min(n, k) >= percent * max(n, k)
                and estimate(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16), n, k) >= least
                for x, y, n, k in rows
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(work, "a binary, b binary")


def class_texts(digests: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(digest, text) of the asked classes, written once."""
    rows = classes.select("digest", "row").join(digests, "digest")
    own = docs.select(F.monotonically_increasing_id().alias("row"), "text")
    return stored(own.join(rows, "row").select("digest", "text"), "candidate-texts")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on the full sets of their texts."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
    texts = class_texts(needed, classes, docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                good.append(reaches([x, y], percent, words))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return (
        pairs.join(texts.toDF("a", "text_a"), "a")
        .join(texts.toDF("b", "text_b"), "b")
        .mapInArrow(work, "a binary, b binary")
    )


def open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, digest, root) of the buckets that hold several components."""
    labelled = members.join(roots.toDF("digest", "root"), "digest", "left").select(
        "key", "digest", F.coalesce("root", "digest").alias("root")
    )
    mixed = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    return labelled.join(mixed.select("key"), "key", "left_semi")


def common_counts(hashes: np.ndarray, offsets: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of a block with each other."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    _, which, often = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = often[which] > 1
    owner, which = owner[shared], which[shared]
    _, which = np.unique(which, return_inverse=True)
    order = np.argsort(which, kind="stable")
    owner, which = owner[order], which[order]
    out = np.zeros((n, n), np.int64)
    for first in range(0, int(which[-1]) + 1 if len(which) else 0, width):
        part = slice(*np.searchsorted(which, [first, first + width]))
        table = np.zeros((n, width), np.float32)
        table[owner[part], which[part] - first] = 1
        out += (table @ table.T).astype(np.int64)
    return out


def linked_in_blocks(still: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """Links (a, b) that join components of one bucket, from all pairs of its blocks."""
    order = Window.partitionBy("key").orderBy("root", "digest")
    placed = still.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int"))
    placed = stored(placed, "open-blocks")
    spans = placed.groupBy("key", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    one, two = spans.toDF("key", "i", "lo_i", "hi_i"), spans.toDF("key", "j", "lo_j", "hi_j")
    mixed = "i <= j and (lo_i != hi_i or lo_j != hi_j or lo_i != lo_j)"
    tasks = one.join(two, "key").where(mixed)
    rows = tasks.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    texts = class_texts(still.select("digest").distinct(), classes, docs)
    rows = rows.join(placed, ["key", "block"]).join(texts, "digest").select("key", "i", "j", "digest", "root", "text")

    def work(group: pa.Table) -> pa.Table:
        digests, roots = group.column("digest").to_pylist(), group.column("root").to_pylist()
        texts = group.column("text").to_pylist()
        hashes, offsets = shingle_sets(texts, words)
        both = common_counts(hashes, offsets)
        sizes = np.diff(offsets)
        union = sizes[:, None] + sizes[None] - both
        label = {r: r for r in roots}

        def top(r: bytes) -> bytes:
            while label[r] != r:
                r = label[r]
            return r

        a, b = [], []
        for x, y in zip(*np.nonzero(np.triu(100 * both >= percent * union, 1))):
            p, q = top(roots[x]), top(roots[y])
            if p != q and reaches([texts[x], texts[y]], percent, words):
                label[max(p, q)] = min(p, q)
                a.append(digests[x])
                b.append(digests[y])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return rows.groupBy("key", "i", "j").applyInArrow(work, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5) -> DataFrame:
    """Each row of ``docs``: row, doc_id, n_shingles, component_id, kept."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    full = prints.where(F.col("n_shingles") > 0)
    classes = stored(
        full.groupBy("digest").agg(
            F.min("row").alias("row"),
            F.min("doc_id").alias("least_id"),
            F.count("*").alias("copies"),
            F.max("n_shingles").alias("n_shingles"),
            F.any_value("registers").alias("registers"),
        ),
        "classes",
    )
    keys = band_keys(classes, band_rows(percent))
    shared = keys.groupBy("key").agg(F.min("digest").alias("least"), F.count("*").alias("n")).where("n > 1")
    members = stored(keys.join(shared.drop("n"), "key"), "band-members")

    stars = members.where(F.col("digest") != F.col("least")).select(
        F.col("least").alias("a"), F.col("digest").alias("b")
    )
    first = stored(estimated(stars.distinct(), classes, percent), "candidates")
    links = stored(verified(first, classes, docs, percent, words), "links")
    roots = components(links)
    for turn in range(1, STARS):
        still = stored(open_members(members, roots), "open-members")
        if still.isEmpty():
            break
        hub = still.groupBy("key").agg(F.min(F.struct(F.xxhash64("digest", F.lit(turn)), "digest", "root")).alias("hub"))
        stars = still.join(hub, "key").where(F.col("root") != F.col("hub.root")).select(
            F.col("hub.digest").alias("a"), F.col("digest").alias("b")
        )
        near = stored(estimated(stars.distinct(), classes, percent), "candidates")
        links = links.union(stored(verified(near, classes, docs, percent, words), "links"))
        roots = components(links)
    still = stored(open_members(members, roots), "open-members")
    if not still.isEmpty():
        links = links.union(stored(linked_in_blocks(still, classes, docs, percent, words), "links"))
        roots = components(links)

    group = classes.join(roots.toDF("digest", "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = group.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("copies").alias("rows"))
    special = group.join(least.where("rows > 1"), "root").select("digest", "component_id")
    return prints.join(special, "digest", "left").select(
        "row",
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"),
    )


def deduplicate(docs: DataFrame, percent: int = 85, words: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, with all columns."""
    return without_rows(docs, near_duplicates(docs, percent, words).where(~F.col("kept")).select("row"))
