"""License scans by diagonal voting.

Every rolling ``k``-gram of every text's words is hashed and joined with the positions of the same
k-grams in the license statements. Statements are a parameter of at most ``MAX_POSITIONS`` positions,
checked, so that side is broadcast and only hits are shuffled. A hit's words are compared with the
statement's, so a hash never decides. Hits vote for their diagonal (place in the text minus place in
the statement); diagonals of a text and statement at most ``gap`` apart (``slack`` of the statement's words,
where that is more) are merged, which allows for words left out or put in. Merged diagonals whose hits
could cover ``least`` of the statement's words are verified: the longest chains of hits that rise in
text and statement alike, from hit to hit within that gap, must cover as much and hold the statement's
key phrase, if it has one.

Texts are cut into segments of ``SEGMENT`` words (overlapping by k - 1) so that no row grows with the
text; positions count from the text's start.

Base phrases are found beside it at the places where their words stand consecutively.

Defined results: null and empty texts have no words and no labels; rows that repeat an identifier are
scanned one by one; null identifiers are kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.shared import chunks, lower_ascii
from tallymark.llm.spans import mix, span_hashes, utf8

CHUNK = 400_000
SEGMENT = 4096
MAX_POSITIONS = 200_000
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, hashes of words, and the texts' first words."""
    units, text_starts = utf8(texts)
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    units = table[units]
    inside = (units >= 128) | ((units >= 48) & (units < 58)) | ((units >= 97) & (units < 123))
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
    return units, starts, ends, span_hashes(units, starts, ends), np.searchsorted(starts, text_starts)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    odd = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(words) - k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += mix(words[j : j + n] * odd[j])
    return mix(total).view(np.int64)


def summaries(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Word count and base phrases of each row of (key, doc_id, text)."""
    wanted = [(p.encode().split(), label) for p, label in phrases.items()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = [(words_of([" ".join(w.decode() for w in ws)])[3], ws, label) for ws, label in wanted]
        for batch, texts in chunks(batches, "text", CHUNK):
            units, starts, ends, words, first = words_of(texts)
            n = np.diff(first)
            found: list[list[tuple[int, str]]] = [[] for _ in texts]
            for marks, parts, label in hashed:
                size = len(parts)
                at = np.flatnonzero(words[: max(0, len(words) - size + 1)] == marks[0])
                for j in range(1, size):
                    at = at[words[at + j] == marks[j]]
                text = np.searchsorted(first, at, side="right") - 1
                for i, t in zip(at.tolist(), text.tolist()):
                    same = all(units[starts[i + j] : ends[i + j]].tobytes() == w for j, w in enumerate(parts))
                    if same and i + size <= first[t + 1]:
                        found[t].append((i - int(first[t]), label))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([min(x)[0] if x else None for x in found], pa.int64()),
                    pa.array([max(x)[0] if x else None for x in found], pa.int64()),
                    pa.array([sorted({label for _, label in x}) for x in found], pa.list_(pa.string())),
                ],
                names=["key", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"],
            )

    return docs.mapInArrow(
        work,
        "key long, doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>",
    )


def segments(docs: DataFrame, k: int) -> DataFrame:
    """Segments of (key, doc_id, text): their text and the hash, first byte and length of each k-gram."""
    gram = pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("size", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text", CHUNK):
            units, starts, ends, words, first = words_of(texts)
            hashes = gram_hashes(words, k)
            rows, bodies, firsts, cuts = [], [], [], []
            for t in range(len(texts)):
                for a in range(int(first[t]), int(first[t + 1]) - k + 1, SEGMENT):
                    b = min(a + SEGMENT, int(first[t + 1]) - k + 1)
                    rows.append(t)
                    firsts.append(a - int(first[t]))
                    cuts.append((a, b))
                    bodies.append(units[starts[a] : ends[b + k - 2]].tobytes())
            if not rows:
                continue
            picks = np.concatenate([np.arange(a, b) for a, b in cuts])
            sizes = np.array([b - a for a, b in cuts])
            base = np.repeat([starts[a] for a, _ in cuts], sizes)
            grams = pa.StructArray.from_arrays(
                [
                    pa.array(hashes[picks]),
                    pa.array((starts[picks] - base).astype(np.int32)),
                    pa.array((ends[picks + k - 1] - starts[picks]).astype(np.int32)),
                ],
                fields=list(gram),
            )
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(rows)),
                    batch.column("doc_id").take(pa.array(rows)),
                    pa.array(firsts, pa.int64()),
                    pa.array(bodies, pa.binary()),
                    pa.ListArray.from_arrays(offsets, grams),
                ],
                names=["key", "doc_id", "first", "body", "grams"],
            )

    return docs.mapInArrow(
        work, "key long, doc_id long, first long, body binary, grams array<struct<hash:long,at:int,size:int>>"
    )


def template_positions(spark, templates: list[tuple], k: int) -> DataFrame:
    """(template, label, n_template, place, hash, words, telling) of every k-gram of the statements;
    ``telling``: it holds the statement's key phrase, or there is none."""
    rows = []
    for number, (label, text, *key) in enumerate(templates):
        phrase = f" {key[0]} " if key and key[0] else " "
        units, starts, ends, words, _ = words_of([text])
        names = [units[a:b].tobytes().decode() for a, b in zip(starts, ends)]
        for place, h in enumerate(gram_hashes(words, k).tolist()):
            said = " ".join(names[place : place + k])
            rows.append((number, label, len(names), place, h, said, phrase in f" {said} "))
    if len(rows) > MAX_POSITIONS:
        raise ValueError(f"{len(rows)} template positions; at most {MAX_POSITIONS} can be broadcast")
    return spark.createDataFrame(
        rows, "template int, label string, n_template int, place int, hash long, words string, telling boolean"
    )


def in_order(pos: np.ndarray, place: np.ndarray, k: int, n: int, gap: int) -> list[tuple[int, np.ndarray]]:
    """(words covered, indexes of hits) of chains of hits, best first (of equal ones that of more hits), none
    within another's words: both numbers of a chain rise, and from one hit to the next the diagonal moves
    by ``gap`` at most."""
    word = 1 << 32
    order = np.lexsort((place, pos))
    pos, place = pos[order], place[order]
    out = []
    while len(pos):
        best, before = np.full(len(pos), k * word + 1, np.int64), np.full(len(pos), -1, np.int64)
        near = np.searchsorted(pos, pos - n - gap)
        for i in range(len(pos)):
            j = np.arange(near[i], i)
            step, move = place[i] - place[j], pos[i] - pos[j]
            total = np.where((step > 0) & (move > 0) & (abs(move - step) <= gap), best[j] + np.minimum(k, step) * word + 1, 0)
            if len(j) and total.max() > best[i]:
                best[i], before[i] = total.max(), j[total.argmax()]
        i = end = int(best.argmax())
        chain = []
        while i >= 0:
            chain.append(i)
            i = before[i]
        out.append((int(best[end] // word), order[chain[::-1]]))
        if len(chain) == 1:
            break
        rest = (pos < pos[chain[-1]]) | (pos > pos[end])
        pos, place, order = pos[rest], place[rest], order[rest]
    return out


def license_spans(
    docs: DataFrame, templates: list[tuple], k: int = 3, gap: int = 2, least: float = 0.8, slack: float = 0.15
) -> DataFrame:
    """Spans of (key, doc_id, text): key, doc_id, template, label, first and last word, coverage."""
    positions = template_positions(docs.sparkSession, templates, k)
    grams = segments(docs, k).select(
        "key", "doc_id", "body", F.col("first").alias("first"), F.posexplode("grams").alias("n", "gram")
    )
    hits = grams.join(F.broadcast(positions), F.col("gram.hash") == F.col("hash"))
    said = F.substring(F.col("body"), F.col("gram.at") + 1, F.col("gram.size")).cast("string")
    own = ["key", "doc_id", "template", "label", "n_template"]
    hits = hits.where(F.regexp_replace(said, BREAK, " ") == F.col("words")).select(
        *own, "place", "telling", (F.col("first") + F.col("n")).alias("pos")
    )
    diagonals = hits.groupBy(*own, (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        F.collect_set(F.struct("place", "telling")).alias("places")
    )
    along = Window.partitionBy("key", "doc_id", "template").orderBy("diagonal")
    width = F.greatest(F.lit(gap), F.floor(F.col("n_template") * slack).cast("int"))
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > width).cast("int"), F.lit(1))
    merged = (
        diagonals.withColumn("fresh", fresh)
        .withColumn("group", F.sum("fresh").over(along))
        .groupBy(*own, "group")
        .agg(F.collect_list(F.struct("diagonal", "places")).alias("votes"))
    )
    places = F.array_distinct(F.flatten(F.col("votes.places")))
    covered = F.size(
        F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p["place"], p["place"] + F.lit(k - 1)))))
    )
    possible = merged.where((covered >= least * F.col("n_template")) & F.exists(places, lambda p: p["telling"]))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, doc, template, label, n, votes in frame.itertuples(index=False):
                flat = [(v["diagonal"] + p["place"], p["place"], p["telling"]) for v in votes for p in v["places"]]
                pos, place, telling = (np.array(x) for x in zip(*flat))
                for words, chain in in_order(pos, place, k, n, max(gap, int(n * slack))):
                    if words >= least * n and telling[chain].any():
                        rows.append((key, doc, template, label, pos[chain[0]], pos[chain[-1]] + k - 1, words / n))
            out = pd.DataFrame(rows, columns=[*own[:4], "first_word", "last_word", "coverage"], dtype=object)
            yield out.astype({"key": "int64", "doc_id": "Int64", "coverage": "float64"})

    return possible.select(*own, "votes").mapInPandas(
        verify,
        "key long, doc_id long, template int, label string, first_word long, last_word long, coverage double",
    )


def scan(
    docs: DataFrame,
    phrases: dict[str, str],
    templates: list[tuple],
    k: int = 3,
    gap: int = 2,
    least: float = 0.8,
    slack: float = 0.15,
) -> DataFrame:
    """Each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(
        F.xxhash64(F.col("doc_id").cast("long"), text).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
    )
    spans = license_spans(own, templates, k, gap, least, slack)
    found = spans.groupBy("key", F.col("doc_id").alias("found_id")).agg(
        F.collect_set("label").alias("found"), F.max("coverage").alias("score")
    )
    base = summaries(own, phrases)
    both = base.join(found, (base["key"] == found["key"]) & base["doc_id"].eqNullSafe(found["found_id"]), "left")
    every = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    return both.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
