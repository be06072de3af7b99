"""Substring dedup by seed and extend: repeated spans of at least ``length`` words, wherever they stand.

1. Seeds. Texts go in blocks, written once. Of the k-grams (``gram`` words) of each window of ``length``
   words the one with the smallest hash is the window's anchor (the last one of equal hashes), so equal
   windows have equal anchors at the same place. Neighbouring windows with one anchor are a run; a
   run's reach is all words of its windows.
2. Join. Runs whose anchor stands nowhere else are done with; anchors are counted before the shuffle, and
   those of very many runs are broadcast. The others meet as counts of (anchor, reach), added up before the
   shuffle: a passage that a third of the documents share is one row a task. Runs with an equal reach
   extend each other over all their windows and are repeated as a whole.
3. Extension. Where an anchor has several reaches, the runs differ somewhere on the left or on the
   right. One run of each reach extends word by word both ways: each of its windows (anchor, words) is
   counted, and a window that two reaches share, or that stands in a repeated reach, is a repeat.
   The windows of a run are as many as its words beyond ``length``, whatever the number of partners; no
   pairs are formed.
4. Repeated windows go back to their blocks, where overlapping ones become maximal spans.

Words are hashed by two independent 64-bit hashes; a run is told apart by its anchor and its reach (122
bits; six hold its number of windows), a window by its anchor and its words (128 bits). A run is three
numbers, its place being block and word in one. No count is capped, and no text is cut.

Defined results: null and empty texts have no words; a text shorter than ``length`` has no window; a text
that repeats itself counts as any other; equal rows repeat each other; null or repeated identifiers are
rows of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.shared import chunks, discard, joined_by_count, stored, written
from tallymark.llm.spans import mix, span_hashes

BLOCK = 1_000_000
#: Bytes of a block that are hashed at once (a word at least): bounds a worker's tables of powers.
SLICE = (1 << 16) - 1
BLOCKS = "block long, doc_ids array<long>, sizes binary, payload binary"
RUNS = "place long, anchor long, reach long"
WINDOWS = "place long, anchor long, words long, weight int"
PLACE, SEQ, MOST = 26, 18, 63
RESULT = (
    "doc_id long, n_words long, n_removed long, text string, spans array<struct<start: long, end: long>>"
)


def blocks(docs: DataFrame, chars: int = BLOCK) -> DataFrame:
    """Texts in numbered blocks of about ``chars`` characters (one text at least), packed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[bytes] = []

        def emit() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, texts), np.int64, len(texts)).tobytes()
            raw = b"".join(texts)
            payload = len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << SEQ | seq]),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([sizes], pa.binary()),
                    pa.array([payload], pa.binary()),
                ],
                names=["block", "doc_ids", "sizes", "payload"],
            )

        held = 0
        for batch, some in chunks(batches, "text", chars):
            new = sum(map(len, some))
            if ids and held + new > chars:
                yield emit()
                ids, texts, held, seq = [], [], 0, seq + 1
            ids += batch.column("doc_id").to_pylist()
            texts += [t.encode("utf-8", "surrogatepass") for t in some]
            held += new
        if ids:
            yield emit()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(own.mapInArrow(work, BLOCKS), "repeat-blocks")


def block_of(place: str) -> Column:
    return F.shiftright(place, PLACE)


def start_of(place: str) -> Column:
    return F.col(place).bitwiseAND(F.lit((1 << PLACE) - 1))


def windows_of(reach: str) -> Column:
    return F.col(reach).bitwiseAND(F.lit(MOST)).cast("int")


def places(block: int, starts: np.ndarray) -> pa.Array:
    if len(starts) and starts[-1] >> PLACE or block >> 63 - PLACE:
        raise ValueError(f"a block of {1 << PLACE} words or number {block} of a block: raise PLACE or SEQ")
    return pa.array(starts + (block << PLACE))


def unpacked(payload: bytes, sizes: bytes) -> list[bytes]:
    raw = pa.decompress(payload[8:], int.from_bytes(payload[:8], "little"), "zstd", asbytes=True)
    ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


class Words:
    """The words of a block's texts in one row, as two hashes; ``texts`` tells where each text starts."""

    def __init__(self, texts: list[bytes]):
        units = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        blank = space[units]
        before = np.ones_like(blank)
        before[1:] = blank[:-1]
        starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.texts = np.searchsorted(starts, at)
        cuts = [0]
        while cuts[-1] < len(starts):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, starts[cuts[-1]] + SLICE, side="right"))))
        self.hashes = [np.zeros(len(starts), np.uint64) for _ in (0, 1)]
        for a, b in zip(cuts, cuts[1:]):
            at, some = starts[a], units[starts[a] : ends[b - 1]]
            for lane, out in enumerate(self.hashes):
                out[a:b] = span_hashes(some, starts[a:b] - at, ends[a:b] - at, lane)

    def spans(self, lane: int, size: int) -> np.ndarray:
        """Hashes of every ``size`` words in a row, by doubling: not linear in the words."""
        x, have = self.hashes[lane], 1
        while have < size:
            step = min(have, size - have)
            odd = np.uint64(0xD1B54A32D192ED03 + 2 * (size * 64 + have))
            x = mix(mix(x[:-step] ^ odd) * np.uint64(3) + x[step:]) if len(x) > step else x[:0]
            have += step
        return x


def runs(words: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, anchor hash, and reach hash with the number of windows of every run of windows."""
    total = len(words.hashes[0])
    starts = np.arange(max(0, total - length + 1))
    ends_at = words.texts[np.searchsorted(words.texts, starts, side="right")]
    valid = starts + length <= ends_at
    none = np.zeros(0, np.int64)
    if not valid.any():
        return none, none.astype(np.uint64), none.astype(np.uint64)
    grams = words.spans(0, gram)
    width = length - gram + 1
    least, where = grams[: len(starts)].copy(), np.zeros(len(starts), np.int64)
    for j in range(1, width):
        other = grams[j : j + len(starts)]
        take = other <= least
        least[take] = other[take]
        where[take] = j
    where += starts
    starts, where, least = starts[valid], where[valid], least[valid]
    new = np.ones(len(starts), bool)
    new[1:] = (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    whole = words.spans(1, length)
    reach = mix(mix(whole[begin] ^ n.astype(np.uint64)) * np.uint64(3) + whole[begin + n - 1])
    reach = mix(reach + (where[first] - begin).astype(np.uint64))
    return begin, least[first], (reach & ~np.uint64(MOST)) | n.astype(np.uint64)


def seeds(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs of all blocks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, sizes, payload = (batch.column(c)[i].as_py() for c in ("block", "sizes", "payload"))
                start, anchor, reach = runs(Words(unpacked(payload, sizes)), length, gram)
                yield pa.RecordBatch.from_arrays(
                    [places(block, start), pa.array(anchor.view(np.int64)), pa.array(reach.view(np.int64))],
                    names=["place", "anchor", "reach"],
                )

    return texts.select("block", "sizes", "payload").mapInArrow(work, RUNS)


def window_rows(asked: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Every window of the asked runs (place, anchor, reach, weight)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, payload = batch.column("sizes")[i].as_py(), batch.column("payload")[i].as_py()
                whole = Words(unpacked(payload, sizes)).spans(1, length)
                wanted = batch.column("asked")[i].values
                get = lambda c: wanted.field(c).to_numpy()
                n = get("n").astype(np.int64)
                within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(get("start"), n) + within
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(start + (batch.column("block")[i].as_py() << PLACE)),
                        pa.array(np.repeat(get("anchor"), n)),
                        pa.array(whole[start].view(np.int64)),
                        pa.array(np.repeat(get("weight"), n)),
                    ],
                    names=["place", "anchor", "words", "weight"],
                )

    one = F.struct(start_of("place").alias("start"), windows_of("reach").alias("n"), "anchor", "weight")
    by_block = asked.groupBy(block_of("place").alias("block")).agg(F.collect_list(one).alias("asked"))
    return texts.select("block", "sizes", "payload").join(by_block, "block").mapInArrow(work, WINDOWS)


def repeated_windows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(place, n): runs of windows whose words also stand elsewhere."""
    spark = texts.sparkSession
    found, path = written(seeds(texts, length, gram), "repeat-runs")
    anchors = stored(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "repeat-anchors")
    met = stored(joined_by_count(found, anchors, "anchor", "n").drop("n"), "repeat-met")
    discard(spark, path)
    reaches = met.groupBy("anchor", "reach").agg(F.count("*").alias("copies"), F.min("place").alias("place"))
    reaches = stored(reaches, "repeat-reaches")
    whole = reaches.where("copies > 1").select("anchor", "reach", "copies")
    full = joined_by_count(met, whole, ["anchor", "reach"], "copies").select("place", windows_of("reach").alias("n"))

    several = reaches.groupBy("anchor").agg(F.count("*").alias("reaches")).where("reaches > 1")
    asked = joined_by_count(reaches, several, "anchor", "reaches").select(
        "place", "anchor", "reach", F.when(F.col("copies") > 1, 2).otherwise(1).alias("weight")
    )
    windows = stored(window_rows(asked, texts, length), "repeat-windows")
    shared = windows.groupBy("anchor", "words").agg(F.sum("weight").alias("weight"), F.count("*").alias("rows"))
    shared = shared.where("weight > 1").select("anchor", "words", "rows")
    single = windows.where("weight = 1").select("place", "anchor", "words")
    edges = joined_by_count(single, shared, ["anchor", "words"], "rows")
    return full.union(edges.select("place", F.lit(1).alias("n")))


def remove_repeats(docs: DataFrame, length: int = 35, gram: int = 12) -> DataFrame:
    """Each row of ``docs``: doc_id, n_words, n_removed, text (kept words, one space between them) and
    the repeated spans (word numbers, end excluded) that were removed."""
    if not 0 <= length - gram < MOST:
        raise ValueError(f"gram must be at most length and above length - {MOST}")
    texts = blocks(docs)
    spans = repeated_windows(texts, length, gram)
    one = F.struct(start_of("place").alias("start"), "n")
    by_block = spans.groupBy(block_of("place").alias("block")).agg(F.collect_list(one).alias("found"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("n_words", pa.int64()),
                ("n_removed", pa.int64()),
                ("text", pa.string()),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
        )
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("doc_ids", "sizes", "payload")}
                own = [t.split() for t in unpacked(row["payload"], row["sizes"])]
                at = np.cumsum([0, *map(len, own)])
                change = np.zeros(int(at[-1]) + 1, np.int64)
                found = batch.column("found")[i]
                if found.is_valid:
                    start, n = (found.values.field(c).to_numpy() for c in ("start", "n"))
                    np.add.at(change, start, 1)
                    np.add.at(change, start + n + (length - 1), -1)
                gone = np.cumsum(change[:-1]) > 0
                out = []
                for doc_id, words, a, b in zip(row["doc_ids"], own, at[:-1].tolist(), at[1:].tolist()):
                    mask = gone[a:b]
                    n_gone = int(mask.sum())
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist()
                    kept = words if not n_gone else [w for w, g in zip(words, mask.tolist()) if not g]
                    out.append(
                        {
                            "doc_id": doc_id,
                            "n_words": len(words),
                            "n_removed": n_gone,
                            "text": b" ".join(kept).decode("utf-8", "replace"),
                            "spans": [{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2])],
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, schema)

    return texts.join(by_block, "block", "left").select("doc_ids", "sizes", "payload", "found").mapInArrow(work, RESULT)


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs, **options).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )
