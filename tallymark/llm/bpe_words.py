"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

Encoding: texts are cut into pre-tokens. Documents are taken in blocks of about ``block`` characters;
a block numbers its distinct words by frequency, so a document becomes the positions' word numbers.
The words of all blocks are exploded by a hash of the word into ``buckets`` and shuffled: all rows of
a word meet in one task, which encodes it once. The ids go back to the blocks that asked (a join on
the block), where every document is put together again by position.

Before the shuffle a word is one entry per block, however often it occurs, so frequent words are
no hot keys. Words and numbers move as packed columns, not as a row each. Both sides of the
join are made from the same scan; a checksum of each block's words stops the job if they differ.

Decoding joins ids with the token-byte table. The vocabulary bounds that table, so it is broadcast
and the join is an array look-up.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows and null
identifiers are rows of their own; one text may be longer than a block; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallymark.llm.bpe import Encoder, ranks_of, token_bytes
from tallymark.llm.shared import chunks, part_count
from tallymark.llm.spans import code_points, distinct_spans, pre_tokens, ragged

CHUNK = 400_000
ROWS = 500
BLOCK = 4_000_000
BLOCKS = "block long, bucket int, words binary, buckets binary, doc_ids array<long>, counts binary, numbers binary, mark long"
WORD_IDS = "block long, bucket int, counts binary, ids binary, mark long"


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _raw(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)


def _packed_ints(x: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes as the largest needs, all first bytes before all second ones."""
    most = int(x.max()) if len(x) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    planes = x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + _packed(planes.tobytes())


def _ints(x: bytes) -> np.ndarray:
    width = x[0]
    planes = np.frombuffer(_raw(x[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


@lru_cache(maxsize=2)
def _encoder(rank_file: bytes) -> Encoder:
    return Encoder(ranks_of(rank_file))


class _Block:
    """Documents as word numbers, and the words."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.hashes: list[int] = []
        self.numbers: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_ids: list, texts: list[str]) -> None:
        joined, units, text_starts = code_points(texts)
        starts, ends = pre_tokens(units, text_starts)
        hashes, first, which = distinct_spans(units, starts, ends)
        words, own = self.words, np.empty(len(first), np.int64)
        for i, (h, a, b) in enumerate(zip(hashes.tolist(), starts[first].tolist(), ends[first].tolist())):
            n = own[i] = words.setdefault(joined[a:b], len(words))
            if n == len(self.hashes):
                self.hashes.append(h)
        self.numbers.append(own[which])
        self.doc_ids += doc_ids
        self.counts.append(np.diff(np.searchsorted(starts, text_starts)))
        self.size += len(units)

    def rows(self, block: int, buckets: int, want: str) -> Iterator[dict]:
        which = np.concatenate(self.numbers)
        distinct = np.array(self.hashes, np.uint64)
        order = np.lexsort((distinct, -np.bincount(which, minlength=len(distinct))))
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order))
        mark = zlib.crc32(distinct.tobytes())
        bucket = ((distinct >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)[order]
        if want == "documents":
            yield {
                "block": block,
                "doc_ids": self.doc_ids,
                "counts": _packed_ints(np.concatenate(self.counts)),
                "numbers": _packed_ints(number[which]),
                "buckets": _packed_ints(bucket),
                "mark": mark,
            }
            return
        by_bucket = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1))
        texts = list(self.words)
        for b in range(buckets):
            places = by_bucket[cuts[b] : cuts[b + 1]]
            if len(places):
                words = [texts[n].encode("utf-8", "surrogatepass") for n in order[places].tolist()]
                yield {
                    "block": block,
                    "bucket": b,
                    "words": _packed(b"".join(words)),
                    "counts": _packed_ints(np.fromiter(map(len, words), np.int64, len(words))),
                    "mark": mark,
                }


def blocks(docs: DataFrame, want: str, buckets: int, block_chars: int = BLOCK) -> DataFrame:
    """Blocks of ``docs``: their ``documents`` as word numbers, or their ``words`` by bucket."""
    schema = pa.schema(
        [
            ("block", pa.int64()),
            ("bucket", pa.int32()),
            ("words", pa.binary()),
            ("buckets", pa.binary()),
            ("doc_ids", pa.list_(pa.int64())),
            ("counts", pa.binary()),
            ("numbers", pa.binary()),
            ("mark", pa.int64()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, now = TaskContext.get().partitionId(), 0, _Block()

        def emit() -> Iterator[pa.RecordBatch]:
            for row in now.rows(part << 32 | seq, buckets, want):
                yield pa.RecordBatch.from_pylist([row], schema)

        for batch, texts in chunks(batches, "text", CHUNK):
            if now.doc_ids and now.size + sum(map(len, texts)) > block_chars:
                yield from emit()
                seq, now = seq + 1, _Block()
            now.add(batch.column("doc_id").to_pylist(), texts)
        if now.doc_ids:
            yield from emit()

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, BLOCKS)


def encode_words(words: DataFrame, rank_file: bytes, buckets: int) -> DataFrame:
    """Ids of the words of each (block, bucket). A word's rows meet in one task and it is encoded once."""
    shipped = words.sparkSession.sparkContext.broadcast(rank_file)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        known: dict[bytes, list[int]] = {}
        bucket = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != bucket:
                    bucket, known = row["bucket"], {}
                text = _raw(row["words"])
                ends = np.cumsum(_ints(row["counts"])).tolist()
                ids, counts, start = [], [], 0
                for end in ends:
                    word = text[start:end]
                    own = known.get(word)
                    if own is None:
                        own = known[word] = encoder.encode(word)
                    ids += own
                    counts.append(len(own))
                    start = end
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]]),
                        pa.array([row["bucket"]], pa.int32()),
                        pa.array([_packed_ints(np.array(counts, np.int64))], pa.binary()),
                        pa.array([_packed_ints(np.array(ids, np.int64))], pa.binary()),
                        pa.array([row["mark"]]),
                    ],
                    names=["block", "bucket", "counts", "ids", "mark"],
                )

    rows = words.select("block", "bucket", "words", "counts", "mark")
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(work, WORD_IDS)


def _reassemble(docs: pa.Table, words: pa.Table) -> pa.Table:
    doc_ids, counts_out, ids_out = [], [], []
    for row in docs.to_pylist():
        parts = sorted(words.to_pylist(), key=lambda w: w["bucket"])
        if any(w["mark"] != row["mark"] for w in parts):
            raise ValueError("the documents were read in another order; store them before encoding")
        doc_ids += row["doc_ids"]
        per_doc = _ints(row["counts"])
        if not parts:
            counts_out.append(np.zeros(len(per_doc), np.int64))
            continue
        # Words came by bucket, in the order of their numbers.
        order = np.argsort(np.argsort(_ints(row["buckets"]), kind="stable"), kind="stable")
        counts = np.concatenate([_ints(w["counts"]) for w in parts])
        flat = np.concatenate([_ints(w["ids"]) for w in parts])
        values = ragged(flat, np.concatenate([[0], np.cumsum(counts)]), order)[0]
        offsets = np.concatenate([[0], np.cumsum(counts[order])])
        numbers = _ints(row["numbers"])
        ids, sizes = ragged(values, offsets, numbers)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        edge = np.concatenate([[0], np.cumsum(per_doc)])
        ids_out.append(ids)
        counts_out.append(np.diff(ends[edge]))
    counts = np.concatenate([*counts_out, np.zeros(0, np.int64)])
    ids = np.concatenate([*ids_out, np.zeros(0, np.uint32)]).astype(np.int32)
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(offsets, ids)})


def encode(docs: DataFrame, rank_file: bytes, buckets: int | None = None, block_chars: int = BLOCK) -> DataFrame:
    """(doc_id, ids) of each row of ``docs``."""
    buckets = buckets or 2 * part_count(docs.sparkSession)
    left = blocks(docs, "documents", buckets, block_chars).select("block", "doc_ids", "counts", "numbers", "buckets", "mark")
    right = encode_words(blocks(docs, "words", buckets, block_chars), rank_file, buckets)
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(
        _reassemble, "doc_id long, ids array<int>"
    )


def _decoded(lists: pa.ListArray, table: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """Bytes of each list of ids by the token-byte table."""
    letters, offsets = table
    edge = lists.offsets.to_numpy().astype(np.int64)
    values, sizes = ragged(letters, offsets, lists.values.to_numpy()[edge[0] : edge[-1]])
    ends = np.concatenate([[0], np.cumsum(sizes)])[edge - edge[0]].tolist()
    raw = values.tobytes()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def decode(encoded: DataFrame, rank_file: bytes) -> DataFrame:
    """``encoded`` (doc_id, ids) with the column ``decoded``, the bytes of the ids."""
    shipped = encoded.sparkSession.sparkContext.broadcast(token_bytes(ranks_of(rank_file)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                decoded = pa.array(_decoded(part.column("ids"), shipped.value), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids array<int>, decoded binary")


def digests(encoded: DataFrame, rank_file: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``encoded`` (doc_id, ids): ids as little-endian
    unsigned 32-bit integers, and the bytes they decode to, which stay in the task."""
    shipped = encoded.sparkSession.sparkContext.broadcast(token_bytes(ranks_of(rank_file)))
    digest = lambda x: hashlib.sha256(x).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column("ids")
                edge = lists.offsets.to_numpy().tolist()
                ids = lists.values.to_numpy().astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([b - a for a, b in zip(edge, edge[1:])], pa.int64()),
                        pa.array([digest(ids[a:b].tobytes()) for a, b in zip(edge, edge[1:])], pa.string()),
                        pa.array([digest(x) for x in _decoded(lists, shipped.value)], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return encoded.select("doc_id", "ids").mapInArrow(
        work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
