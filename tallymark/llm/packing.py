"""Packing into training sequences, balanced by attention cost.

A document is its token ids and one end id. It is cut into full sequences of ``capacity`` tokens and
a rest. Rests are dealt by a hash of their content (a running number keeps repeated rows apart) to
bins of about ``rests`` documents, so no bin grows with the data or with a hot key. In a bin, rests
go in descending order of estimated cost (``linear * n + quadratic * n**2``) to the sequence of
lowest cost so far that has capacity left; one that takes the rest whole is preferred among the
lowest ``probes``, else the rest is cut. The bin opens exactly as many sequences as its tokens fill:
full ones, and for the remainder the powers of two that it is made of, so nothing is padded.

Text is read once: ids of full sequences are hashed where they are made, only ids of rests are
shuffled (two bytes each where the vocabulary allows it, else four). Ids are those of the tokenizers library:
literals of the file's added tokens are one id each, no template is put around the text.

Defined results: null and empty texts are the end id alone; repeated rows are packed as rows of
their own; a null identifier is kept; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tallymark.llm.shared import chunks
from tallymark.llm.spans import mix
from tallymark.llm.tokenizers_cache import largest_id, tokenizer_ids

CUT = "bin long, doc_id long, doc_tokens long, crcs binary, rest binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
CHUNK = 400_000


def id_type(tokenizer_json: str, end_id: int) -> type:
    return np.uint16 if max(largest_id(tokenizer_json), end_id) < 1 << 16 else np.uint32


def cut_documents(docs: DataFrame, tokenizer_json: str, bins: int, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """A row per document: bin, number of ids, hashes of its full sequences, ids of its rest."""
    model = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    kind = id_type(tokenizer_json, end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer_ids(model.value)
        seen: Counter[int] = Counter()
        for batch, texts in chunks(batches, "text", CHUNK):
            ids, counts = ids_of(texts)
            ends = np.cumsum(counts)
            rows = []
            for doc, start, stop in zip(batch.column("doc_id").to_pylist(), ends - counts, ends):
                own = np.append(ids[start:stop], np.uint32(end_id))
                full = len(own) // capacity
                crcs = np.array(
                    [zlib.crc32(own[i * capacity : (i + 1) * capacity].tobytes()) for i in range(full)], np.uint32
                )
                rest = own[full * capacity :]
                key = zlib.crc32(rest.tobytes(), zlib.crc32(crcs.tobytes(), hash(doc) & 0xFFFFFFFF))
                seen[key] += 1
                salt = int(mix(np.array([key << 32 | seen[key] & 0xFFFFFFFF], np.uint64))[0])
                rows.append((salt % bins, doc, len(own), crcs.tobytes(), rest.astype(kind).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                names=["bin", "doc_id", "doc_tokens", "crcs", "rest"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(cut, CUT)


def assign(
    lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024, probes: int = 16
) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (item, start, length, sequence, offset) of the items, and the number of sequences."""
    full, left = divmod(sum(lengths), capacity)
    room = [capacity] * full + [1 << b for b in reversed(range(left.bit_length())) if left >> b & 1]
    used = [0] * len(room)
    heap = [(0.0, s) for s in range(len(room))]
    pieces = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start = 0
        while start < lengths[item]:
            want, aside, pick = lengths[item] - start, [], None
            while heap and len(aside) < probes:
                cost, s = heapq.heappop(heap)
                if room[s] - used[s] >= want:
                    pick = (cost, s)
                    break
                aside.append((cost, s))
            if pick is None:
                pick = aside.pop(0)
            for other in aside:
                heapq.heappush(heap, other)
            cost, s = pick
            take = min(want, room[s] - used[s])
            pieces.append((item, start, take, s, used[s]))
            used[s] += take
            start += take
            if used[s] < room[s]:
                heapq.heappush(heap, (cost + linear * take + quadratic * take * take, s))
    return pieces, len(room)


def pack(
    docs: DataFrame,
    tokenizer_json: str,
    capacity: int = 1024,
    end_id: int = 0,
    rests: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1 / 1024,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    bins = -(-docs.count() // rests) or 1
    kind = id_type(tokenizer_json, end_id)

    def pack_bin(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_tokens", "rest", "doc_id"], kind="stable").reset_index(drop=True)
        rest = [np.frombuffer(r, kind).astype(np.uint32) for r in rows["rest"]]
        pieces, used = assign([len(r) for r in rest], capacity, linear, quadratic)
        first = int(rows["bin"].iloc[0]) << 32
        full = [np.frombuffer(c, np.uint32) for c in rows["crcs"]]
        of = np.array([p[0] for p in pieces], np.int64)
        before = np.array([len(c) * capacity for c in full], np.int64)
        cols = {
            "item": of,
            "start": np.array([p[1] for p in pieces], np.int64) + before[of],
            "length": np.array([p[2] for p in pieces], np.int64),
            "ids_crc32": np.array([zlib.crc32(rest[i][a : a + n].tobytes()) for i, a, n, _, _ in pieces], np.int64),
            "sequence_id": first + np.array([p[3] for p in pieces], np.int64),
            "offset": np.array([p[4] for p in pieces], np.int64),
        }
        n_full = np.array([len(c) for c in full], np.int64)
        total = int(n_full.sum())
        item = np.repeat(np.arange(len(full)), n_full)
        whole = {
            "item": item,
            "start": (np.arange(total) - np.repeat(np.cumsum(n_full) - n_full, n_full)) * capacity,
            "length": np.full(total, capacity),
            "ids_crc32": np.concatenate([*full, np.zeros(0, np.uint32)]).astype(np.int64),
            "sequence_id": first + used + np.arange(total),
            "offset": np.zeros(total, np.int64),
        }
        out = pd.DataFrame({c: np.concatenate([cols[c], whole[c]]) for c in cols})
        out["doc_id"] = rows["doc_id"].astype("Int64").take(out["item"]).to_numpy(dtype=object, na_value=None)
        out["doc_tokens"] = rows["doc_tokens"].to_numpy()[out["item"]]
        return out[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return cut_documents(docs, tokenizer_json, bins, capacity, end_id).groupBy("bin").applyInPandas(pack_bin, PIECES)
