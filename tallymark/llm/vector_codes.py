"""Vector code compression: a codebook per part by integer k-means with Drake-Hamerly adaptive bounds.

Components become integers (``floor(scale * x)``); a vector is cut into ``parts`` equal parts and each part
position has a codebook of ``entries``. A part keeps an upper bound of the distance to its own entry, its
``b`` next entries in order with a lower bound each, and one outer bound for all others. After
entries move, bounds move by as much; a part whose upper bound is below all lower ones keeps its entry
unseen. Otherwise the distance to its own entry is taken, and then, if still uncertain, those of as many
of the listed entries as the bounds leave open, or of all. All of these are exact integer distances
with ties to the lower index; bounds are floats rounded outwards, so they only ever prove strict
order. ``b`` starts at a quarter of the entries and shrinks to the rank that all but ``rare`` of the parts need.

Each round reads the written table of the round before and writes its own (vector, entries, bounds,
and one row of sums a task); the round before is then deleted. Sums meet by (part, entry, position), so
what reaches the driver is the size of the codebooks.

Defined results: null vectors and those with null or non-finite components are dropped; other lengths
than that of the first kept vector have no code (null) and no error; a length that ``parts`` doesn't
divide is filled up with zeros; integers beyond ``LIMIT`` count as ``LIMIT`` (distances must fit a long);
with fewer kept vectors than entries the codebooks are as short; equal ids are ordered by vector, null ids
last; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tallymark.llm.shared import discard, fixed_binary, fixed_rows, joined_by_count, written

LIMIT = 1 << 27
SLACK = 1e-6
STATE = [("ints", pa.binary()), ("near", pa.binary()), ("bounds", pa.binary()), ("sums", pa.binary())]


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vec) of the rows that are kept."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & ~odd).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.cast("array<double>").alias("vec")
    )


def integers(flat: np.ndarray, dim: int, parts: int, scale: int) -> np.ndarray:
    """Vectors as integers, in ``parts`` parts (filled up with zeros)."""
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(flat.reshape(-1, dim) * scale), -LIMIT, LIMIT).astype(np.int64)
    width = max(1, -(-dim // parts))
    out = np.zeros((len(whole), parts * width), np.int64)
    out[:, :dim] = whole
    return out.reshape(-1, parts, width)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to one entry each (or to the one entry)."""
    d = x - entries
    return np.einsum("nw,nw->n", d, d)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + SLACK)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))


class Bounds:
    """Entries and bounds of one part position of a batch: ``near`` holds the own entry and the next
    ``b``, ``upper`` the bound of the own one, ``lower`` those of the next ``b`` and of all others."""

    def __init__(self, near: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.near, self.upper, self.lower = near, upper, lower

    @classmethod
    def fresh(cls, x: np.ndarray, book: np.ndarray, b: int) -> Bounds:
        out = cls(
            np.zeros((len(x), b + 1), np.uint8), np.zeros(len(x), np.float32), np.zeros((len(x), b + 1), np.float32)
        )
        out.search(np.arange(len(x)), x, book)
        return out

    def search(self, rows: np.ndarray, x: np.ndarray, book: np.ndarray) -> None:
        """Order all entries anew for some rows."""
        dist = np.stack([squares(x[rows], e) for e in book], 1)
        order = np.argsort(dist, axis=1, kind="stable")
        b = self.near.shape[1] - 1
        root = np.sqrt(np.take_along_axis(dist, order, 1).astype(np.float64))
        self.near[rows] = order[:, : b + 1]
        self.upper[rows] = _up(root[:, 0])
        self.lower[rows, :b] = _down(root[:, 1 : b + 1])
        self.lower[rows, b] = _down(root[:, b + 1]) if len(book) > b + 1 else np.inf

    def narrowed(self, b: int) -> Bounds:
        """Only ``b`` listed entries; the bounds of the others go into the outer one."""
        return Bounds(
            self.near[:, : b + 1],
            self.upper,
            np.concatenate([self.lower[:, :b], self.lower[:, b:].min(1, keepdims=True)], 1),
        )

    def moved(self, drift: np.ndarray) -> None:
        """Loosen the bounds by the way each entry went."""
        self.upper = _up(self.upper.astype(np.float64) + drift[self.near[:, 0]])
        way = np.concatenate([drift[self.near[:, 1:]], np.full((len(self.near), 1), drift.max())], 1)
        self.lower = _down(self.lower.astype(np.float64) - way)

    def open_ranks(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """How many of the listed entries may be as near as the own one; b + 1: unlisted ones too."""
        least = np.minimum.accumulate(self.lower[rows, ::-1], axis=1)[:, ::-1]
        return (self.upper[rows][:, None] >= least).sum(1)

    def assign(self, x: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Settle the uncertain rows by integer distances; how many rows needed each rank."""
        b = self.near.shape[1] - 1
        rows = np.flatnonzero(self.open_ranks())
        self.upper[rows] = _up(np.sqrt(squares(x[rows], book[self.near[rows, 0]]).astype(np.float64)))
        ranks = self.open_ranks(rows)
        for r in range(1, b + 1):
            some = rows[ranks == r]
            ids = self.near[some, : r + 1].astype(np.int64)
            dist = np.stack([squares(x[some], book[ids[:, j]]) for j in range(r + 1)], 1)
            order = np.lexsort((ids, dist), axis=1)
            root = np.sqrt(np.take_along_axis(dist, order, 1).astype(np.float64))
            self.near[some, : r + 1] = np.take_along_axis(ids, order, 1)
            self.upper[some] = _up(root[:, 0])
            self.lower[some, :r] = _down(root[:, 1:])
        self.search(rows[ranks == b + 1], x, book)
        return np.bincount(ranks, minlength=b + 2)


def _sums(x: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Count and component sums of each entry (exact: a batch's sums are far below 2**53)."""
    columns = [np.bincount(own, minlength=n)] + [np.bincount(own, x[:, j], n) for j in range(x.shape[1])]
    return np.stack(columns, 1).astype(np.int64)


def assigned(rows: DataFrame, schema: StructType, step: Callable, shape: tuple[int, int, int]) -> DataFrame:
    """State rows after ``step(batch) -> (kept columns, x, bounds by part, needed ranks)``, and a row of sums a task."""
    parts, n, width = shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, needed, names = np.zeros((parts, n, width + 1), np.int64), np.zeros(n + 2, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, states, ranks = step(batch)
            for p, s in enumerate(states):
                total[p] += _sums(x[:, p], s.near[:, 0], n)
            needed[: len(ranks)] += ranks
            flat = lambda a, t: np.stack(a, 1).reshape(len(x), -1).astype(t)
            names = [batch.column("vec_id").type, batch.column("label").type]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    fixed_binary(x.reshape(len(x), -1).astype(np.int32)),
                    fixed_binary(flat([s.near for s in states], np.uint8)),
                    fixed_binary(flat([np.column_stack([s.upper, s.lower]) for s in states], np.float32)),
                    pa.nulls(len(x), pa.binary()),
                ],
                names=["vec_id", "label", *(c for c, _ in STATE)],
            )
        if names:
            sums = np.concatenate([total.ravel(), needed]).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, t) for t in [*names, pa.binary(), pa.binary(), pa.binary()]] + [pa.array([sums], pa.binary())],
                names=["vec_id", "label", *(c for c, _ in STATE)],
            )

    return rows.mapInArrow(work, schema)


def task_sums(state: DataFrame, cells: int) -> np.ndarray:
    """The tasks' rows of sums, added up by cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for x in batch.column("sums").to_pylist():
                total += np.frombuffer(x, np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["cell", "n"])

    rows = state.where(F.col("sums").isNotNull()).select("sums").mapInArrow(work, "cell long, n long")
    out = np.zeros(cells, np.int64)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


def next_width(needed: np.ndarray, b: int, n: int, rare: float) -> int:
    """The least number of listed entries that all but ``rare`` of the parts can do with."""
    ranks = needed[: b + 1]
    beyond = ranks.sum() - np.cumsum(ranks)
    fits = np.flatnonzero(beyond <= rare * max(1, needed.sum()))
    return min(b, max(int(fits[0]), n // 8))


def compress(
    vectors: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    scale: int = 4096,
    rare: float = 0.01,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept vector, codes as one byte a part, and the codebooks
    (part, entry, position). ``entries`` may be 256 at most."""
    spark = vectors.sparkSession
    own = usable(vectors, id_col, vector_col, label_col)
    first = own.orderBy(F.col("vec_id").asc_nulls_last(), "vec").select("vec").limit(entries).collect()
    out = StructType([*own.schema.fields[:2], StructField("code", BinaryType()), *StructType.fromDDL("error long").fields])
    if not first:
        return spark.createDataFrame([], out), np.zeros((parts, 0, 1), np.int64)
    dim = len(first[0].vec)
    kept = own.where(F.size("vec") == dim)
    start = [r.vec for r in first if len(r.vec) == dim]
    if len(start) < len(first):
        rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").select("vec").limit(entries).collect()
        start = [r.vec for r in rows]
    books = np.ascontiguousarray(integers(np.array(start, float).ravel(), dim, parts, scale).swapaxes(0, 1)) if dim else (
        np.zeros((parts, len(start), 1), np.int64)
    )
    n, width = books.shape[1:]
    shape, b = (parts, n, width), min(max(1, n // 4), n - 1)
    state_type = StructType([*own.schema.fields[:2], *(StructField(c, BinaryType()) for c, _ in STATE)])

    def begin(batch: pa.RecordBatch, books=books, b=b) -> tuple:
        flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = integers(flat, dim, parts, scale) if dim else np.zeros((batch.num_rows, parts, 1), np.int64)
        states = [Bounds.fresh(x[:, p], books[p], b) for p in range(parts)]
        return x, states, np.bincount([b + 1], minlength=b + 2) * 0

    def loaded(batch: pa.RecordBatch, had: int, b: int, drift: np.ndarray) -> tuple[np.ndarray, list[Bounds]]:
        x = fixed_rows(batch.column("ints"), np.int32).reshape(-1, parts, width).astype(np.int64)
        near = fixed_rows(batch.column("near"), np.uint8).reshape(-1, parts, had + 1)
        bounds = fixed_rows(batch.column("bounds"), np.float32).reshape(-1, parts, had + 2)
        states = []
        for p in range(parts):
            s = Bounds(near[:, p].copy(), bounds[:, p, 0].copy(), bounds[:, p, 1:].copy()).narrowed(b)
            s.moved(drift[p])
            states.append(s)
        return x, states

    state, path = written(assigned(kept, state_type, begin, shape), "code-state")
    had = b
    for turn in range(rounds):
        sums = task_sums(state, parts * n * (width + 1) + n + 2)
        table, needed = sums[: -(n + 2)].reshape(parts, n, width + 1), sums[-(n + 2) :]
        count = table[:, :, :1]
        new = np.where(count > 0, table[:, :, 1:] // np.maximum(count, 1), books)
        drift = np.sqrt(((new - books).astype(np.float64) ** 2).sum(2)) * (1 + SLACK)
        books = new
        if turn:
            b = next_width(needed, had, n, rare)
        rows = state.where(F.col("sums").isNull()).drop("sums")

        def go_on(batch: pa.RecordBatch, books=books, had=had, b=b, drift=drift) -> tuple:
            x, states = loaded(batch, had, b, drift)
            ranks = sum(s.assign(x[:, p], books[p]) for p, s in enumerate(states))
            return x, states, ranks

        before = path
        state, path = written(assigned(rows, state_type, go_on, shape), "code-state")
        discard(spark, before)
        had = b

    def finish(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = fixed_rows(batch.column("ints"), np.int32).reshape(-1, parts, width).astype(np.int64)
            codes = fixed_rows(batch.column("near"), np.uint8).reshape(len(x), parts, -1)[:, :, 0]
            error = sum((squares(x[:, p], books[p][codes[:, p]]) for p in range(parts)), np.zeros(len(x), np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), fixed_binary(np.ascontiguousarray(codes)), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    rows = state.where(F.col("sums").isNull()).select("vec_id", "label", "ints", "near").mapInArrow(finish, out)
    apart = own.where(F.size("vec") != dim).selectExpr("vec_id", "label", "cast(null as binary) code", "cast(null as long) error")
    return rows.union(apart), books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def digests(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code (hex), error, label_error (over equal labels, nulls together), codebooks_sha256."""
    coded, books = compress(vectors, **options)
    coded, _ = written(coded, "codes")
    rows = coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.struct("label").alias("group"))
    sums = rows.groupBy("group").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return joined_by_count(rows, sums, "group", "n").select(
        "vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256")
    )
