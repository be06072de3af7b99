"""Approximate nearest neighbours: a robust-pruned directed graph per shard, beam search over all shards.

Equal vectors are one point with the smallest ``k + 1`` of their ids (more can't be among the nearest
k of any query), found with a group limit before the shuffle, so a vector that makes up a third of
the rows is one point too. Points are dealt to shards of about ``shard_rows`` by a hash of the
vector; a task builds a shard's graph, which is written once. For the search every shard is shuffled once and
followed by the queries (as rows of a stream, sorted behind it), so a task holds one shard and one batch;
the number of tasks is in proportion to the shards. Each shard returns its k best by exact distance
in doubles, and the best k of all are the answer. Every query visits every shard: the work is queries times
shards, so larger shards lower it.

Graphs are built and walked on a shard's vectors moved to their mean and scaled to at most one (floats);
answers are ordered by distances of the vectors as given.

Defined results: null, zero or non-finite vectors and rows without an id take no part; vectors of
another length are compared with their like only; an id that occurs more than once counts with its
nearest vector and is never its own neighbour; ties go to the smaller id; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.pruned_graph import beam_search, build
from tallymark.llm.shared import part_count, stored

INDEX = "dim int, shard int, start int, points binary, graph binary, ids binary, copies binary"
SEARCH = "dim int, shard int, place long, vec_id long, vec array<double>, start int, points binary, graph binary, ids binary, copies binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec) of the rows that take part."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(
        F.col(id_col).isNotNull() & v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0)
    ).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vec"))


def scale_of(rows: np.ndarray) -> tuple[np.ndarray, float]:
    """Middle of the vectors' range, and the largest distance of a component from it."""
    low, high = rows.min(0), rows.max(0)
    middle = low / 2 + high / 2
    return middle, float(np.abs(rows - middle).max()) or 1.0


def scaled(rows: np.ndarray, middle: np.ndarray, most: float) -> np.ndarray:
    """Vectors as floats of a shard's own scale (queries far outside keep their direction)."""
    out = (rows - middle) / most
    far = np.abs(out).max(1, keepdims=True)
    return np.ascontiguousarray(out / np.maximum(far / 1e6, 1), np.float32)


def build_index(vectors: DataFrame, k: int, shard_rows: int, degree: int, beam: int, alpha: float) -> DataFrame:
    """A row per shard of (vec_id, vec): its points, graph and ids, written once."""
    by_vector = Window.partitionBy("vec").orderBy("vec_id")
    few = vectors.distinct().withColumn("copy", F.row_number().over(by_vector)).where(F.col("copy") <= k + 1)
    points = stored(few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-points")
    shards = -(-points.count() // shard_rows) or 1
    dealt = points.select(
        F.size("vec").alias("dim"), F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), "vec", "ids"
    ).repartition(4 * shards, "dim", "shard")

    def work(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        ids = group.column("ids").combine_chunks()
        order = np.argsort(ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]], kind="stable")
        ids = ids.take(pa.array(order))
        rows = group.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, dim)[order]
        graph, start = build(scaled(rows, *scale_of(rows)), degree, beam, alpha)
        flat = np.concatenate([np.asarray(x.as_py(), np.int64) for x in ids])
        copies = np.array([len(x) for x in ids], np.int32)
        one = lambda x, t=None: pa.array([x], t)
        return pa.table(
            {
                "dim": one(dim, pa.int32()),
                "shard": one(group.column("shard")[0].as_py(), pa.int32()),
                "start": one(start, pa.int32()),
                "points": one(rows.astype(np.float64).tobytes(), pa.binary()),
                "graph": one(graph.tobytes(), pa.binary()),
                "ids": one(flat.tobytes(), pa.binary()),
                "copies": one(copies.tobytes(), pa.binary()),
            }
        )

    return stored(dealt.groupBy("dim", "shard").applyInArrow(work, INDEX), "ann-index")


def search(index: DataFrame, queries: DataFrame, k: int, beam: int, block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found to each of (vec_id, vec)."""
    spark = index.sparkSession
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    parts = max(shards, part_count(spark))
    own = index.select("dim", "shard", F.lit(-1).cast("long").alias("place"), "start", "points", "graph", "ids", "copies")
    asked = queries.select(
        F.size("vec").alias("dim"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.lit(0).cast("long").alias("place"),
        "vec_id",
        "vec",
    )
    rows = own.unionByName(asked, allowMissingColumns=True).select(*(c.split()[0] for c in SEARCH.split(", ")))
    rows = rows.repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, waiting = None, None, ([], [])

        def answers() -> Iterator[pa.RecordBatch]:
            while waiting[0]:
                out = shard.answers(waiting[0][:block], np.array(waiting[1][:block]).reshape(-1, at[0]), k, beam)
                del waiting[0][:block], waiting[1][:block]
                score, vec_id, query_id = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score, pa.float64())],
                    names=["query_id", "vec_id", "score"],
                )

        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("dim", "shard", "place", "vec_id")))
            for i, (dim, number, place, vec_id) in enumerate(places):
                if place < 0:
                    yield from answers()
                    at = (dim, number)
                    shard = Shard(*(batch.column(c)[i].as_py() for c in ("dim", "start", "points", "graph", "ids", "copies")))
                elif at == (dim, number):
                    waiting[0].append(vec_id)
                    waiting[1].append(batch.column("vec")[i].values.to_numpy(zero_copy_only=False))
                    if len(waiting[0]) == block:
                        yield from answers()
        yield from answers()

    hits = rows.mapInArrow(work, "query_id long, vec_id long, score double")
    nearest = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = nearest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


class Shard:
    """A shard's points, graph and ids, ready for queries."""

    def __init__(self, dim: int, start: int, points: bytes, graph: bytes, ids: bytes, copies: bytes):
        self.start = start
        self.points = np.frombuffer(points, np.float64).reshape(-1, dim)
        self.scale = scale_of(self.points)
        self.floats = scaled(self.points, *self.scale)
        self.graph = np.frombuffer(graph, np.int32).reshape(len(self.points), -1)
        self.ids = np.frombuffer(ids, np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.frombuffer(copies, np.int32))])

    def answers(self, query_ids: list[int], wanted: np.ndarray, k: int, beam: int) -> list[tuple[float, int, int]]:
        """(score, vec_id, query_id) of the k nearest of the shard's ids to each query."""
        found, _ = beam_search(self.floats, self.graph, self.start, scaled(wanted, *self.scale), min(beam, len(self.points)))
        out = []
        for q, near, vec in zip(query_ids, found, wanted):
            near = near[near >= 0]
            score = np.sqrt(((self.points[near] - vec) ** 2).sum(1))
            best = np.argsort(score, kind="stable")[: 2 * k + 2]
            hits = [
                (s, v, q)
                for p, s in zip(near[best].tolist(), score[best].tolist())
                for v in self.ids[self.first[p] : self.first[p + 1]].tolist()
                if v != q
            ]
            out += sorted(hits)[:k]
        return out


def nearest(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    shard_rows: int = 4096,
    degree: int = 40,
    build_beam: int = 48,
    search_beam: int = 96,
    alpha: float = 1.2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The k nearest found of the rows whose id is divisible by ``every``, among all rows."""
    own = usable(vectors, id_col, vector_col)
    index = build_index(own, k, shard_rows, degree, build_beam, alpha)
    return search(index, own.where(F.col("vec_id") % every == 0).distinct(), k, search_beam)
