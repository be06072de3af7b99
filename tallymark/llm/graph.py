"""Distributed union-find: connected components of an edge table by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large star) or not larger neighbours to the smallest one around it."""
    if large:
        around = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "other")
        least = around.groupBy("node").agg(F.min("other").alias("least"))
        out = around.where(F.col("other") > F.col("node")).join(least, "node")
        return out.select(F.col("other").alias("high"), F.least("least", "node").alias("low")).distinct()
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    out = edges.join(least, "high")
    links = out.where(F.col("low") > F.col("least")).select(F.col("low").alias("high"), F.col("least").alias("low"))
    return links.union(least.select("high", F.col("least").alias("low"))).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of ``pairs`` (two columns of one type) that is not its
    component's smallest node, which is the root. Any chain or star shape ends in a few rounds;
    each round is written to the shared folder. Nothing is gathered but two numbers per round."""
    a, b = pairs.columns
    edges = stored(
        pairs.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return edges.toDF("node", "root")
        mark = now
        edges = stored(_star(_star(edges, large=True), large=False), "edges")
