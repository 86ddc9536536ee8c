"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _mirrored(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Hang a node's larger (or smaller-or-equal) neighbours onto its least neighbour.

    The least neighbour is an aggregate, partial before the shuffle; the join after it
    can be split where a node has very many neighbours.
    """
    e = _mirrored(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    out = e.join(least, "u")
    if large:
        out = out.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) of every node with an edge.

    ``edges``: u, v (long).  No rows give no rows; loops and repeated edges are ignored.
    """
    now = written(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        now = written(_step(_step(now, large=True), large=False), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
