"""Duplicate findings: those of one entity that share a number and say the same, as connected groups.

Links come from an equi-join on what must be shared (a number's query, column and row key),
never from all pairs; groups come from least labels that are passed on and jumped over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.store import written

MOST_IN_GROUP = 200


def least_labels(edges: DataFrame, key: list[str], most_rounds: int = 40) -> DataFrame:
    """key, node, label: the least node that each node is connected with; ``edges``: key, a, b (nodes of one key are numbers).

    A round takes the least label among neighbours, then the label's own label, so long
    chains take a number of rounds that grows with their logarithm.
    """
    both = written(edges.select(*key, F.col("a").alias("node"), F.col("b").alias("next")).unionByName(edges.select(*key, F.col("b").alias("node"), F.col("a").alias("next"))).distinct(), "edges")
    now = written(both.groupBy(*key, "node").agg(F.least(F.col("node"), F.min("next")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(now.select(*key, F.col("node").alias("next"), "label"), [*key, "next"]).groupBy(*key, "node").agg(F.min("label").alias("seen"))
        step = now.join(near, [*key, "node"]).select(*key, "node", "label", F.least("label", "seen").alias("new"))
        jump = now.select(*key, F.col("node").alias("new"), F.col("label").alias("far"))
        after = written(step.join(jump, [*key, "new"], "left").select(*key, "node", F.col("label").alias("was"), F.least("new", F.coalesce("far", "new")).alias("label")), "labels")
        if after.filter("was <> label").isEmpty():
            return after.select(*key, "node", "label")
        now = after.drop("was")
    raise RuntimeError("groups did not settle")


def in_order(findings: DataFrame, entity: list[str]) -> DataFrame:
    """``findings`` with place (1, 2, ...) within their entity: most confidence times numbers first, then the oldest."""
    w = Window.partitionBy(*entity).orderBy(F.desc(F.col("confidence") * F.size("numbers")), F.asc("created_at"), F.asc("finding_id"))
    return findings.withColumn("place", F.row_number().over(w))


def links(placed: DataFrame, entity: list[str], least_cosine: float | None = None) -> DataFrame:
    """entity, a, b: places of findings that share a number and, with ``least_cosine``, are as near by their vectors; otherwise have equal sets of queries."""
    dot = F.aggregate(F.zip_with("a_v", "b_v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    says = ["vector"] if least_cosine is not None else [F.array_sort(F.array_distinct("query_ids")).alias("vector")]
    one = placed.select(*entity, "place", *says, F.explode(F.array_distinct(F.transform("numbers", lambda n: F.xxhash64(n["query_id"], n["column"], n["row_key"])))).alias("triple"))
    a = one.select(*entity, "triple", F.col("place").alias("a"), F.col("vector").alias("a_v"))
    b = one.select(*entity, "triple", F.col("place").alias("b"), F.col("vector").alias("b_v"))
    pairs = a.join(b, [*entity, "triple"]).filter(F.col("a") < F.col("b"))
    agree = F.col("a_v") == F.col("b_v") if least_cosine is None else F.col("a_v").isNotNull() & F.col("b_v").isNotNull() & (dot >= least_cosine)
    return pairs.filter(agree).select(*entity, "a", "b").distinct()


def duplicates(findings: DataFrame, entity: tuple[str, ...] = ("entity_type", "entity_id"), least_cosine: float | None = None, most: int = MOST_IN_GROUP) -> DataFrame:
    """keep_id, duplicate_id: of each group of linked findings of an entity the first in order stays, the others are its duplicates.

    ``findings``: finding_id, the entity's columns, confidence, created_at, numbers (array
    of query_id, column, row_key), query_ids, and vector (unit length) where
    ``least_cosine`` is given; without it, equal sets of queries count as saying the same.
    Only the first ``most`` of an entity are compared, as a rule of the operator.
    """
    own = list(entity)
    placed = written(in_order(findings, own).filter(F.col("place") <= most), "placed")
    groups = least_labels(links(placed, own, least_cosine=least_cosine), own).filter("node <> label")
    ids = placed.select(*own, "place", "finding_id")
    out = groups.join(ids.withColumnsRenamed({"place": "node", "finding_id": "duplicate_id"}), [*own, "node"])
    return out.join(ids.withColumnsRenamed({"place": "label", "finding_id": "keep_id"}), [*own, "label"]).select(*own, "keep_id", "duplicate_id")
