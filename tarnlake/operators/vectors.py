"""Vector kernels: projection, clustering, centroids, exact neighbours, stable cluster ids."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.joins import top_n


def project(df: DataFrame, col: str, k: int) -> DataFrame:
    """``df`` with ``projected``: the k first principal components, scaled to unit length."""
    v = df.withColumn("__v", array_to_vector(F.col(col).cast("array<double>")))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(v)
    out = Normalizer(inputCol="__p", outputCol="__n").transform(model.transform(v))
    return out.withColumn("projected", vector_to_array("__n")).drop("__v", "__p", "__n")


def cluster(df: DataFrame, col: str, k: int, seed: int = 42) -> DataFrame:
    """``df`` with ``cluster_id`` from spherical k-means."""
    v = df.withColumn("__v", array_to_vector(F.col(col).cast("array<double>")))
    model = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="__v", predictionCol="cluster_id").fit(v)
    return model.transform(v).drop("__v")


def centroids(df: DataFrame, group: str, col: str) -> DataFrame:
    """group, centroid (unit mean), size; partial sums by group and component."""
    e = df.select(group, F.posexplode(col).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("size"))
    g = e.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"), F.max("size").alias("size"))
    g = g.withColumn("c", F.transform("c", lambda x: x["m"]))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    return g.select(group, F.transform("c", lambda x: F.try_divide(x, norm)).alias("centroid"), "size")


def best_assignment(gain: np.ndarray) -> list[int]:
    """Column of each row so that the sum of gains is largest (rows <= columns), by augmenting paths over potentials."""
    n, m = gain.shape
    cost = -gain.astype(float)
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        reach, via, closed = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, at = i, -1
        while True:
            slack = cost[row] - u[row] - v + (0 if at < 0 else reach[at])
            better = ~closed & (slack < reach)
            reach[better], via[better] = slack[better], at
            at = int(np.where(closed, np.inf, reach).argmin())
            closed[at] = True
            if row_of[at] < 0:
                break
            row = int(row_of[at])
        done = closed.copy()
        done[at] = False
        u[i] += reach[at]
        for j in np.flatnonzero(done):
            u[row_of[j]] += reach[at] - reach[j]
            v[j] -= reach[at] - reach[j]
        while at >= 0:
            before = int(via[at])
            row_of[at] = i if before < 0 else row_of[before]
            at = before
    out = [-1] * n
    for j, i in enumerate(row_of):
        if i >= 0:
            out[int(i)] = j
    return out


def match_clusters(old: dict, new: dict, least: float = 0.8, retired_days: dict | None = None, most_days: int = 90) -> dict:
    """New cluster id to the old one it continues: the pairing of largest total cosine, each id once, none under ``least``.

    Old ids with an entry in ``retired_days`` come back only within ``most_days``.
    Centroids are one row a cluster.
    """
    gone = retired_days or {}
    ids = sorted((a for a in old if gone.get(a, 0) <= most_days), key=str)
    fresh = sorted(new, key=str)
    if not ids or not fresh:
        return {}
    sim = np.array([[float(np.dot(old[a], new[b])) for a in ids] for b in fresh])
    gain = np.where(sim >= least, sim, 0.0)
    wide = np.hstack([gain, np.zeros((len(fresh), len(fresh)))])  # none is an answer, too
    return {fresh[k]: ids[j] for k, j in enumerate(best_assignment(wide)) if j < len(ids) and sim[k, j] >= least}


def recluster_due(days_since: int, share_new: float, share_unassigned: float, most_days: int = 30, most_new: float = 0.2, most_unassigned: float = 0.3) -> bool:
    """Whether clusters are to be made anew rather than extended."""
    return days_since >= most_days or share_new > most_new or share_unassigned > most_unassigned


def fit_temperature(rows: DataFrame, probability: str, truth: str, grid: list[float] | None = None) -> float:
    """The temperature of least log loss on labelled rows: all of a grid in one pass, then a finer one around the best."""
    q = F.least(F.greatest(F.col(probability), F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = F.log(q / (1 - q))

    def best(temperatures: list[float]) -> float:
        sign = F.when(F.col(truth), F.lit(1.0)).otherwise(-1.0)
        losses = rows.agg(*[F.sum(F.log1p(F.exp(-sign * logit / t))).alias(f"l{k}") for k, t in enumerate(temperatures)]).head()
        known = [(x, t) for x, t in zip(losses, temperatures, strict=True) if x is not None]
        return min(known)[1] if known else 1.0

    t = best(grid or [0.25 * 1.2**k for k in range(22)])
    return best([t * (0.84 + 0.02 * k) for k in range(19)])


def pool(rows: DataFrame, key: list[str], probability: str, weight: str) -> DataFrame:
    """key, pooled, agreement: log-linear pool of several deciders' probabilities."""
    q = F.least(F.greatest(F.col(probability), F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = F.log(q / (1 - q))
    g = rows.groupBy(*key).agg((F.sum(logit * F.col(weight)) / F.sum(weight)).alias("l"), F.count_if(q > 0.5).alias("yes"), F.count("*").alias("n"))
    return g.select(*key, (1 / (1 + F.exp(-F.col("l")))).alias("pooled"), (F.greatest(F.col("yes"), F.col("n") - F.col("yes")) / F.col("n")).alias("agreement"))


def cosine_pairs(rows: DataFrame, id_col: str, vector_col: str, few: DataFrame, few_id: str, few_vector: str, keep: list[str] | None = None) -> DataFrame:
    """id, few_id, similarity of every row with each of a few vectors, which are broadcast: bound their number before."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x = rows.select(id_col, *(keep or []), F.col(vector_col).alias("__v")).join(F.broadcast(few.select(few_id, F.col(few_vector).alias("__e"))), F.lit(True))
    score = F.try_divide(dot("__v", "__e"), F.sqrt(dot("__v", "__v") * dot("__e", "__e")))
    return x.select(id_col, *(keep or []), few_id, F.round(score, 6).alias("similarity"))


def cosine_top_k(rows: DataFrame, id_col: str, vector_col: str, queries: DataFrame, query_id: str, query_vector: str, k: int, most_queries: int = 1000) -> DataFrame:
    """query_id, id, score, rank of the k nearest rows by cosine of a few queries, the row of its own id apart.

    The queries are broadcast: more than ``most_queries`` are an error.  A zero vector has no cosine.
    """
    if queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError("too many queries for a broadcast")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    x = rows.join(F.broadcast(queries.select(F.col(query_id).alias("__q"), F.col(query_vector).alias("__e"))), F.col(id_col) != F.col("__q"))
    score = F.try_divide(dot(vector_col, "__e"), F.sqrt(dot(vector_col, vector_col) * dot("__e", "__e")))
    found = x.select(F.col("__q").alias(query_id), id_col, F.round(score, 6).alias("score")).filter("score is not null")
    return top_n(found, [query_id], k, F.desc("score"), F.asc(id_col))
