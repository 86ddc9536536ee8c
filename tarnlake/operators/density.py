"""Clusters by density: prototypes of many vectors, HDBSCAN over the prototypes, members of its clusters.

Vectors stay where they are; what every task holds in full are the prototypes (at most
MOST_POINTS, checked).  The minimum spanning tree of mutual reachability is made in
Boruvka rounds: each task finds, for its rows, the lightest edge out of each component;
the rounds' minima meet by a group-by.  Edges are ordered by (weight, lower, higher
index), so the tree, and with it the result, does not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.store import written

MOST_POINTS = 50_000
NEIGHBOURS = 24
ROWS = 256


# -- prototypes -----------------------------------------------------------------------------
def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return _unit(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims))


def nearest_prototype(rows: DataFrame, prototypes: np.ndarray) -> DataFrame:
    """id, v, proto (the lowest of the nearest by cosine), similarity; ``rows``: id, v."""
    dims = prototypes.shape[1]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                own = b.slice(at, 1024)
                s = _vectors(own.column("v"), dims) @ prototypes.T
                best = s.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("v"), pa.array(best.astype(np.int32)), pa.array(s[np.arange(len(s)), best])], names=["id", "v", "proto", "similarity"])

    kind = dict(rows.dtypes)
    return rows.select("id", "v").mapInArrow(near, f"id {kind['id']}, v {kind['v']}, proto int, similarity double")


def _chance(seed: int, step: int):
    """A number in [0, 1) of each row, from its id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(step), F.col("id")), F.lit(1 << 40)) / float(1 << 40)


def _collected(rows: DataFrame, dims: int) -> np.ndarray:
    got = rows.orderBy("id").select("v").toArrow().column("v").combine_chunks()
    return _vectors(got, dims) if len(got) else np.zeros((0, dims))


def seeds(rows: DataFrame, dims: int, k: int, seed: int, rounds: int = 5) -> np.ndarray:
    """k starts: candidates drawn in a few passes with chances by 1 - cosine to those before, then k of them by weighted draws."""
    first = rows.orderBy(_chance(seed, 0), "id").limit(1)
    found = _collected(first, dims)
    for step in range(1, rounds + 1):
        far = nearest_prototype(rows, found).withColumn("cost", F.greatest(1 - F.col("similarity"), F.lit(0.0)))
        total = far.agg(F.sum("cost")).head()[0] or 0.0
        if total <= 1e-12:
            break
        drawn = far.filter(_chance(seed, step) * total < F.col("cost") * k)  # k expected in a pass
        found = np.unique(np.concatenate([found, _collected(drawn.select("id", "v"), dims)]), axis=0)
    if len(found) <= k:
        return found
    counts = nearest_prototype(rows, found).groupBy("proto").count().collect()
    weight = np.zeros(len(found))
    for r in counts:
        weight[r["proto"]] = r["count"]
    draw, chosen = np.random.default_rng(seed), []
    cost = weight.copy()
    near = np.full(len(found), -1.0)
    for _ in range(k):
        p = cost if cost.sum() > 0 else np.ones(len(found))
        chosen.append(int(draw.choice(len(found), p=p / p.sum())))
        near = np.maximum(near, found @ found[chosen[-1]])
        cost = weight * np.maximum(1 - near, 0)
    return found[sorted(set(chosen))]


def spherical_kmeans(df: DataFrame, id_col: str, vector_col: str, k: int, iters: int = 15, seed: int = 42) -> tuple[np.ndarray, DataFrame]:
    """(prototypes: unit vectors; id, proto, similarity of each vector).

    A prototype without members is placed anew on one of the vectors that are worst served
    (lowest similarity, then id).  Null vectors are left out; ids must be distinct.
    """
    if k > MOST_POINTS:
        raise ValueError("too many prototypes")
    rows = written(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("v is not null"), "vectors")
    head = rows.select(F.size("v")).head()
    if head is None:
        return np.zeros((0, 0)), rows.select("id", F.lit(0).alias("proto"), F.lit(0.0).alias("similarity"))
    dims = head[0]
    protos = seeds(rows, dims, k, seed)
    for _ in range(iters):
        now = nearest_prototype(rows, protos)

        def summed(batches: Iterator[pa.RecordBatch], k: int = len(protos)) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((k, dims)), np.zeros(k, np.int64)
            for b in batches:
                p = b.column("proto").to_numpy()
                np.add.at(total, p, _vectors(b.column("v"), dims))
                n += np.bincount(p, minlength=k)
            own = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(list(total[own]), pa.list_(pa.float64()))], names=["proto", "s"])

        parts = now.select("v", "proto").mapInArrow(summed, "proto int, s array<double>").select("proto", F.posexplode("s").alias("i", "x")).groupBy("proto", "i").agg(F.sum("x").alias("x"))
        fresh = np.zeros_like(protos)
        for r in parts.collect():  # prototypes x dimensions
            fresh[r["proto"], r["i"]] = r["x"]
        empty = np.flatnonzero(np.linalg.norm(fresh, axis=1) <= 1e-12)
        fresh = _unit(fresh)
        if len(empty):
            worst = _collected(now.orderBy("similarity", "id").limit(len(empty)).select("id", "v"), dims)
            fresh[empty[: len(worst)]] = worst
        done = np.abs(fresh - protos).max() < 1e-9
        protos = fresh
        if done:
            break
    return protos, nearest_prototype(rows, protos).select("id", "proto", "similarity")


# -- spanning tree -----------------------------------------------------------------------------
def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, row by row."""
    return ((x - y) ** 2).sum(axis=1)


def _approximate(x: np.ndarray, points: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + norms - 2 * (x @ points.T), 0)


def neighbour_lists(spark: SparkSession, points: np.ndarray, m: int) -> DataFrame:
    """row, near (indexes), far (their squared distances, ascending): the m nearest of each point, itself first."""
    n, shared = len(points), spark.sparkContext.broadcast(points)
    m = min(m, n)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        norms = (x * x).sum(axis=1)
        slack = 1e-12 * (1 + norms.max())
        for b in batches:
            ids = b.column(0).to_numpy()
            for at in range(0, len(ids), ROWS):
                own = ids[at : at + ROWS]
                d = _approximate(x[own], x, norms)
                d[np.arange(len(own)), own] = -1  # a point is its own first neighbour
                edge = np.partition(d, m - 1, axis=1)[:, m - 1] + 2 * slack
                near, far = [], []
                for i, row in zip(own, d, strict=True):
                    c = np.flatnonzero(row <= edge[np.searchsorted(own, i)])  # all that may belong, by exact distance then
                    e = squared(x[c], x[i])
                    order = np.lexsort((c, e, c != i))[:m]
                    near.append(c[order])
                    far.append(e[order])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(near, pa.list_(pa.int64())), pa.array(far, pa.list_(pa.float64()))], names=["row", "near", "far"])

    return written(spark.range(0, n, 1, min(n // ROWS + 1, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(lists, "row long, near array<long>, far array<double>"), "neighbours")


def _lightest(lists: DataFrame, points: np.ndarray, core: np.ndarray, part: np.ndarray) -> list:
    """One round: for each component its lightest edge to another, as (component, weight, lower, higher)."""
    sc = lists.sparkSession.sparkContext
    shared, state = sc.broadcast(points), sc.broadcast((core, part))

    def out_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, (core, part) = shared.value, state.value
        norms = (x * x).sum(axis=1)
        slack = 4e-12 * (1 + norms.max())
        best: dict[int, tuple[float, int, int]] = {}

        def offer(i: int, js: np.ndarray, d: np.ndarray) -> tuple[float, int, int] | None:
            if not len(js):
                return None
            w = np.maximum(np.maximum(core[i], core[js]), d)
            lo, hi = np.minimum(i, js), np.maximum(i, js)
            k = np.lexsort((hi, lo, w))[0]
            edge = (float(w[k]), int(lo[k]), int(hi[k]))
            p = int(part[i])
            if p not in best or edge < best[p]:
                best[p] = edge
            return edge

        for b in batches:
            open_rows = []
            for i, near, far in zip(*(b.column(c).to_pylist() for c in ("row", "near", "far")), strict=True):
                near, far = np.array(near), np.array(far)
                other = part[near] != part[i]
                edge = offer(i, near[other], far[other])
                # points that are not in the list are at least as far as its last one
                if len(near) < len(x) and (edge is None or edge[0] >= far[-1]) and not (max(core[i], far[-1]) > best.get(int(part[i]), (np.inf,))[0]):
                    open_rows.append(i)
            for at in range(0, len(open_rows), ROWS):
                own = np.array(open_rows[at : at + ROWS])
                d = _approximate(x[own], x, norms)
                for i, row in zip(own, d, strict=True):
                    w = np.maximum(np.maximum(core[i], core), row)
                    w[part == part[i]] = np.inf
                    js = np.flatnonzero(w <= w.min() + slack)
                    offer(int(i), js, squared(x[js], x[i]))
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), *(pa.array([e[k] for e in best.values()], t) for k, t in enumerate((pa.float64(), pa.int64(), pa.int64())))], names=["part", "w", "lo", "hi"])

    found = lists.mapInArrow(out_edges, "part long, w double, lo long, hi long")
    return found.groupBy("part").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("part", "e.*").collect()


def spanning_tree(spark: SparkSession, points: np.ndarray, min_samples: int) -> np.ndarray:
    """Edges (squared weight, lower, higher) of the minimum spanning tree of mutual reachability, lightest first."""
    n = len(points)
    if n > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points: make prototypes first")
    if n < 2:
        return np.zeros((0, 3))
    lists = neighbour_lists(spark, points, max(min_samples, NEIGHBOURS))
    core = np.zeros(n)
    for r in lists.select("row", F.element_at("far", min(min_samples, n)).alias("core")).collect():
        core[r["row"]] = r["core"]
    part, edges = np.arange(n), set()
    while len(edges) < n - 1:
        up = {}
        for r in _lightest(lists, points, core, part):
            edges.add((r["w"], r["lo"], r["hi"]))
            a, b = (_root(up, int(part[r[c]])) for c in ("lo", "hi"))
            up[max(a, b)] = min(a, b)
        part = np.array([_root(up, int(p)) for p in part])
    return np.array(sorted(edges))


def _root(up: dict, a: int) -> int:
    while up.get(a, a) != a:
        up[a] = up.get(up[a], up[a])
        a = up[a]
    return a


# -- clusters of the tree ------------------------------------------------------------------------
def _merges(edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Children, weight and size of each inner node of the tree of merges, which follow the points' numbers."""
    children, weight, size = np.zeros((n - 1, 2), int), np.zeros(n - 1), np.ones(2 * n - 1, int)
    up, top = {}, np.arange(n)
    for k, (w, lo, hi) in enumerate(edges):
        a, b = _root(up, int(lo)), _root(up, int(hi))
        children[k], weight[k] = (top[a], top[b]), w
        size[n + k] = size[top[a]] + size[top[b]]
        up[b] = a
        top[a] = n + k
    return children, weight, size


def tree_clusters(edges: np.ndarray, n: int, min_cluster_size: int) -> tuple[np.ndarray, np.ndarray]:
    """(label of each point or -1, its membership probability): clusters of most excess of mass.

    Going down the tree of merges, a cluster splits where both sides have at least
    ``min_cluster_size`` points; otherwise points fall out of it, at density 1 / distance.
    The density of distance 0 is twice that of the smallest other one.  A cluster is chosen
    where its own excess of mass is not less than that of the chosen ones below it; the
    whole is none.  Labels go by the clusters' lowest points.
    """
    labels, probability = np.full(n, -1), np.zeros(n)
    if n < 2 or n < min_cluster_size:
        return labels, probability
    children, weight, size = _merges(edges, n)
    positive = weight[weight > 0]
    density = 1 / np.sqrt(np.maximum(weight, positive.min() / 4 if len(positive) else 1.0))

    born, above, fell = [0.0], [-1], np.zeros(n)  # clusters: density at birth, parent; points: density at which they fall
    home = np.zeros(n, int)
    mass, last = [0.0], [0.0]

    def leave(cluster: int, node: int, at: float) -> None:
        stack = [node]
        while stack:
            x = stack.pop()
            if x < n:
                home[x], fell[x] = cluster, at
                mass[cluster] += at - born[cluster]
                last[cluster] = max(last[cluster], at)
            else:
                stack += children[x - n].tolist()

    todo = [(2 * n - 2, 0)]
    while todo:
        node, cluster = todo.pop()
        at, sides = density[node - n], children[node - n].tolist()
        big = [s for s in sides if size[s] >= min_cluster_size]
        for s in sides:
            if s not in big:
                leave(cluster, s, at)
            elif len(big) == 2 or s < n:
                mass[cluster] += (at - born[cluster]) * size[s]
                last[cluster] = max(last[cluster], at)
                born.append(at)
                above.append(cluster)
                mass.append(0.0)
                last.append(0.0)
                if s < n:
                    leave(len(born) - 1, s, at)
                else:
                    todo.append((s, len(born) - 1))
            else:
                todo.append((s, cluster))
    m = len(born)
    below, best, chosen = np.zeros(m), np.array(mass), np.ones(m, bool)
    for c in range(m - 1, 0, -1):  # a cluster's number is above its parent's
        if below[c] > best[c]:
            best[c], chosen[c] = below[c], False
        below[above[c]] += best[c]
    chosen[0] = False
    of = np.full(m, -1)
    for c in range(1, m):
        of[c] = of[above[c]] if of[above[c]] >= 0 else c if chosen[c] else -1
    numbers: dict[int, int] = {}
    for p in range(n):
        c = int(of[home[p]])
        if c >= 0:
            labels[p] = numbers.setdefault(c, len(numbers))
            probability[p] = min(fell[p], last[c]) / last[c] if last[c] > 0 else 1.0
    return labels, probability


def hdbscan(spark: SparkSession, points: np.ndarray, min_cluster_size: int = 5, min_samples: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(labels, probabilities) of at most MOST_POINTS points; -1 is noise.  A point counts among its own ``min_samples``."""
    if min_cluster_size < 2 or min_samples < 1:
        raise ValueError("min_cluster_size is at least 2, min_samples at least 1")
    points = np.ascontiguousarray(points, dtype=np.float64)
    return tree_clusters(spanning_tree(spark, points, min_samples), len(points), min_cluster_size)


# -- members --------------------------------------------------------------------------------------
def members(assigned: DataFrame, labels: np.ndarray, probability: np.ndarray, least: float = 0.60, full: float = 0.85, min_members: int = 25) -> DataFrame:
    """id, cluster_id (-1: noise), probability: vectors by their prototype's cluster.

    A vector is a member from similarity ``least`` on; its probability is the prototype's,
    times a ramp from ``least`` to ``full``.  Clusters with fewer than ``min_members``
    become noise; the others are numbered anew in their order.  ``assigned``: id, proto,
    similarity.
    """
    if full <= least:
        raise ValueError("full must be greater than least")
    spark = assigned.sparkSession
    table = spark.createDataFrame([(k, int(c), float(p)) for k, (c, p) in enumerate(zip(labels, probability, strict=True))], "proto int, label int, weight double")
    ramp = F.least(F.lit(1.0), (F.col("similarity") - least) / (full - least))
    inside = (F.col("label") >= 0) & (F.col("similarity") >= least)
    x = assigned.join(F.broadcast(table), "proto")  # a row for each prototype
    x = x.select("id", F.when(inside, F.col("label")).otherwise(-1).alias("label"), F.when(inside, F.col("weight") * ramp).otherwise(0.0).alias("probability"))
    sizes = {r["label"]: r["count"] for r in x.filter("label >= 0").groupBy("label").count().collect()}  # a row for each cluster
    kept = sorted(c for c, size in sizes.items() if size >= min_members)
    number = F.create_map(*[F.lit(v) for k, c in enumerate(kept) for v in (c, k)]) if kept else F.create_map().cast("map<int,int>")
    to = F.coalesce(F.element_at(number, F.col("label")), F.lit(-1))
    return x.select("id", to.alias("cluster_id"), F.when(to >= 0, F.col("probability")).otherwise(0.0).alias("probability"))


def density_clusters(df: DataFrame, id_col: str, vector_col: str, k: int, min_cluster_size: int = 5, min_samples: int = 3, iters: int = 15, seed: int = 42, **membership) -> DataFrame:
    """id, cluster_id, probability of all vectors: prototypes, their HDBSCAN, members."""
    protos, assigned = spherical_kmeans(df, id_col, vector_col, k, iters, seed)
    labels, probability = hdbscan(df.sparkSession, protos, min_cluster_size, min_samples)
    return members(assigned, labels, probability, **membership).withColumnRenamed("id", id_col)


def extended(df: DataFrame, id_col: str, vector_col: str, centroids: np.ndarray, ids: list[str], known: DataFrame, changed_col: str, least: float = 0.60, full: float = 0.85) -> DataFrame:
    """id_col, cluster_id, probability, kept: yesterday's members, with new and changed vectors put to the nearest centroid.

    ``known``: id_col, cluster_id, probability; rows of it stay as they are where
    ``changed_col`` is false and the vector is still there.  A null cluster is noise.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), changed_col)
    old = known.select(F.col(id_col).alias("id"), F.col("cluster_id").alias("was"), F.col("probability").alias("was_probability"), F.lit(True).alias("has"))
    both = rows.join(old, "id", "left")
    stays = F.coalesce("has", F.lit(False)) & ~F.col(changed_col)
    kept = both.filter(stays).select("id", F.col("was").alias("cluster_id"), F.col("was_probability").alias("probability"), F.lit(True).alias("kept"))
    fresh = both.filter(~stays & F.col("v").isNotNull()).select("id", "v")
    names = F.array(*[F.lit(i) for i in ids])
    near = nearest_prototype(fresh, _unit(centroids))
    inside = F.col("similarity") >= least
    put = near.select("id", F.when(inside, F.element_at(names, F.col("proto") + 1)).alias("cluster_id"), F.when(inside, F.least(F.lit(1.0), (F.col("similarity") - least) / (full - least))).otherwise(0.0).alias("probability"), F.lit(False).alias("kept"))
    return kept.unionByName(put).withColumnRenamed("id", id_col)
