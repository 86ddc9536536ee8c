"""Nearest neighbours by shifted space-filling curves, completed exactly.

Directions of the vectors are projected by several random rotations to a few
dimensions, shifted, and ordered along a Hilbert curve; Spark deals all curves out by
range of key in one sort.  A curve is cut into cells of neighbouring keys.  Each query
goes to the cells its window touches on every curve, is scored there on the original
vectors, and the curves' answers merge.  How many curves and how wide a window it takes
for the wanted recall is measured against brute force on a few queries.  Where the
vectors have many independent dimensions, neighbours are scattered over any curve and
the windows grow to much of the table.

An exact check may follow: the queries also go to the other cells of the first curve,
unless a cell's ball (centre and radius) can't hold a score that would count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import written

DIMENSIONS, BITS = 8, 7
#: Cells whose balls are held in a worker to leave queries out; of more cells, all are asked.
MOST_BALLS = 20_000
FOUND = "query_id long, vec_id long, score double"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell coordinates (n x d, below 2**bits)."""
    x = cells.T.astype(np.int64).copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):  # undo the curve's rotations, from the coarsest level on
        low = (1 << b) - 1
        for i in range(d):
            flip = (x[i] >> b) & 1 == 1
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, d):  # Gray code across the dimensions
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t ^= np.where((x[d - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b) & 1
    return key


def curve_keys(x: np.ndarray, curve: int) -> np.ndarray:
    """Keys of vectors on one curve; rotation and shift depend on its number only."""
    rng = np.random.default_rng([20, curve, x.shape[1]])
    basis = np.linalg.qr(rng.standard_normal((x.shape[1], min(DIMENSIONS, x.shape[1]))))[0]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    spread = np.tanh((unit @ basis) * np.sqrt(x.shape[1]) * 0.6) / 2 + 0.5  # about even over (0, 1)
    place = spread / 2 + rng.random(basis.shape[1]) / 2
    return hilbert_keys(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, summed in the order of the components: equal rows give equal sums."""
    out = a[..., 0] * b[..., 0]
    for k in range(1, a.shape[-1]):
        out = out + a[..., k] * b[..., k]
    return out


def _best(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of flat (query, id, score) the k first of each query: score descending, then id; an id once, by its best score."""
    order = np.lexsort((-scores, ids, queries))
    q, i = queries[order], ids[order]
    order = order[np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])][: len(q)]]
    queries, ids, scores = queries[order], ids[order], scores[order]
    order = np.lexsort((ids, -scores, queries))
    q = queries[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    keep = order[rank < k]
    return queries[keep], ids[keep], scores[keep]


# -- places on the curves -----------------------------------------------------
def _places(base: DataFrame, dims: int, curves: int, n: int) -> DataFrame:
    """id, h, curve, pos: the place of each row on each curve.

    One sort by (curve, key) of rows without vectors, dealt by range; every curve has all
    ``n`` rows, so places follow from the number of rows in the partitions before.
    """
    schema = "id long, h long, curve int, key long"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"), dims)
            for t in range(curves if b.num_rows else 0):
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), pa.array(np.full(b.num_rows, t, np.int32)), pa.array(curve_keys(x, t))], names=["id", "h", "curve", "key"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), b.column("curve"), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))], names=["id", "h", "curve", "part", "local"])
            at += b.num_rows

    order = ["curve", "key", "h", "id"]
    rows = base.select("id", "h", "v").mapInArrow(keyed, schema).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.mapInArrow(numbered, "id long, h long, curve int, part int, local long"), "places")
    starts, at = {}, 0
    for part, count in sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect()):  # a row for each partition
        starts[part], at = at, at + count
    start = F.element_at(F.create_map(*[F.lit(x) for p, s in starts.items() for x in (p, s)]), F.col("part"))
    return rows.select("id", "h", "curve", (start + F.col("local") - F.col("curve").cast("long") * n).alias("pos"))


def _true_neighbours(base: DataFrame, queries: pa.Table, dims: int, k: int) -> DataFrame:
    """The nearest of a few queries, by all rows."""
    q_ids, q = queries.column("id").to_numpy(), _matrix(queries.column("v").combine_chunks(), dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, s = b.column("id").to_numpy(), q @ _matrix(b.column("v"), dims).T
            found = _best(np.repeat(q_ids, len(ids)), np.tile(ids, len(q_ids)), np.where(q_ids[:, None] == ids, -np.inf, s).ravel(), k)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return _top(base.select("id", "v").mapInArrow(run, FOUND).filter(F.col("score") > float("-inf")), k)


def window_width(base: DataFrame, places: DataFrame, dims: int, every: int, k: int, curves: int, recall: float, sample: int, cell_rows: int) -> tuple[int, int]:
    """Number of curves and width of the windows that find ``recall`` of the neighbours.

    Measured against brute force for ``sample`` queries, those of least hash: the widths
    come from how far apart on the curves they and their true neighbours are.
    """
    chosen = base.filter(F.col("id") % every == 0).orderBy(F.xxhash64("id", F.lit(1)), "h").select("id", "v").limit(sample).toArrow()
    pairs = [(r["query_id"], r["vec_id"]) for r in _true_neighbours(base, chosen, dims, k).collect()]
    if not pairs:
        return 1, 1
    spots: dict[int, dict[int, list[int]]] = {}
    for r in places.filter(F.col("id").isin(sorted({x for p in pairs for x in p}))).collect():  # sample * (k + 1) * curves
        spots.setdefault(r["id"], {}).setdefault(r["curve"], []).append(r["pos"])
    apart = np.array([[min(abs(a - b) for a in spots[q][t] for b in spots[v][t]) for t in range(curves)] for q, v in pairs])
    best = None
    for use in range(1, curves + 1):
        width = int(np.quantile(apart[:, :use].min(axis=1), recall, method="higher")) + 1
        cost = use * (2 * width + cell_rows)
        if best is None or cost < best[0]:
            best = (cost, use, width)
    return best[1:]


# -- cells --------------------------------------------------------------------
def _scored(dims: int, k: int):
    """The k best of one cell's rows for the queries that came to it, where they reach the score to beat."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if rows.num_rows and asked.num_rows:
            ids, x = rows.column("id").to_numpy(), _matrix(rows.column("v").combine_chunks(), dims)
            q_ids, q, floor = asked.column("q_id").to_numpy(), _matrix(asked.column("q_v").combine_chunks(), dims), asked.column("q_floor").to_numpy()
            # An id may have several vectors: so many rows hold k + 1 ids.
            enough = (k + 1) * int(np.unique(ids, return_counts=True)[1].max())
            for at in range(0, len(q), 512):
                s = q[at : at + 512] @ x.T
                least = floor[at : at + 512]
                if s.shape[1] >= enough:
                    least = np.maximum(least, np.partition(s, -enough, axis=1)[:, -enough])
                # The product's rounding depends on the place: take a margin, then sum row by row.
                r, c = np.nonzero(s >= least[:, None] - 1e-9 * np.maximum(1.0, np.abs(least[:, None])))
                other = q_ids[at + r] != ids[c]
                r, c = at + r[other], c[other]
                new = (q_ids[r], ids[c], dots(q[r], x[c]))
                found = [np.concatenate(p) for p in zip(found, _best(*new, k), strict=True)]
        return pa.table([pa.array(y) for y in found], names=["query_id", "vec_id", "score"])

    return run


def _answers(rows: DataFrame, asked: DataFrame, keys: list[str], dims: int, k: int, at_once: int) -> DataFrame:
    """FOUND of each key's rows (a cell) for its queries, of which a task gets about 4,096."""
    shares = max(1, -(-at_once // 4096))
    a = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))) if shares > 1 else F.lit(0))
    b = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns], F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int").alias("q_share"))
    return a.groupBy(*keys, "share").cogroup(b.groupBy(*[f"q_{c}" for c in keys], "q_share")).applyInArrow(_scored(dims, k), FOUND)


def _windows(placed: DataFrame, dims: int, every: int, k: int, width: int, cell_rows: int, n: int) -> DataFrame:
    """Each curve is cut into cells; a query goes to the cells that its window touches.

    Its own cells come first and give it a score to beat in the others, which so return few
    rows however wide the window is.
    """
    cell = lambda pos: F.floor(pos / cell_rows)
    at = placed.withColumn("cell", cell(F.col("pos")))
    rows, queries = at.select("curve", "cell", "id", "v"), at.filter(F.col("id") % every == 0)
    own = queries.select("curve", "cell", "id", "v", F.lit(float("-inf")).alias("floor"))
    near = written(_top(_answers(rows, own, ["curve", "cell"], dims, k, cell_rows // every + 1), k).drop("rank"), "near")
    touched = F.sequence(cell(F.greatest(F.col("pos") - width, F.lit(0))), cell(F.least(F.col("pos") + width, F.lit(n - 1))))
    others = queries.join(_floors(near, k), "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    others = others.select("curve", F.explode(F.array_remove(touched, F.col("cell"))).alias("cell"), "id", "v", "floor")
    return near.unionByName(_answers(rows, others, ["curve", "cell"], dims, k, (2 * width + cell_rows) // every + 1))


def _floors(found: DataFrame, k: int) -> DataFrame:
    """id, floor: the k-th score of each query, minus infinity where it has fewer answers."""
    kth = F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf")))
    return found.groupBy(F.col("query_id").alias("id")).agg(kth.alias("floor"))


def _rest(placed: DataFrame, merged: DataFrame, dims: int, every: int, k: int, width: int, cell_rows: int, n: int) -> DataFrame:
    """What the windows on the first curve left out: its other cells, but for those whose
    ball (centre and radius) can't hold a better score than the k-th found."""
    cells = -(-n // cell_rows)
    first = placed.filter("curve = 0").withColumn("cell", F.floor(F.col("pos") / cell_rows))
    q = first.filter(F.col("id") % every == 0).join(_floors(merged, k), "id", "left")
    lo, hi = F.floor(F.greatest(F.col("pos") - width, F.lit(0)) / cell_rows), F.floor(F.least(F.col("pos") + width, F.lit(n - 1)) / cell_rows)
    q = q.select("id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), lo.alias("lo"), hi.alias("hi"))
    balls = None
    if cells <= MOST_BALLS:

        def ball(rows: pa.Table) -> pa.Table:
            x = _matrix(rows.column("v").combine_chunks(), dims)
            centre = x.mean(axis=0)
            return pa.table({"cell": rows.column("cell")[:1], "centre": [centre], "radius": [np.linalg.norm(x - centre, axis=1).max()]})

        t = first.select("cell", "v").groupBy("cell").applyInArrow(ball, "cell long, centre array<double>, radius double").toArrow().sort_by("cell")
        balls = (t.column("cell").to_numpy(), _matrix(t.column("centre").combine_chunks(), dims), t.column("radius").to_numpy())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                own = b.slice(at, 256)
                lo, hi, floor = (own.column(c).to_numpy() for c in ("lo", "hi", "floor"))
                every_cell = balls[0] if balls else np.arange(cells)
                may = (every_cell < lo[:, None]) | (every_cell > hi[:, None])
                if balls:
                    x = _matrix(own.column("v"), dims)
                    may &= x @ balls[1].T + np.linalg.norm(x, axis=1)[:, None] * balls[2] >= floor[:, None] - 1e-9 * np.maximum(1.0, np.abs(floor[:, None]))
                for i, j in zip(*(np.array_split(y, max(1, len(y) // 4096)) for y in np.nonzero(may)), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(every_cell[j]), own.column("id").take(i), own.column("v").take(i), own.column("floor").take(i)], names=["cell", "id", "v", "floor"])

    asked = q.mapInArrow(dealt, "cell long, id long, v array<double>, floor double")
    return _answers(first.select("cell", "id", "v"), asked, ["cell"], dims, k, n // every + 1)


def _top(found: DataFrame, k: int) -> DataFrame:
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, curves: int = 16, recall: float = 0.92, sample: int = 64, cell_rows: int = 2048, exact: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by inner product of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are the rows of
    other ids.  Ties go to the smaller id.  An id has one place at most, however many rows
    it has; of several vectors of an id the best score counts, on either side.  Vectors
    that are null, zero, hold null or non-finite components or (an extension) have another
    length than most take no part, nor do null ids, which are read as long; an empty table
    gives an empty one.  Other columns are ignored.  ``recall`` is that of the windows on
    up to ``curves`` curves, measured on ``sample`` queries; ``exact=False`` returns their
    answers.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    src = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    src = src.filter(F.coalesce(fine, F.lit(False)))
    lengths = src.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = lengths["d"]
    # Repeated rows go first; the partial aggregate keeps one of them for each task.
    valid = src.filter(F.size("v") == dims).withColumn("h", F.xxhash64("v")).groupBy("id", "h").agg(F.first("v").alias("v"))
    base = written(valid, "vectors")
    n = base.count()
    places = _places(base, dims, curves, n)
    use, width = window_width(base, places, dims, every, k, curves, recall, sample, cell_rows)
    spots = places.filter(F.col("curve") < use).groupBy("id", "h").agg(F.collect_list(F.struct("curve", "pos")).alias("spots"))  # one a curve
    placed = written(base.join(spots, ["id", "h"]), "placed").select("id", "v", F.explode("spots").alias("s")).select("id", "v", "s.curve", "s.pos")
    merged = written(_top(_windows(placed, dims, every, k, width, cell_rows, n), k), "windows")
    if not exact:
        return merged.select("query_id", "rank", "vec_id", "score")
    found = merged.select("query_id", "vec_id", "score")
    return _top(found.unionByName(_rest(placed, merged, dims, every, k, width, cell_rows, n)), k).select("query_id", "rank", "vec_id", "score")
