"""A written vector index: inverted lists with product codes, prefilter and exact refinement.

Vectors are scaled to unit length.  A vector lies in the list of its nearest centroid and
has a code of its residual.  The table is partitioned by list, so a search reads the probed
lists only; codes give an estimate of the cosine, the best estimates are scored again with
the vectors themselves.  Centroids and codebooks are fitted on a sample of at most
``sample`` vectors (by hash of the id); every vector is in the index.  It is written once
and opened by path as often as wanted.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators import density
from tarnlake.operators.joins import top_n

SAMPLE = 20_000


@dataclass
class Index:
    path: str
    centroids: np.ndarray  # lists x dimensions
    books: np.ndarray  # parts x entries x dimensions of a part
    sizes: np.ndarray  # rows of each list
    id_col: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/lists")


def _fit_books(x: np.ndarray, parts: int, entries: int, rounds: int, seed: int) -> np.ndarray:
    """k-means of each part of the sample's residuals; empty entries move to the farthest rows."""
    width = x.shape[1] // parts
    pick = np.random.default_rng(seed)
    books = []
    for p in range(parts):
        own = x[:, p * width : (p + 1) * width]
        book = own[pick.permutation(len(own))[: min(entries, len(own))]].copy()
        for _ in range(rounds):
            d = (own * own).sum(1)[:, None] + (book * book).sum(1) - 2 * own @ book.T
            at = d.argmin(axis=1)
            n = np.bincount(at, minlength=len(book))
            total = np.zeros_like(book)
            np.add.at(total, at, own)
            book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
            empty = np.flatnonzero(n == 0)
            if len(empty):
                book[empty] = own[np.argsort(-d.min(axis=1), kind="stable")[: len(empty)]]
        books.append(np.pad(book, ((0, entries - len(book)), (0, 0)), mode="edge"))
    return np.stack(books)


def build(df: DataFrame, id_col: str, vector_col: str, path: str, lists: int | None = None, parts: int = 8, entries: int = 64, keep: tuple[str, ...] = (), seed: int = 42, sample: int = SAMPLE) -> Index:
    """Writes the index of all rows with a vector under ``path``; ``keep``: columns for prefilters.

    Vectors have one length, which ``parts`` divides.  Zero vectors lie in the list of the
    first centroid.
    """
    spark = df.sparkSession
    src = df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *keep)
    few = src.select("id", "v").orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(sample)
    n = few.count()
    if n == 0:
        raise ValueError("nothing to index")
    k = lists or max(1, min(n // 8, int(math.sqrt(n)) * 2))
    centroids, _ = density.spherical_kmeans(few, "id", "v", k, iters=8, seed=seed)
    x = density._vectors(few.orderBy("id").select("v").toArrow().column("v").combine_chunks(), centroids.shape[1])
    if x.shape[1] % parts:
        raise ValueError(f"{parts} parts do not divide {x.shape[1]} dimensions")
    books = _fit_books(x - centroids[(x @ centroids.T).argmax(axis=1)], parts, entries, 10, seed)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = density._vectors(b.column("v"), centroids.shape[1])
            at = (own @ centroids.T).argmax(axis=1)
            rest, width = own - centroids[at], own.shape[1] // parts
            code = np.stack([((books[p] ** 2).sum(1) - 2 * rest[:, p * width : (p + 1) * width] @ books[p].T).argmin(axis=1) for p in range(parts)], axis=1).astype(np.uint8)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(own.astype(np.float32).ravel()), own.shape[1]).cast(pa.list_(pa.float32()))
            columns = [b.column("id"), flat, *(b.column(c) for c in keep), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "v", *keep, "code", "list"])

    types = dict(src.dtypes)
    schema = ", ".join(["id " + types["id"], "v array<float>", *(f"`{c}` {types[c]}" for c in keep), "code binary", "list int"])
    src.mapInArrow(coded, schema).repartition("list").write.partitionBy("list").option("compression", "zstd").parquet(f"{path}/lists")
    counts = {r["list"]: r["count"] for r in spark.read.parquet(f"{path}/lists").groupBy("list").count().collect()}  # a row for each list
    meta = {"centroids": centroids.tolist(), "books": books.tolist(), "sizes": [counts.get(j, 0) for j in range(len(centroids))], "id_col": id_col}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(f"{path}/meta")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    m = json.loads(spark.read.text(f"{path}/meta", wholetext=True).head()[0])
    return Index(path, np.array(m["centroids"]), np.array(m["books"]), np.array(m["sizes"]), m["id_col"])


def probed(index: Index, x: np.ndarray, probes: int) -> np.ndarray:
    """Lists of each query, nearest first."""
    return np.argsort(-(x @ index.centroids.T), axis=1, kind="stable")[:, :probes]


def share_read(index: Index, x: np.ndarray, probes: int) -> float:
    """Mean share of the index's rows that a query looks at."""
    return float(index.sizes[probed(index, x, probes)].sum(axis=1).mean() / max(1, index.sizes.sum()))


def search(spark: SparkSession, index: Index, queries: DataFrame, query_id: str, query_vector: str, k: int, probes: int, refine: int = 10, where: Column | None = None, most_queries: int = 2000) -> DataFrame:
    """query_id, id, score (cosine), rank: the k best found of each query, the row of its own id apart; ties to the smaller id.

    ``where``: a condition on the kept columns, applied before any vector is looked at.
    Queries go to all tasks: more than ``most_queries`` are an error.  ``refine * k`` best
    estimates of a query are scored exactly.
    """
    q = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).filter("v is not null").limit(most_queries + 1).toArrow()
    if q.num_rows > most_queries:
        raise ValueError("too many queries for a broadcast")
    schema = f"{query_id} {dict(queries.dtypes)[query_id]}, {index.id_col} {dict(index.rows(spark).dtypes)['id']}, score double, rank int"
    if q.num_rows == 0:
        return spark.createDataFrame([], schema)
    x, names = density._vectors(q.column("v").combine_chunks(), index.centroids.shape[1]), q.column("q").to_pylist()
    lists = probed(index, x, probes)
    askers: dict[int, list[int]] = {}
    for j, row in enumerate(lists):
        for at in row:
            askers.setdefault(int(at), []).append(j)
    most, centroids, books = refine * k, index.centroids, index.books
    parts, width = len(books), books.shape[2]
    tables = np.einsum("qpw,pew->qpe", x.reshape(len(x), parts, width), books)
    near = x @ centroids.T

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            at, code = b.column("list").to_numpy(), np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            for one in np.unique(at):
                rows = np.flatnonzero(at == one)
                for j in askers.get(int(one), ()):
                    s = near[j, one] + tables[j][np.arange(parts), code[rows]].sum(axis=1)
                    best = rows[np.argsort(-s, kind="stable")[: most + 1]]
                    part = pa.RecordBatch.from_arrays([pa.array([j] * len(best), pa.int32()), pa.array(np.sort(-s, kind="stable")[: most + 1] * -1), b.column("id").take(pa.array(best)), b.column("v").take(pa.array(best))], names=["j", "estimate", "id", "v"])
                    held.setdefault(j, []).append(part)
                    if sum(p.num_rows for p in held[j]) > 4 * most:
                        held[j] = pa.Table.from_batches(held[j]).sort_by([("estimate", "descending")]).slice(0, most + 1).combine_chunks().to_batches()
        for own in held.values():
            yield from own

    table = index.rows(spark).filter(F.col("list").isin([int(v) for v in askers]))
    if where is not None:
        table = table.filter(where)
    kind = dict(table.dtypes)["id"]
    found = table.select("list", "code", "id", "v").mapInArrow(estimated, f"j int, estimate double, id {kind}, v array<float>")
    ids = spark.createDataFrame([(j, n, [float(v) for v in x[j]]) for j, n in enumerate(names)], f"j int, q {dict(queries.dtypes)[query_id]}, e array<double>")
    # its own row may be among the best estimates: one more is kept for it
    few = top_n(found, ["j"], most + 1, F.desc("estimate"), F.asc("id")).drop("rank").join(F.broadcast(ids), "j").filter(F.col("id") != F.col("q"))
    dot = F.aggregate(F.zip_with("v", "e", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, t: s + t)
    out = few.select(F.col("q").alias(query_id), F.col("id").alias(index.id_col), F.round(dot, 6).alias("score"))
    return top_n(out, [query_id], k, F.desc("score"), F.asc(index.id_col))


def tuned(spark: SparkSession, index: Index, queries: DataFrame, query_id: str, query_vector: str, k: int, exact: DataFrame, recall: float = 0.93, **options) -> int:
    """The fewest probes (of doubling steps) with which ``queries`` reach ``recall`` against ``exact`` (query_id, id); use other queries to judge it."""
    want = {(r[0], r[1]) for r in exact.select(query_id, index.id_col).collect()}  # k a query
    probes = 1
    while probes < len(index.centroids):
        got = {(r[0], r[1]) for r in search(spark, index, queries, query_id, query_vector, k, probes, **options).select(query_id, index.id_col).collect()}
        if len(got & want) >= recall * len(want):
            return probes
        probes = min(len(index.centroids), math.ceil(probes * 1.5))
    return probes
