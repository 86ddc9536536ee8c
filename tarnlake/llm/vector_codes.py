"""Compression of vectors into short codes: a small codebook for each part of the vector.

Components become whole numbers and vectors are cut into equal parts.  A part position has
a codebook, fitted by rounds of nearest-entry assignment and replacement of each entry by
the mean of its parts (rounded down); all sums are exact, so the codes do not depend on how
rows are dealt.

The nearest entry is searched in a vantage-point tree over a position's entries, by metric
branch-and-bound, for a batch of rows at once: a node has a vantage entry and two children,
each with the interval that its entries' distances from the vantage lie in.  By the
triangle inequality a child's entries are at least as far from a row as the gap between
the row's distance and that interval.  Distances are rounded outwards and a child is left
out only where that gap is larger than the best distance so far (an equal one is visited,
for ties), so rounding never loses an entry; what decides between entries is their squared
distance in integers, ties going to the lower index.

Codebooks (entries x dimensions) are all that the driver and the tasks hold in full; a
round is one pass over the written vectors, and a task sends one sum for each entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, written

#: Whole components must be smaller than this, so that squared distances fit 64 bits.
COMPONENT_BOUND = 1 << 24
LEAF = 4
BATCH = 8192


class Tree:
    """A vantage-point tree over the rows of ``entries`` (whole numbers)."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf = entries, leaf
        self.root = self._build(np.arange(len(entries)))

    def _build(self, of: np.ndarray):
        if len(of) <= self.leaf:
            return of
        # far from the others' middle: intervals of distances are then narrow
        mid = self.entries[of].mean(axis=0)
        vantage = of[np.argmax(((self.entries[of] - mid) ** 2).sum(axis=1))]
        rest = of[of != vantage]
        low, high = outwards(((self.entries[rest] - self.entries[vantage]) ** 2).sum(axis=1))
        order = np.argsort(low, kind="stable")
        halves = [order[: len(order) // 2], order[len(order) // 2 :]]
        return vantage, [(low[h].min(), high[h].max(), self._build(rest[h])) for h in halves]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance, for each row of ``x``."""
        best = np.full(len(x), len(self.entries), dtype=np.int64)
        dist = np.full(len(x), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(x)), x, best, dist)
        return best, dist

    def _look(self, entry: int, rows: np.ndarray, x: np.ndarray, best: np.ndarray, dist: np.ndarray) -> np.ndarray:
        d = ((x[rows] - self.entries[entry]) ** 2).sum(axis=1)
        better = (d < dist[rows]) | ((d == dist[rows]) & (entry < best[rows]))
        best[rows[better]], dist[rows[better]] = entry, d[better]
        return d

    def _visit(self, node, rows: np.ndarray, x: np.ndarray, best: np.ndarray, dist: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            for entry in node:
                self._look(entry, rows, x, best, dist)
            return
        vantage, children = node
        low, high = outwards(self._look(vantage, rows, x, best, dist))
        gaps = np.stack([np.maximum(low - c[1], c[0] - high) for c in children])  # negative: inside the interval
        first = np.argmin(gaps, axis=0)
        for turn in (0, 1):  # the nearer child first
            for c, (_, _, child) in enumerate(children):
                mine = np.flatnonzero((first == c) == (turn == 0))
                mine = mine[gaps[c, mine] <= outwards(dist[rows[mine]])[1]]
                self._visit(child, rows[mine], x, best, dist)


def outwards(squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds below and above of the square roots, which are surely not crossed by rounding."""
    root = np.sqrt(squared.astype(np.float64))
    return root * (1 - 1e-12), root * (1 + 1e-12)


def _whole(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their components as whole numbers."""
    ok = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims)
    flat = column.take(pa.array(ok)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(len(ok), dims)  # nulls become NaN
    fine = np.isfinite(x).all(axis=1)
    q = np.floor(x[fine] * scale)
    if len(q) and np.abs(q).max() >= COMPONENT_BOUND:
        raise ValueError(f"a component is beyond {COMPONENT_BOUND // scale} in size: scale the vectors or lower the scale")
    return ok[fine], q.astype(np.int32)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, dims: int, scale: int) -> DataFrame:
    """vec_id, label, q (components as 32-bit whole numbers, packed) of the rows that take part."""
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, q = _whole(b.column("v"), dims, scale)
            packed = pa.array([x.tobytes() for x in q], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), b.column("label").take(pa.array(rows)), packed], names=["vec_id", "label", "q"])

    types = dict(src.dtypes)
    return src.mapInArrow(quantised, f"vec_id {types['vec_id']}, label {types['label']}, q binary")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)


def assigned(x: np.ndarray, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row's parts."""
    width = x.shape[1] // len(trees)
    found = [t.nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width])) for p, t in enumerate(trees)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def refined(base: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: ``books`` (parts x entries x components) with each used entry replaced by its parts' mean."""
    parts, entries, width = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                x = _matrix(b.column("q").slice(at, BATCH), parts * width)
                code, _ = assigned(x, trees)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], x[:, p * width : (p + 1) * width])
                    count[p] += np.bincount(code[:, p], minlength=entries)
        p, e, i = (a.ravel() for a in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)) for a in (p, e, i)] + [pa.array(total.ravel()), pa.array(np.repeat(count.ravel(), width))], names=["p", "e", "i", "s", "n"])

    sums = base.select("q").mapInArrow(summed, "p int, e int, i int, s long, n long").groupBy("p", "e", "i").agg(F.sum(F.col("s").cast("decimal(28,0)")).alias("s"), F.sum("n").alias("n"))
    out = books.copy()
    for r in sums.collect():  # entries x dimensions
        if r["n"]:
            out[r["p"], r["e"], r["i"]] = int(r["s"]) // r["n"]
    return out


def fit(base: DataFrame, dims: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks (parts x entries x components); they start from the rows of the smallest ids."""
    first = base.filter(F.col("vec_id").isNotNull()).orderBy("vec_id", "q").limit(entries).select("q").collect()
    books = np.stack([np.frombuffer(bytes(r["q"]), np.int32) for r in first]).astype(np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = refined(base, books)
    return books


def encode(base: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error (squared distance)."""
    parts, _, width = books.shape

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(b) for b in books]
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                own = b.slice(at, BATCH)
                code, dist = assigned(_matrix(own.column("q"), parts * width), trees)
                text = pa.array([bytes(c).hex() for c in code.astype(np.uint8)])
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), text, pa.array(dist.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    types = dict(base.dtypes)
    return base.mapInArrow(coded, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, scale: int = 4096, code_col: str = "code", name: str = "vector") -> DataFrame:
    """``codes`` with the vectors that their codes stand for (entries divided by ``scale``)."""
    book = F.array(*[F.array(*[F.array(*[F.lit(float(v) / scale) for v in e]) for e in p]) for p in books])
    entry = lambda p: F.element_at(F.element_at(book, p + 1), F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int") + 1)
    return codes.withColumn(name, F.concat(*[entry(p) for p in range(len(books))]))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of each vector that takes part; the codebooks).

    Vectors that are null or hold null or non-finite components are dropped; so are, as an
    extension, those of another length than the commonest one that ``parts`` divides.  The
    codebooks start from the rows of the smallest ids (of one id, by components); a row
    with a null id is coded, but starts no entry; repeated rows count as often as they are
    there; with fewer rows than ``entries`` there are fewer entries.  An empty table gives
    an empty one.  Components are at most COMPONENT_BOUND / scale in size, or this fails.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a part's code has two hex digits: 1 to 256 entries")
    usable = vectors.filter(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & (F.size(vector_col) % parts == 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    lengths = usable.groupBy(F.size(vector_col).alias("d")).count().orderBy(F.desc("count"), "d").head()
    dims = lengths["d"] if lengths else parts
    base = written(whole_vectors(vectors, id_col, vector_col, label_col, dims, scale), "whole")
    if base.filter(F.col("vec_id").isNotNull()).isEmpty():
        return base.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), np.zeros((parts, 0, dims // parts), np.int64)
    books = fit(base, dims, parts, entries, rounds)
    return encode(base, books), books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **fitting) -> DataFrame:
    """id_col, code, error, label_error (errors of equal labels summed, nulls together), codebooks_sha256."""
    out, books = compress(vectors, id_col, vector_col, label_col=label_col, **fitting)
    has = [F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label_key")]
    codes = written(out.select("vec_id", "code", "error", *has), "codes")
    by_label = written(codes.groupBy("no_label", "label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")), "label-errors")
    digest = hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()
    return attach(codes, by_label, ["no_label", "label_key"], "rows").select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
