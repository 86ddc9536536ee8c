"""Kendall's tau-b of all pairs without making them: pairs in the wrong order are counted by range.

Rows are counted by (x, y) first, so repeated values are one row each.  In the order of
(x, y), a pair is discordant where a greater y comes before a smaller one.  Rows are dealt
by range of that order and by range of y; then a discordant pair is one of three:

* both y in one range: counted in the task of the range of y;
* ranges of y differ, one task of the order: counted there, by the ranges' numbers;
* ranges differ, tasks differ: a product of counts by task and range, which are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.store import written


def inversions(y: np.ndarray, w: np.ndarray) -> int:
    """Sum of w[i] * w[j] over i < j with y[i] > y[j]; exact."""
    n = len(y)
    if n < 2:
        return 0
    half = n // 2
    left, right = np.argsort(y[:half], kind="stable"), y[half:]
    above = np.concatenate([[0], np.cumsum(w[:half][left])])
    more = above[-1] - above[np.searchsorted(y[:half][left], right, side="right")]
    here = sum(int(a) * int(b) for a, b in zip(more, w[half:], strict=True)) if int(above[-1]) * int(w[half:].sum()) >= 1 << 62 else int((more * w[half:]).sum())
    return here + inversions(y[:half], w[:half]) + inversions(right, w[half:])


def _bounds(values: DataFrame, ranges: int) -> list:
    """Upper ends of ranges of y with about equal weight each (from a sketch: only balance depends on them)."""
    q = [k / ranges for k in range(1, ranges)]
    return sorted(set(values.select(F.percentile_approx("y", F.array(*[F.lit(x) for x in q]), F.lit(10_000)).alias("q")).head()["q"] or []))


def discordant(counts: DataFrame, ranges: int | None = None) -> int:
    """Number of discordant pairs of ``counts`` (x, y, n)."""
    spark = counts.sparkSession
    ranges = ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ends = _bounds(counts, ranges)
    # searchsorted over the ends: y's range is how many of them it exceeds
    at = F.lit(0)
    if ends:
        e = F.array(*[F.lit(x) for x in ends])
        at = F.size(F.filter(e, lambda x: x < F.col("y")))
    rows = counts.withColumn("range", at.cast("int"))

    def by_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, start = TaskContext.get().partitionId(), 0
        for b in batches:
            place = pa.array(np.arange(start, start + b.num_rows))
            start += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("n"), b.column("range"), pa.array(np.full(b.num_rows, task, np.int32)), place], names=["y", "n", "range", "task", "place"])

    kind = dict(rows.dtypes)["y"]
    dealt = written(rows.repartitionByRange("x", "y").sortWithinPartitions("x", "y").mapInArrow(by_order, f"y {kind}, n long, range int, task int, place long"), "ordered")

    def counted(values: str, group: str):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for b in batches:  # groups are whole within a task and come one after another
                for g in np.unique(b.column(group).to_numpy()):
                    held.setdefault(int(g), []).append(b.filter(pa.compute.equal(b.column(group), int(g))))
                    for done in [k for k in held if k != int(g)]:
                        yield one(held.pop(done))
            for v in held.values():
                yield one(v)

        def one(parts: list) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            y = t.column(values).to_numpy()
            _, y = np.unique(y, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array([str(inversions(y, t.column("n").to_numpy()))])], names=["d"])

        return count

    total = F.coalesce(F.sum(F.col("d").cast("decimal(38,0)")), F.lit(0))
    within = dealt.repartition("task").sortWithinPartitions("task", "place").mapInArrow(counted("range", "task"), "d string").agg(total).head()[0]
    # a range of a single value has no wrong order in itself
    several = dealt.groupBy("range").agg((F.min("y") < F.max("y")).alias("several")).filter("several").select("range")
    inside = dealt.join(F.broadcast(several), "range").repartition("range").sortWithinPartitions("range", "task", "place").mapInArrow(counted("y", "range"), "d string").agg(total).head()[0]
    grid: dict[int, dict[int, int]] = {}
    for r in dealt.groupBy("task", "range").agg(F.sum("n").alias("n")).collect():  # tasks x ranges
        grid.setdefault(r["task"], {})[r["range"]] = r["n"]
    between, before = 0, [0] * (len(ends) + 1)
    for task in sorted(grid):
        above, run = [0] * (len(ends) + 2), 0
        for k in range(len(ends), -1, -1):
            above[k] = run
            run += before[k]
        between += sum(n * above[k] for k, n in grid[task].items())
        for k, n in grid[task].items():
            before[k] += n
    return int(within) + int(inside) + between


def kendall_tau(df: DataFrame, x: str, y: str, ranges: int | None = None) -> float | None:
    """tau-b of two columns that can be ordered; rows with a null take no part; null where one side has a single value."""
    counts = written(df.select(F.col(x).alias("x"), F.col(y).alias("y")).filter("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("n")), "counts")
    pairs = lambda c: F.coalesce(F.sum((F.col(c).cast("decimal(19,0)") * (F.col(c) - 1)) / 2), F.lit(0)).cast("decimal(38,0)")
    n, both = counts.agg(F.sum("n"), pairs("n")).head()
    if not n:
        return None
    tied = [int(counts.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs("n")).head()[0]) for c in ("x", "y")]
    every = n * (n - 1) // 2
    wrong = discordant(counts, ranges)
    right = every - tied[0] - tied[1] + int(both) - wrong
    under = (every - tied[0]) * (every - tied[1])
    return (right - wrong) / under**0.5 if under else None
