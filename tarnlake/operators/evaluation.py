"""How good deciders are, and how sure that is: cross-fitted calibration, its error, bootstrap intervals in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators import ranks, vectors
from tarnlake.store import written

#: Distribution function of a Poisson variable of mean 1: a weight is how many of these a chance exceeds; fixed values.
POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])


def fold_of(id_col: str, folds: int, salt: str = "") -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), F.col(id_col)), F.lit(folds)).cast("int")


def cross_fitted(rows: DataFrame, id_col: str, probability: str, truth: str, folds: int = 5, salt: str = "") -> DataFrame:
    """``rows`` with fold, temperature and calibrated: a row's temperature is fitted on the rows of the other folds only."""
    kept = written(rows.withColumn("fold", fold_of(id_col, folds, salt)), "folds")
    fitted = [vectors.fit_temperature(kept.filter((F.col("fold") != k) & F.col(truth).isNotNull()), probability, truth) for k in range(folds)]
    t = F.element_at(F.array(*[F.lit(float(x)) for x in fitted]), F.col("fold") + 1)
    p = F.least(F.greatest(F.col(probability), F.lit(1e-6)), F.lit(1 - 1e-6))
    return kept.withColumn("temperature", t).withColumn("calibrated", 1 / (1 + F.exp(-F.log(p / (1 - p)) / F.col("temperature"))))


def reliability(rows: DataFrame, id_col: str, probability: str, truth: str, bins: int = 15) -> DataFrame:
    """bin, n, mean_probability, share_true of bins with equally many rows (by probability, then id)."""
    some = rows.filter(F.col(probability).isNotNull() & F.col(truth).isNotNull()).select(F.col(id_col).alias("id"), F.col(probability).alias("p"), F.col(truth).cast("int").alias("y"))
    if some.isEmpty():
        return rows.sparkSession.createDataFrame([], "bin int, n long, mean_probability double, share_true double")
    return ranks.ntile(some, [F.asc("p"), F.asc("id")], bins, "bin").groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_probability"), F.avg("y").alias("share_true"))


def calibration_error(rows: DataFrame, id_col: str, probability: str, truth: str, bins: int = 15) -> float | None:
    """Mean distance of probability and share, weighted by the bins' rows."""
    r = reliability(rows, id_col, probability, truth, bins)
    return r.agg((F.sum(F.abs(F.col("mean_probability") - F.col("share_true")) * F.col("n")) / F.sum("n")).alias("e")).head()["e"]


def coverage_at(rows: DataFrame, id_col: str, probability: str, correct: str, least: float) -> float:
    """Largest share of rows, most certain first, of which at least ``least`` are right."""
    some = rows.select(F.col(id_col).alias("id"), F.col(probability).alias("p"), F.col(correct).cast("long").alias("y")).filter("p is not null and y is not null")
    order = [F.desc("p"), F.asc("id")]
    r = ranks.running(ranks.row_number(some, order, "k"), order, F.col("y"), "before")
    best = r.filter((F.col("before") + F.col("y")) >= F.lit(least) * F.col("k") - 1e-9).agg(F.max("k")).head()[0]
    return (best or 0) / max(1, some.count())


# -- bootstrap -----------------------------------------------------------------------------------
def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(ids: np.ndarray, replicates: int) -> np.ndarray:
    """How often each row is drawn in each replicate (rows x replicates): independent Poisson draws of mean 1, from ids alone."""
    steps = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    u = (_mixed(ids.astype(np.uint64)[:, None] + steps[None]) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(POISSON, u, side="right")


def resampled(rows: DataFrame, id_col: str, truth: str, guess: str, replicates: int = 200) -> DataFrame:
    """replicate, truth, guess, n: weighted counts of each cell, all replicates in one pass (0: the rows as they are).

    ``truth`` and ``guess`` are classes, that is, few; a task sends one row for each cell
    and replicate.
    """
    src = rows.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(truth).cast("string").alias("t"), F.col(guess).cast("string").alias("g"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple, np.ndarray] = {}
        for b in batches:
            pair = list(zip(b.column("t").to_pylist(), b.column("g").to_pylist(), strict=True))
            names = {p: k for k, p in enumerate(dict.fromkeys(pair))}
            at = np.array([names[p] for p in pair], dtype=int)
            for lo in range(0, len(pair), 4096):
                w = np.concatenate([np.ones((len(pair[lo : lo + 4096]), 1), int), weights(b.column("h").to_numpy()[lo : lo + 4096].view(np.uint64), replicates)], axis=1)
                for p, k in names.items():
                    cells[p] = cells.get(p, 0) + w[at[lo : lo + 4096] == k].sum(axis=0)
        for (t, g), n in cells.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array([t] * len(n)), pa.array([g] * len(n)), pa.array(n.astype(np.int64))], names=["replicate", "truth", "guess", "n"])

    return src.mapInArrow(count, "replicate int, truth string, guess string, n long").groupBy("replicate", "truth", "guess").agg(F.sum("n").alias("n"))


def figures(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, accuracy, macro_f1 of counts (truth, guess, n); classes are those that occur on either side."""
    hit = F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)
    one = cells.groupBy(*by).agg((F.sum(hit) / F.sum("n")).alias("accuracy"))
    side = lambda c, other: cells.select(*by, F.col(c).alias("class"), F.col("n").alias(c), F.lit(0).cast("long").alias(other), (hit if c == "truth" else F.lit(0)).cast("long").alias("hit"))
    per = side("truth", "guess").unionByName(side("guess", "truth")).groupBy(*by, "class").agg(F.sum("truth").alias("t"), F.sum("guess").alias("g"), F.sum("hit").alias("h"))
    f1 = per.filter(F.col("t") + F.col("g") > 0).groupBy(*by).agg(F.avg(2 * F.col("h") / (F.col("t") + F.col("g"))).alias("macro_f1"))
    return one.join(f1, by)


def intervals(rows: DataFrame, id_col: str, truth: str, guess: str, replicates: int = 200, level: float = 0.95) -> DataFrame:
    """figure, value, low, high: accuracy and macro F1 with percentile intervals (nearest rank) of the bootstrap."""
    f = written(figures(resampled(rows, id_col, truth, guess, replicates), ["replicate"]), "figures")
    tail = (1 - level) / 2
    long = f.select("replicate", F.explode(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).alias("x")) for c in ("accuracy", "macro_f1")])).alias("s")).select("replicate", "s.*")
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY x) FILTER (WHERE replicate > 0)")
    return long.groupBy("figure").agg(F.max(F.when(F.col("replicate") == 0, F.col("x"))).alias("value"), disc(tail).alias("low"), disc(1 - tail).alias("high"))
