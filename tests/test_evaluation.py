"""Cross-fitted calibration and bootstrap intervals against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.operators import evaluation as E
from tarnlake.operators import vectors


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


@pytest.fixture(scope="module")
def rows(spark):
    """Too certain by a factor of three: the right temperature is 3."""
    r = random.Random(5)
    data = []
    for i in range(4000):
        z = r.gauss(0, 1.5)
        data.append((i, sigmoid(3 * z), r.random() < sigmoid(z)))
    return spark.createDataFrame(data, "id long, p double, y boolean").repartition(4)


def test_a_fold_never_sees_its_own_rows(spark, rows):
    out = E.cross_fitted(rows, "id", "p", "y", folds=3).cache()
    temperatures = {r["fold"]: r["temperature"] for r in out.select("fold", "temperature").distinct().collect()}
    assert len(temperatures) == 3 and all(2.4 < t < 3.7 for t in temperatures.values())
    for k, t in temperatures.items():
        assert t == vectors.fit_temperature(out.filter(F.col("fold") != k), "p", "y")
    before, after = (E.calibration_error(out, "id", c, "y") for c in ("p", "calibrated"))
    assert after < 0.03 < before
    # other truths in a fold change the other folds' temperatures, not its own
    wrong = rows.withColumn("y", F.when(E.fold_of("id", 3) == 0, ~F.col("y")).otherwise(F.col("y")))
    moved = {r["fold"]: r["temperature"] for r in E.cross_fitted(wrong, "id", "p", "y", folds=3).select("fold", "temperature").distinct().collect()}
    assert moved[0] == temperatures[0] and moved[1] != temperatures[1]


def test_calibration_error_by_hand(spark):
    df = spark.createDataFrame([(1, 0.1, False), (2, 0.2, True), (3, 0.6, True), (4, 0.8, True), (5, None, True)], "id long, p double, y boolean")
    assert E.calibration_error(df, "id", "p", "y", bins=2) == pytest.approx((2 * abs(0.15 - 0.5) + 2 * abs(0.7 - 1.0)) / 4)
    assert E.calibration_error(df.filter("id > 9"), "id", "p", "y") is None
    assert E.coverage_at(df, "id", "p", "y", 0.75) == 1.0 and E.coverage_at(df, "id", "p", "y", 0.99) == 0.75


def test_weights_are_poisson_and_depend_on_ids_only():
    w = E.weights(np.arange(20_000, dtype=np.uint64), 20)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.01
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03
    assert (E.weights(np.array([7], dtype=np.uint64), 20) == w[7:8]).all()


def plain_figures(pairs, w):
    cells = {}
    for (t, g), n in zip(pairs, w, strict=True):
        cells[t, g] = cells.get((t, g), 0) + n
    total = sum(cells.values())
    f1 = []
    for c in {x for p in cells for x in p}:
        t, g = (sum(n for p, n in cells.items() if p[k] == c) for k in (0, 1))
        if t + g:
            f1.append(2 * cells.get((c, c), 0) / (t + g))
    return sum(n for p, n in cells.items() if p[0] == p[1]) / total, sum(f1) / len(f1)


def test_intervals_match_plain_resampling(spark):
    r = random.Random(6)
    data = [(i, r.choice("abc"), r.choice("abc") if r.random() < 0.4 else None) for i in range(500)]
    data = [(i, t, g or t) for i, t, g in data] + [(900, None, "a"), (901, "a", None)]
    df = spark.createDataFrame(data, "id long, t string, g string")
    got = {x["figure"]: x for x in E.intervals(df.repartition(5), "id", "t", "g", 60).collect()}
    again = {x["figure"]: x for x in E.intervals(df.repartition(2), "id", "t", "g", 60).collect()}
    assert got == again
    h = {x["id"]: x["h"] for x in df.select("id", F.xxhash64("id").alias("h")).collect()}
    own = [d for d in data if d[1] and d[2]]
    w = E.weights(np.array([h[d[0]] for d in own], dtype=np.int64).view(np.uint64), 60)
    runs = [plain_figures([d[1:] for d in own], w[:, k]) for k in range(60)]
    for k, name in enumerate(("accuracy", "macro_f1")):
        xs = sorted(x[k] for x in runs)
        assert got[name]["value"] == pytest.approx(plain_figures([d[1:] for d in own], np.ones(len(own)))[k])
        assert got[name]["low"] == pytest.approx(xs[math.ceil(0.025 * 60) - 1]) and got[name]["high"] == pytest.approx(xs[math.ceil(0.975 * 60) - 1])
        assert got[name]["low"] <= got[name]["value"] <= got[name]["high"]
