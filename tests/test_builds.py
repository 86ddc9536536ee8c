"""Builds, caches, purges, reports; matching of clusters and fits on small cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.operators import vectors as V
from tarnlake.sources import builds, files, lake


def test_builds_are_promoted_and_retained(spark, tmp_path):
    root = str(tmp_path / "builds")
    for b in ("b1", "b2", "b3"):
        assert builds.write_build({"t": spark.range(3)}, root, b) == {"t": 3}
    spark.range(1).write.parquet(f"{root}/b4/t")  # broke off
    assert builds.list_builds(spark, root) == ["b1", "b2", "b3"] and builds.current(spark, root) is None
    builds.promote(spark, root, "b1")
    builds.promote(spark, root, "b2")
    assert builds.current(spark, root) == "b2"
    with pytest.raises(ValueError):
        builds.promote(spark, root, "b4")
    assert builds.retain(spark, root, 1) == ["b1", "b4"] and builds.list_builds(spark, root) == ["b2", "b3"]


def test_answers_are_compacted(spark, tmp_path):
    rows = [("h", "q", "f", "d", "1", "yes", 1), ("h", "q", "f", "d", "1", "no", 2), ("h", "q", "g", "d", "1", "no", 1), ("h", "q", "f", "e", "1", "yes", 1)]
    df = spark.createDataFrame(rows, "content_hash string, question string, fingerprint string, decider string, decider_version string, answer string, decided_at int")
    builds.append_answers(df, str(tmp_path / "a"))
    builds.compact_answers(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    got = {(r["fingerprint"], r["decider"]): r["answer"] for r in spark.read.parquet(str(tmp_path / "b")).collect()}
    assert got == {("f", "d"): "no", ("g", "d"): "no", ("f", "e"): "yes"}


def test_lake_is_purged_and_listed(spark, tmp_path):
    root = str(tmp_path / "lake")
    for day in ("2024-01-01", "2024-01-02"):
        lake.append(files.as_records(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), "files", "costs", ["k"], f"{day} 00:00:00"), f"{root}/files/costs")
    assert [(r["source"], r["entity"], r["columns"]) for r in builds.inventory(spark, root).collect()] == [("files", "costs", ["k", "v"])]
    ids = spark.createDataFrame([("files:costs:1",)], "_record_id string")
    assert builds.purge_lake(spark, f"{root}/files/costs", str(tmp_path / "new"), ids, "2024-01-02") == 3
    t = {"a": spark.createDataFrame([("r1", ["r1", "r2"]), ("r2", ["r1"])], "record_id string, links array<string>")}
    assert [tuple(r) for r in builds.forget(t, "r1")["a"].collect()] == [("r2", [])]
    assert builds.describe(t)[0]["rows"] == 2
    df = spark.createDataFrame([(1, None)], "a int, b int")
    assert builds.disabled_metrics({"x": ["a"], "y": ["b"], "z": ["c"]}, df) == ["y", "z"]


def test_reports(spark, tmp_path):
    builds.write_report(spark.range(3), str(tmp_path / "r"), "csv")
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 3
    with pytest.raises(ValueError):
        builds.write_report(spark.range(30), str(tmp_path / "s"), "json", most_rows=10)
    assert builds.bar_chart([("a<b", 2.0), ("c", -1.0)], "t").count("<rect") == 2


def test_assignment_is_the_best():
    r = random.Random(6)
    for _ in range(60):
        n, m = r.randrange(1, 5), r.randrange(5, 7)
        gain = np.array([[r.random() for _ in range(m)] for _ in range(n)])
        got = V.best_assignment(gain)
        assert len(set(got)) == n and min(got) >= 0
        want = max(sum(gain[k, j] for k, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert abs(sum(gain[k, j] for k, j in enumerate(got)) - want) < 1e-9


def test_clusters_keep_their_ids():
    old = {"a": np.array([1.0, 0.0]), "b": np.array([0.95, 0.31]), "old": np.array([0.0, 1.0])}
    new = {1: np.array([0.98, 0.2]), 2: np.array([1.0, 0.0]), 3: np.array([0.0, 1.0])}
    assert V.match_clusters(old, new) == {1: "b", 2: "a", 3: "old"}
    assert V.match_clusters(old, new, retired_days={"old": 91}) == {1: "b", 2: "a"}
    assert V.match_clusters({}, new) == {} and V.recluster_due(31, 0, 0) and not V.recluster_due(1, 0.1, 0.1)


def test_temperature_is_recovered(spark):
    r = random.Random(3)
    rows = []
    for _ in range(4000):
        z = r.gauss(0, 2)
        rows.append((1 / (1 + np.exp(-2.0 * z)), r.random() < 1 / (1 + np.exp(-z))))  # twice as sure as it should be
    df = spark.createDataFrame([(float(p), bool(y)) for p, y in rows], "p double, y boolean")
    assert 1.8 < V.fit_temperature(df, "p", "y") < 2.25
    assert V.fit_temperature(df.filter(F.lit(False)), "p", "y") > 0
