import numpy as np
import pytest

from tarnlake.operators import vectors


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    centre = np.eye(6)[:3]
    rows = [(i, i % 3, (centre[i % 3] + 0.05 * rng.standard_normal(6)).tolist()) for i in range(90)]
    return spark.createDataFrame(rows, "id long, label int, v array<double>")


def test_clusters_follow_the_labels(points):
    got = vectors.cluster(points, "v", 3).groupBy("label").agg({"cluster_id": "max"}).collect()
    assert len({r[1] for r in got}) == 3


def test_projection_and_centroids(points):
    p = vectors.project(points, "v", 2).head()["projected"]
    assert np.linalg.norm(p) == pytest.approx(1)
    c = {r["label"]: r for r in vectors.centroids(points, "label", "v").collect()}
    assert c[1]["size"] == 30 and np.linalg.norm(c[1]["centroid"]) == pytest.approx(1) and c[1]["centroid"][1] > 0.95


def test_cluster_ids_are_kept():
    old = {"a": np.array([1.0, 0]), "b": np.array([0, 1.0])}
    assert vectors.match_clusters(old, {1: np.array([0.1, 0.99]), 2: np.array([0.7, 0.7])}) == {1: "b"}


def test_pool(spark):
    df = spark.createDataFrame([(1, 0.9, 1.0), (1, 0.8, 1.0), (1, 0.3, 1.0)], "k int, p double, w double")
    r = vectors.pool(df, ["k"], "p", "w").head()
    assert 0.6 < r["pooled"] < 0.8 and r["agreement"] == pytest.approx(2 / 3)
