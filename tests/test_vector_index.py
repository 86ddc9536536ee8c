"""The vector index against all pairs, on queries that it wasn't tuned with."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.operators import density, vector_index
from tarnlake.operators import vectors as V


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 32))
    rows = [(i, [float(v) for v in centres[i % 40] + 0.6 * r.normal(size=32)], i % 3) for i in range(6000)]
    rows += [(9000, None, 1), (9001, rows[5][1], 1)]
    return spark.createDataFrame(rows, "id long, v array<float>, colour int").repartition(4)


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    return vector_index.build(table, "id", "v", str(tmp_path_factory.mktemp("ix") / "a"), lists=60, parts=8, entries=64, keep=("colour",))


def queries(table, rest, n):
    return table.filter((F.col("id") % 50 == rest) & F.col("v").isNotNull()).orderBy("id").limit(n).select(F.col("id").alias("q"), "v")


def exact(rows, q, k):
    return V.cosine_top_k(rows.filter("v is not null"), "id", "v", q, "q", "v", k)


def test_recall_on_unseen_queries_and_share_read(spark, table, index):
    tune, unseen = queries(table, 7, 60), queries(table, 31, 80)
    probes = vector_index.tuned(spark, index, tune, "q", "v", 10, exact(table, tune, 10), 0.95)
    got = {(r["q"], r["id"]) for r in vector_index.search(spark, index, unseen, "q", "v", 10, probes).collect()}
    want = {(r["q"], r["id"]) for r in exact(table, unseen, 10).collect()}
    x = density._vectors(unseen.select("v").toArrow().column("v").combine_chunks(), 32)
    assert len(got) == 800 and len(got & want) / len(want) >= 0.9
    assert vector_index.share_read(index, x, probes) < 0.35


def test_all_lists_and_full_refinement_are_exact(spark, table, index):
    q = queries(table, 3, 12)
    got = vector_index.search(spark, index, q, "q", "v", 7, len(index.centroids), refine=1000)
    rows = lambda df: sorted((r["q"], r["rank"], r["id"], round(r["score"], 4)) for r in df.collect())
    assert rows(got) == rows(exact(table, q, 7))


def test_prefilter_comes_before_the_choice(spark, table, index):
    q = queries(table, 3, 12)
    got = vector_index.search(spark, index, q, "q", "v", 7, len(index.centroids), refine=1000, where=F.col("colour") == 2)
    want = exact(table.filter("colour = 2"), q, 7)
    assert {(r["q"], r["id"]) for r in got.collect()} == {(r["q"], r["id"]) for r in want.collect()}


def test_only_probed_lists_are_read(spark, table, index):
    one = queries(table, 3, 1)
    plan = vector_index.search(spark, index, one, "q", "v", 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan.replace("isnotnull(list#", "list#") or "PartitionFilters" in plan and " IN (" in plan
    assert index.sizes.sum() == 6001 and vector_index.load(spark, index.path).sizes.tolist() == index.sizes.tolist()


def test_small_tables(spark, tmp_path):
    few = spark.createDataFrame([(i, [float(i), 1.0, 0.0, 0.5]) for i in range(5)], "id long, v array<double>")
    ix = vector_index.build(few, "id", "v", str(tmp_path / "few"), parts=2, entries=4)
    got = vector_index.search(spark, ix, few.select(F.col("id").alias("q"), "v"), "q", "v", 10, 9).collect()
    assert len(got) == 20 and all(r["q"] != r["id"] for r in got)
    assert vector_index.search(spark, ix, few.filter("id > 9").select(F.col("id").alias("q"), "v"), "q", "v", 3, 1).collect() == []
    with pytest.raises(ValueError, match="too many"):
        vector_index.search(spark, ix, few.select(F.col("id").alias("q"), "v"), "q", "v", 3, 1, most_queries=2)
    with pytest.raises(ValueError, match="nothing"):
        vector_index.build(few.filter("id > 9"), "id", "v", str(tmp_path / "none"))
