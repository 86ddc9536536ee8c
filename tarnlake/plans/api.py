"""Calls for users: one metric for chosen entities and periods, its series, its peers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators import joins as J
from tarnlake.plans import metrics
from tarnlake.plans.adapter import Tables, fact

GRAINS = {"service": "service_id", "team": "team_id", "cluster": "cluster_id"}
UNITS = ("week", "month", "quarter")


def compute_metric(spark: SparkSession, sf_dir: str, name: str, grain: str = "team", unit: str = "month", ids: list[str] | None = None, window: tuple[str, str] | None = None) -> DataFrame:
    """Figures of one metric; ``grain`` 'org' rolls services up to all their ancestors.

    Filters on entities and the window come before the grouping.
    """
    if name not in metrics.CATALOGUE or unit not in UNITS:
        raise ValueError(f"unknown metric or period: {name}, {unit}")
    t, m = Tables(spark, sf_dir), metrics.CATALOGUE[name]
    f = fact(t, m.fact)
    if grain == "org":
        c = J.closure(t.org(), "org_id", "parent_org_id").select("org_id", F.col("ancestor"))
        f = f.withColumn("org_id", F.concat(F.lit("N"), "service_id")).join(F.broadcast(c), "org_id")  # tens of nations
        entity = "ancestor"
    elif grain in GRAINS and GRAINS[grain] in f.columns:
        entity = GRAINS[grain]
    else:
        raise ValueError(f"{name} has no grain {grain}")
    if ids is not None:
        f = f.filter(F.col(entity).cast("string").isin(ids))
    return metrics.compute(f, m, entity, unit, window)


def metric_series(spark: SparkSession, sf_dir: str, name: str, entity_id: str, grain: str = "team", unit: str = "week", window: tuple[str, str] | None = None) -> DataFrame:
    """One entity's figures in order of period."""
    return compute_metric(spark, sf_dir, name, grain, unit, [entity_id], window).orderBy("period_start")


def compare_with_peers(spark: SparkSession, sf_dir: str, name: str, grain: str = "team", unit: str = "month") -> DataFrame:
    """Each figure with the median of all entities in its period, and the difference."""
    g = compute_metric(spark, sf_dir, name, grain, unit)
    med = g.groupBy("period_start").agg(F.median("value").alias("peer_median"), F.count("value").alias("peers"))
    return g.join(med, "period_start").withColumn("difference", F.round(F.col("value") - F.col("peer_median"), 6)).select("entity_id", "period_start", "value", F.round("peer_median", 6).alias("peer_median"), "peers", "difference")
