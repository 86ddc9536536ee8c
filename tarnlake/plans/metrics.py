"""The metric catalogue: figures of a fact by entity and local period.

A metric is a fact, the instant that places a row in a period, a filter and the
expressions of value, numerator and denominator.  ``compute`` joins the entity, groups
once and applies the wrapper: a value below the least sample is null, its parts stay,
rows of no entity go, and flags say what to know about it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import columns as X

ZONE = "Europe/Berlin"
LOW_COVERAGE = 0.8


@dataclass(frozen=True)
class Metric:
    fact: str
    at: str
    unit: str
    least: int
    value: str
    value_sql: str
    numerator: str = "NULL"
    numerator_sql: str = "NULL"
    denominator: str = "NULL"
    denominator_sql: str = "NULL"
    where: str = "TRUE"  # the same in both dialects
    sample: str = "TRUE"  # rows that count as sample
    estimate: bool = False


def _ratio(part: str, of: str = "TRUE") -> dict:
    n, d = f"CAST(count(*) FILTER (WHERE ({part}) AND ({of})) AS DOUBLE)", f"CAST(count(*) FILTER (WHERE {of}) AS DOUBLE)"
    v = f"{n} / nullif({d}, 0)"
    return {"value": v, "value_sql": v, "numerator": n, "numerator_sql": n, "denominator": d, "denominator_sql": d, "sample": of}


def _count(cond: str = "TRUE") -> dict:
    v = f"CAST(count(*) FILTER (WHERE {cond}) AS DOUBLE)"
    return {"value": v, "value_sql": v}


def _mean(col: str, scale: str = "", how: str = "avg") -> dict:
    v, n, d = f"{how}({col}{scale})", f"CAST(count({col}) AS DOUBLE)", "CAST(count(*) AS DOUBLE)"
    return {"value": v, "value_sql": v, "numerator": n, "numerator_sql": n, "denominator": d, "denominator_sql": d, "sample": f"{col} IS NOT NULL"}


def _median(col: str, scale: str = "") -> dict:
    return _mean(col, scale, "median")


def _sum(col: str) -> dict:
    v = f"CAST(sum({col}) AS DOUBLE)"
    return {"value": v, "value_sql": v}


def _weighted(weighted: str) -> dict:
    v = f"CASE WHEN bool_and(requests IS NOT NULL) THEN {weighted} / sum(requests) ELSE avg(value) END"
    return {"value": v, "value_sql": v}


LIVE = "NOT excluded"
CATALOGUE: dict[str, Metric] = {
    "m01_incident_count": Metric("incident_fact", "opened_at", "count", 1, where=LIVE, **_count()),
    "m02_p1p2_count": Metric("incident_fact", "opened_at", "count", 1, where=f"{LIVE} AND priority <= 2", **_count()),
    "m03_mttr_hours": Metric("incident_fact", "resolved_at", "hours", 10, where=LIVE, **_mean("resolve_h")),
    "m04_mttr_p50_hours": Metric("incident_fact", "resolved_at", "hours", 10, where=LIVE, **_median("resolve_h")),
    "m05_mttr_business_hours": Metric("incident_fact", "resolved_at", "hours", 10, where=LIVE, **_mean("business_minutes", " / 60")),
    "m06_mtta_minutes": Metric("incident_fact", "opened_at", "minutes", 10, where=LIVE, **_mean("ack_m")),
    "m07_impact_minutes": Metric("incident_fact", "opened_at", "minutes", 1, where=LIVE, estimate=True, **_sum("business_minutes")),
    "m08_repeat_rate": Metric("incident_fact", "opened_at", "ratio", 20, where=LIVE, **_ratio("is_repeat")),
    "m09_reopen_rate": Metric("incident_fact", "resolved_at", "ratio", 20, where=LIVE, **_ratio("reopens > 0")),
    "m10_reassignment_rate": Metric("incident_fact", "resolved_at", "ratio", 20, where=LIVE, **_ratio("reassignments > 2")),
    "m11_sla_breach_rate": Metric("incident_fact", "resolved_at", "ratio", 20, where=LIVE, **_ratio("sla_breached", "sla_breached IS NOT NULL")),
    "m12_alert_noise_ratio": Metric("event_fact", "ts", "ratio", 50, **_ratio("NOT linked", "noisy")),
    "m13_toil_hours": Metric("incident_fact", "resolved_at", "hours", 1, where=LIVE, estimate=True, **_sum("reassignments * 0.5")),
    "m14_incident_cost": Metric("incident_fact", "opened_at", "usd", 1, where=LIVE, **_sum("cost_usd")),
    "m15_change_count": Metric("change_fact", "actual_end", "count", 1, where="deployed", **_count()),
    "m16_change_failure_rate": Metric("change_fact", "actual_end", "ratio", 10, **_ratio("failed", "deployed")),
    "m17_change_caused_incidents": Metric("change_fact", "actual_end", "count", 1, where="failed", value="CAST(count(DISTINCT incident_id) AS DOUBLE)", value_sql="CAST(count(DISTINCT incident_id) AS DOUBLE)"),
    "m18_change_lead_time_hours": Metric("change_fact", "actual_end", "hours", 10, where="deployed", **_median("lead_h")),
    "m19_emergency_ratio": Metric("change_fact", "actual_end", "ratio", 10, **_ratio("type = 'emergency'", "deployed")),
    "m20_throughput": Metric("item_fact", "done_at", "count", 1, where="done_at IS NOT NULL", **_count()),
    "m21_cycle_days": Metric("item_fact", "done_at", "days", 10, where="done_at IS NOT NULL", **_median("cycle_days")),
    "m25_unplanned_ratio": Metric("item_fact", "done_at", "ratio", 20, where="done_at IS NOT NULL", **_ratio("unplanned")),
    "m27_availability_pct": Metric("daily_fact", "ts", "percent", 7, **_weighted("sum(value * requests)")),
    "m28_error_rate": Metric("daily_fact", "ts", "ratio", 7, **_weighted("sum(errors)")),
}


def compute(fact: DataFrame, m: Metric, entity: str, unit: str = "month", window: tuple[str, str] | None = None, zone: str = ZONE, digits: int = 6) -> DataFrame:
    """entity_id, period_start, value, numerator, denominator, sample_size, unit, flags."""
    at = F.col(m.at)
    df = fact.filter(F.expr(m.where)).filter(at.isNotNull())
    if window:
        # on the bare column, so that the bounds reach the scan
        df = df.filter((at >= F.lit(window[0]).cast("timestamp")) & (at < F.lit(window[1]).cast("timestamp")))
    df = df.withColumn("period_start", X.bucket_start(at, unit, zone))
    keys = [F.col(entity).cast("string").alias("entity_id"), "period_start"]
    if m.value.startswith("median("):
        # equal values are counted first, in buffers of fixed size: a median holds the different ones only
        x = F.expr(m.value.removeprefix("median(").removesuffix(")"))
        n = df.groupBy(*keys, x.alias("__x")).agg(F.count("*").alias("__n"))
        known = F.coalesce(F.sum(F.when(F.col("__x").isNotNull(), F.col("__n"))), F.lit(0))
        g = n.groupBy("entity_id", "period_start").agg(F.expr("percentile(__x, 0.5, __n)").cast("double").alias("value"), known.cast("double").alias("numerator"), F.sum("__n").cast("double").alias("denominator"), known.alias("sample_size"))
        return finish(g, m, digits)
    g = df.groupBy(*keys).agg(
        F.expr(m.value).cast("double").alias("value"),
        F.expr(f"CAST({m.numerator} AS DOUBLE)").alias("numerator"),
        F.expr(f"CAST({m.denominator} AS DOUBLE)").alias("denominator"),
        F.count_if(F.expr(m.sample)).alias("sample_size"),
    )
    return finish(g, m, digits)


def finish(g: DataFrame, m: Metric, digits: int = 6) -> DataFrame:
    few = F.col("sample_size") < m.least
    flags = X.flags(("insufficient_sample", few), ("low_coverage", F.col("numerator").isNotNull() & F.lit(m.unit != "ratio") & (F.col("numerator") < LOW_COVERAGE * F.col("denominator"))), ("estimate", F.lit(m.estimate)))
    return g.filter(F.col("entity_id").isNotNull()).select("entity_id", "period_start", F.when(~few, F.round("value", digits)).alias("value"), "numerator", "denominator", "sample_size", F.lit(m.unit).alias("unit"), flags.alias("flags"))


def sql(facts: str, m: Metric, entity: str, unit: str = "month", zone: str = ZONE, digits: int = 6) -> str:
    """The check of ``compute`` in the other dialect."""
    cover = "FALSE" if m.unit == "ratio" else f"numerator IS NOT NULL AND numerator < {LOW_COVERAGE} * denominator"
    return f"""WITH {facts},
g AS (SELECT CAST({entity} AS VARCHAR) entity_id, CAST(date_trunc('{unit}', timezone('{zone}', timezone('UTC', {m.at}))) AS DATE) period_start,
  CAST({m.value_sql} AS DOUBLE) AS "value", CAST({m.numerator_sql} AS DOUBLE) numerator, CAST({m.denominator_sql} AS DOUBLE) denominator, count(*) FILTER (WHERE {m.sample}) sample_size
  FROM {m.fact} WHERE {m.where} AND {m.at} IS NOT NULL GROUP BY 1, 2)
SELECT entity_id, period_start, CASE WHEN sample_size >= {m.least} THEN round("value", {digits}) END AS "value", numerator, denominator, sample_size, '{m.unit}' AS unit,
  concat_ws(',', {"'estimate'," if m.estimate else ''} CASE WHEN sample_size < {m.least} THEN 'insufficient_sample' END, CASE WHEN {cover} THEN 'low_coverage' END) AS flags
FROM g WHERE entity_id IS NOT NULL"""
