"""Metrics of the catalogue over the canonical facts: each for services, teams, all organisations above a team and clusters, by month.

A metric's value, coverage and flags are those of ``metrics``; here are the facts it reads
and who a row counts for.  A row counts once for its service, its team, its cluster and
each organisation above its team, so the sums of entities of one type don't depend on
those of another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.plans import facts, model_sql
from tarnlake.plans.adapter import Tables
from tarnlake.plans.canonical import Model
from tarnlake.plans.metrics import LIVE, ZONE, Metric, _count, _mean, _median, _ratio, _sum, compute, sql
from tarnlake.plans.orgscore import noise_events
from tarnlake.plans.relational import QUERIES, SQL
from tarnlake.streaming.stateful import timelines


def _incident(m: Model) -> DataFrame:
    ack = m.core("incident").select("record_id", "acknowledged_at")
    minutes = F.when(F.col("acknowledged_at") >= F.col("opened_at"), (F.unix_timestamp("acknowledged_at") - F.unix_timestamp("opened_at")) / 60.0)
    return m.fact("incident").join(ack, "record_id").withColumn("ack_m", minutes).drop("acknowledged_at")


def _caused(m: Model) -> DataFrame:
    live = m.fact("incident").filter("not excluded").select(F.col("record_id").alias("incident_id"))
    pairs = facts.causes(m).join(live, "incident_id", "left_semi").withColumnRenamed("change_id", "record_id")
    return m.fact("change").filter("failed").join(pairs, "record_id")


#: Months of the snapshots, half open; items of these types are counted.
MONTHS = ("1995-01-01", "2001-07-01")
COUNTED = ("story", "bug", "task")


def spans(m: Model) -> DataFrame:
    """record_id, since, until, category: to do from creation on, then what each transition leads to."""
    moved = m.core("work_item_transition").select("record_id", "at", F.coalesce("to_category", F.lit("todo")).alias("category"))
    lines = timelines(moved, "record_id", "at", "category", keep_days=1_000_000)
    first = moved.groupBy("record_id").agg(F.min("at").alias("until"))
    new = m.fact("work_item").select("record_id", F.col("created_at").alias("since")).join(first, "record_id", "left").filter(F.col("until").isNull() | (F.col("since") < F.col("until")))
    return lines.unionByName(new.filter("since is not null").withColumn("category", F.lit("todo")))


def _at_months(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """Rows once for each first day of a month (``month``, local) that their span covers, from ``first`` to ``last``.

    A span is laid out over its own months only; no spine is joined.
    """
    local = lambda c: F.from_utc_timestamp(c, ZONE)
    start = F.trunc(local("since"), "month")
    start = F.when(start.cast("timestamp") == local("since"), start).otherwise(F.add_months(start, 1))
    lo, hi = F.greatest(start, first), F.least(F.coalesce(F.to_date(local("until")), last), last)
    months = F.when(lo <= hi, F.sequence(lo, hi, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    out = rows.withColumn("month", F.explode(months))
    return out.filter(F.col("until").isNull() | (F.col("month").cast("timestamp") < local("until")))


def _instant(day: Column) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), ZONE)


def _snapshots(m: Model, category: str, at_start: bool) -> DataFrame:
    """Items in a category at the start or the end of a month, with start_ts and end_ts of the month."""
    begin, end = (F.lit(x).cast("date") for x in MONTHS)
    items = m.fact("work_item").filter(F.col("type").isin(*COUNTED))
    own = m.kept("cm_spans", lambda: spans(m)).filter(F.col("category") == category)
    x = _at_months(own, begin, F.add_months(end, -1)) if at_start else _at_months(own, F.add_months(begin, 1), end)
    start = F.col("month") if at_start else F.add_months("month", -1)
    x = x.select("record_id", _instant(start).alias("start_ts"), _instant(F.add_months(start, 1)).alias("end_ts"))
    return items.join(x, "record_id")


def _backlog(m: Model) -> DataFrame:
    return _snapshots(m, "todo", False).withColumn("age_d", (F.unix_timestamp("end_ts") - F.unix_timestamp("created_at")) / 86400.0)


def _carried(m: Model) -> DataFrame:
    x = _snapshots(m, "in_progress", True)
    done = m.kept("cm_spans", lambda: spans(m)).filter("category = 'done'").select("record_id", "since", "until")
    # met by item and month: a row number would not be the same where the snapshots are made a second time
    over = x.select("record_id", "end_ts").join(done, "record_id").filter((F.col("since") <= F.col("end_ts")) & (F.col("until").isNull() | (F.col("until") > F.col("end_ts")))).select("record_id", "end_ts").distinct()
    return x.join(over.withColumn("is_done", F.lit(True)), ["record_id", "end_ts"], "left").withColumn("is_open", F.col("is_done").isNull()).drop("is_done")


SOURCES = {"cm_wip": lambda m: _snapshots(m, "in_progress", False), "cm_backlog": _backlog, "cm_carried": _carried, "cm_incident": _incident, "cm_change": lambda m: m.fact("change"), "cm_caused": _caused, "cm_item": lambda m: m.fact("work_item"), "cm_noise": noise_events}
CLUSTERED = ("cm_incident",)
CTE = model_sql.CTE
CTE["cm_incident_rows"] = "SELECT f.*, CASE WHEN a.acknowledged_at >= f.opened_at THEN (epoch(a.acknowledged_at) - epoch(f.opened_at)) / 60.0 END AS ack_m FROM fact_incident f JOIN core_incident a USING (record_id)"
CTE["cm_change_rows"] = "SELECT * FROM fact_change"
CTE["cm_caused_rows"] = "SELECT c.*, p.incident_id FROM fact_change c JOIN cause_pairs p ON p.change_id = c.record_id JOIN fact_incident f ON f.record_id = p.incident_id AND NOT f.excluded WHERE c.failed"
CTE["cm_months"] = f"SELECT timezone('UTC', timezone('{ZONE}', r)) AS start_ts, timezone('UTC', timezone('{ZONE}', r + INTERVAL 1 MONTH)) AS end_ts FROM (SELECT unnest(range(TIMESTAMP '{MONTHS[0]}', TIMESTAMP '{MONTHS[1]}', INTERVAL 1 MONTH)) AS r)"
CTE["cm_moves"] = """SELECT record_id, "at", coalesce(arg_max(to_category, CASE to_category WHEN 'done' THEN 2 WHEN 'in_progress' THEN 1 ELSE 0 END), 'todo') AS category FROM core_work_item_transition WHERE "at" IS NOT NULL GROUP BY 1, 2"""
_items = f"(SELECT f.*, start_ts, end_ts FROM fact_work_item f JOIN cm_months ON true WHERE f.\"type\" IN {COUNTED!r})"
CTE["cm_both"] = f"""SELECT w.*, coalesce(a.category, CASE WHEN created_at <= start_ts THEN 'todo' END) AS at_start, coalesce(b.category, CASE WHEN created_at <= end_ts THEN 'todo' END) AS at_end FROM {_items} w
 ASOF LEFT JOIN cm_moves a ON a.record_id = w.record_id AND w.start_ts >= a."at" ASOF LEFT JOIN cm_moves b ON b.record_id = w.record_id AND w.end_ts >= b."at\""""
CTE["cm_wip_rows"] = "SELECT * FROM cm_both WHERE at_end = 'in_progress'"
CTE["cm_backlog_rows"] = "SELECT *, (epoch(end_ts) - epoch(created_at)) / 86400.0 AS age_d FROM cm_both WHERE at_end = 'todo'"
CTE["cm_carried_rows"] = "SELECT *, coalesce(at_end, '') <> 'done' AS is_open FROM cm_both WHERE at_start = 'in_progress'"
CTE["cm_item_rows"] = "SELECT * FROM fact_work_item"
CTE["cm_noise_rows"] = "SELECT e.ts, e.service_id, o.owner AS team_id, v.org_id, e.incident_id FROM core_event e LEFT JOIN os_owner o USING (service_id) LEFT JOIN core_service v ON v.service_id = e.service_id WHERE e.severity IN ('info', 'warning')"
for _name in SOURCES:
    _own = [("service", "service_id"), ("team", "team_id"), *([("cluster", "cluster_id")] if _name in CLUSTERED else [])]
    CTE[_name] = " UNION ALL ".join([f"SELECT '{t}/' || {c} AS entity, * FROM {_name}_rows WHERE {c} IS NOT NULL" for t, c in _own] + [f"SELECT 'org/' || x.ancestor_org_id, r.* FROM {_name}_rows r JOIN fact_org_closure x ON x.org_id = r.org_id"])


def for_entities(m: Model, name: str) -> DataFrame:
    """The source's rows with entity ('team/...'), once for each entity that they count for."""
    rows = m.kept(f"{name}_rows", lambda: SOURCES[name](m))
    own = [("service", "service_id"), ("team", "team_id"), *([("cluster", "cluster_id")] if name in CLUSTERED else [])]
    up = m.fact("org_closure").select("org_id", F.col("ancestor_org_id").alias("__up"))
    out = rows.join(up, "org_id").withColumn("entity", F.concat(F.lit("org/"), "__up")).drop("__up")
    for kind, column in own:
        out = out.unionByName(rows.filter(F.col(column).isNotNull()).withColumn("entity", F.concat(F.lit(f"{kind}/"), F.col(column))))
    return out


_done = "done_at IS NOT NULL"
CATALOGUE: dict[str, Metric] = {
    "cm01_incident_count": Metric("cm_incident", "opened_at", "count", 1, where=LIVE, **_count()),
    "cm02_p1p2_count": Metric("cm_incident", "opened_at", "count", 1, where=f"{LIVE} AND priority <= 2", **_count()),
    "cm03_mttr_hours": Metric("cm_incident", "resolved_at", "hours", 3, where=LIVE, **_mean("resolve_h")),
    "cm04_mttr_p50_hours": Metric("cm_incident", "resolved_at", "hours", 3, where=LIVE, **_median("resolve_h")),
    "cm05_mttr_business_hours": Metric("cm_incident", "resolved_at", "hours", 3, where=LIVE, **_mean("resolve_bh")),
    "cm06_mtta_minutes": Metric("cm_incident", "opened_at", "minutes", 3, where=LIVE, **_mean("ack_m")),
    "cm07_customer_impact_minutes": Metric("cm_incident", "opened_at", "minutes", 1, where=LIVE, estimate=True, **_sum("impact_h * 60")),
    "cm08_repeat_incident_rate": Metric("cm_incident", "opened_at", "ratio", 5, where=LIVE, **_ratio("is_repeat")),
    "cm09_reopen_rate": Metric("cm_incident", "resolved_at", "ratio", 3, where=LIVE, **_ratio("is_reopened")),
    "cm10_reassignment_rate": Metric("cm_incident", "resolved_at", "ratio", 3, where=LIVE, **_ratio("is_reassigned")),
    "cm11_sla_breach_rate": Metric("cm_incident", "resolved_at", "ratio", 3, where=LIVE, **_ratio("sla_breached", "sla_breached IS NOT NULL")),
    "cm12_alert_noise_ratio": Metric("cm_noise", "ts", "ratio", 5, **_ratio("incident_id IS NULL", "TRUE")),
    "cm13_toil_hours_est": Metric("cm_incident", "resolved_at", "hours", 1, where=LIVE, estimate=True, **_sum("toil_h")),
    "cm14_incident_cost_usd": Metric("cm_incident", "opened_at", "usd", 1, where=LIVE, estimate=True, **_sum("total_usd")),
    "cm15_change_count": Metric("cm_change", "actual_end", "count", 1, where="deployed", **_count()),
    "cm16_change_failure_rate": Metric("cm_change", "actual_end", "ratio", 3, **_ratio("failed", "deployed")),
    "cm17_change_caused_incidents": Metric("cm_caused", "actual_end", "count", 1, value="CAST(count(DISTINCT incident_id) AS DOUBLE)", value_sql="CAST(count(DISTINCT incident_id) AS DOUBLE)"),
    "cm18_change_lead_time_hours": Metric("cm_change", "actual_end", "hours", 3, where="deployed", **_median("lead_time_h")),
    "cm19_emergency_change_ratio": Metric("cm_change", "actual_end", "ratio", 3, **_ratio("type = 'emergency'", "deployed")),
    "cm20_throughput": Metric("cm_item", "done_at", "count", 1, where=_done, **_count()),
    "cm21_cycle_time_days": Metric("cm_item", "done_at", "days", 3, where=_done, **_median("cycle_days")),
    "cm22_carryover_rate": Metric("cm_carried", "start_ts", "ratio", 3, **_ratio("is_open")),
    "cm23_backlog_age_days": Metric("cm_backlog", "start_ts", "days", 3, **_median("age_d")),
    "cm24_wip_count": Metric("cm_wip", "start_ts", "count", 1, **_count()),
    "cm25_unplanned_work_ratio": Metric("cm_item", "done_at", "ratio", 5, where=_done, **_ratio("is_unplanned")),
}


def values(m: Model, name: str, unit: str = "month", window: tuple[str, str] | None = None) -> DataFrame:
    """entity_type, entity_id, period_start, value, numerator, denominator, sample_size, unit, flags."""
    metric = CATALOGUE[name]
    out = compute(for_entities(m, metric.fact), metric, "entity", unit, window)
    kind = F.substring_index("entity_id", "/", 1)
    return out.withColumn("entity_type", kind).withColumn("entity_id", F.expr("substring(entity_id, length(entity_type) + 2)"))


def check_sql(name: str, unit: str = "month") -> str:
    metric = CATALOGUE[name]
    tables = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in model_sql.needed(metric.fact))
    return f"SELECT * REPLACE (substr(entity_id, instr(entity_id, '/') + 1) AS entity_id), split_part(entity_id, '/', 1) AS entity_type FROM ({sql(tables, metric, 'entity', unit)})"


def _register(name: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: values(Model.of(Tables(spark, sf_dir)), name)
    SQL[name] = check_sql(name)


for _name in CATALOGUE:
    _register(_name)
