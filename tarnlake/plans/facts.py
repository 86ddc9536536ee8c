"""Facts of incidents, changes and work items over the canonical tables, with money and flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tarnlake.functions import columns as X
from tarnlake.operators import joins as J
from tarnlake.plans.canonical import Model
from tarnlake.plans.model_sql import CTE


@dataclass(frozen=True)
class Rules:
    """What counts and what it costs; the defaults are those of the checks."""

    excluded_states: tuple[str, ...] = ("canceled",)
    excluded_codes: tuple[str, ...] = ("Duplicate", "Cancelled", "Not an incident")
    most_resolve_days: int = 365
    least_membership: float = 0.5
    least_link_score: float = 0.7
    repeat_days: int = 30
    failure_outcomes: tuple[str, ...] = ("failed", "rolled_back")
    noise_severities: tuple[str, ...] = ("info", "warning")
    fallback: bool = True
    fallback_priority: int = 2
    outage_share: dict = field(default_factory=lambda: {1: 0.5, 2: 0.25})
    cap_hours: float = 48.0
    business_share: float = 0.3
    effort_share: dict = field(default_factory=lambda: {1: 0.8, 2: 0.5, 3: 0.25, 4: 0.1, 5: 0.1})
    most_toil_hours: float = 40.0
    downtime_usd: dict = field(default_factory=lambda: {1: 10_000.0, 2: 4_000.0, 3: 1_000.0})
    downtime_default: float = 500.0
    priority_factor: dict = field(default_factory=lambda: {1: 1.0, 2: 0.6, 3: 0.3, 4: 0.1, 5: 0.05})
    engineer_hour: float = 90.12345
    triage_minutes: float = 10.0
    backout_hours: float = 4.0


RULES = Rules()


def best_member(m: Model, rules: Rules = RULES) -> DataFrame:
    """Each record's likeliest cluster, where the membership is likely enough."""
    likely = m.raw("cluster_member").filter(F.col("membership_prob") >= rules.least_membership)
    return J.best_by(likely, ["record_id"], F.desc("membership_prob"), F.asc("cluster_id"))


def incident_fact(m: Model, rules: Rules = RULES) -> DataFrame:
    teams = m.core("team").select("team_id", "org_id")
    services = m.core("service").select("service_id", "criticality")
    linked = m.raw("change_link").filter(F.col("score") >= rules.least_link_score).select(F.col("incident_id").alias("record_id")).distinct().withColumn("is_linked", F.lit(True))
    i = m.core("incident").join(teams, "team_id", "left").join(services, "service_id", "left").join(best_member(m, rules), "record_id", "left").join(linked, "record_id", "left")
    excluded = F.coalesce(F.col("state"), F.lit("")).isin(*rules.excluded_states) | F.coalesce(F.col("close_code"), F.lit("")).isin(*rules.excluded_codes)
    i = i.withColumn("excluded", excluded).withColumn("resolve_h", X.elapsed_hours(F.col("opened_at"), F.col("resolved_at"), rules.most_resolve_days))
    i = i.withColumn("resolve_bh", F.when(F.col("resolve_h").isNotNull() & (F.col("business_duration_s") >= 0), F.col("business_duration_s") / 3600.0))
    p = F.coalesce("priority", F.lit(5))
    kind = F.when(F.col("excluded"), "excluded").when(F.col("customer_impact_minutes") >= 0, "measured")
    if rules.fallback:
        kind = kind.when((p <= rules.fallback_priority) & F.col("resolve_h").isNotNull(), "fallback")
    i = i.withColumn("impact", kind.otherwise("none"))
    hours = F.when(F.col("impact") == "measured", F.col("customer_impact_minutes") / 60.0).when(F.col("impact") == "fallback", F.least(F.col("resolve_h") * X.lookup(p, rules.outage_share, 0.0), F.lit(rules.cap_hours))).when(F.col("impact") == "none", F.lit(0.0))
    worked = F.coalesce("resolve_bh", F.col("resolve_h") * rules.business_share)
    i = i.withColumn("impact_h", hours).withColumn("toil_h", F.when(~F.col("excluded") & worked.isNotNull(), F.least(worked * X.lookup(p, rules.effort_share, 0.0), F.lit(rules.most_toil_hours))))
    usd = lambda x: F.when(~F.col("excluded"), x.cast("decimal(18,2)"))
    i = i.withColumn("downtime_usd", usd(F.col("impact_h") * X.lookup(F.col("criticality"), rules.downtime_usd, rules.downtime_default) * X.lookup(p, rules.priority_factor, 0.0)))
    i = i.withColumn("toil_usd", usd(F.coalesce("toil_h", F.lit(0.0)) * rules.engineer_hour))
    # keyed by cluster and service, the window never holds more than one such group
    before = F.lag("opened_at").over(Window.partitionBy("excluded", "cluster_id", "service_id").orderBy("opened_at", "record_id"))
    gap = F.unix_timestamp("opened_at") - F.unix_timestamp(before)
    known = ~F.col("excluded") & F.col("cluster_id").isNotNull() & F.col("service_id").isNotNull()
    return i.select(
        "record_id", "number", "opened_at", "resolved_at", "priority", "service_id", "team_id", "org_id", "criticality", "cluster_id", "membership_prob", "excluded", "resolve_h", "resolve_bh", "impact_h",
        (F.col("impact") == "fallback").alias("impact_estimated"), "toil_h", "downtime_usd", "toil_usd",
        (F.col("downtime_usd") + F.col("toil_usd")).cast("decimal(18,2)").alias("total_usd"),
        F.coalesce(known & (gap <= rules.repeat_days * 86400), F.lit(False)).alias("is_repeat"),
        (F.coalesce("reopen_count", F.lit(0)) > 0).alias("is_reopened"), (F.coalesce("reassignment_count", F.lit(0)) > 0).alias("is_reassigned"), "sla_breached",
        (F.col("caused_by_change_id").isNotNull() | F.col("is_linked").isNotNull()).alias("change_caused"),
    )


def causes(m: Model, rules: Rules = RULES) -> DataFrame:
    """change_id, incident_id, each pair once: named by the incident or linked well enough."""
    named = m.core("incident").filter("caused_by_change_id is not null").select(F.col("caused_by_change_id").alias("change_id"), F.col("record_id").alias("incident_id"))
    linked = m.raw("change_link").filter(F.col("score") >= rules.least_link_score).select("change_id", "incident_id")
    return named.union(linked).distinct()


def change_fact(m: Model, rules: Rules = RULES) -> DataFrame:
    counted = m.fact("incident").filter("not excluded").select(F.col("record_id").alias("incident_id"))
    n = causes(m, rules).join(counted, "incident_id", "left_semi").groupBy("change_id").agg(F.count("*").cast("int").alias("n"))
    c = m.core("change").join(m.core("team").select("team_id", "org_id"), "team_id", "left").join(n, F.col("record_id") == F.col("change_id"), "left")
    outcome = F.coalesce("outcome", F.lit(""))
    c = c.withColumn("deployed", F.col("actual_end").isNotNull() & (outcome != "canceled")).withColumn("linked_incident_count", F.coalesce("n", F.lit(0)))
    failed = F.col("deployed") & (outcome.isin(*rules.failure_outcomes) | (F.col("linked_incident_count") > 0))
    lead = F.when(F.col("opened_at") <= F.col("actual_end"), (F.unix_timestamp("actual_end") - F.unix_timestamp("opened_at")) / 3600.0)
    return c.select("record_id", "type", "service_id", "team_id", "org_id", "actual_end", "deployed", failed.alias("failed"), "linked_incident_count", lead.alias("lead_time_h"))


def work_item_fact(m: Model, rules: Rules = RULES) -> DataFrame:
    when = lambda c: F.when(F.col("to_category") == c, F.col("at"))
    moves = m.core("work_item_transition").groupBy("record_id").agg(F.min(when("in_progress")).alias("first_in_progress_at"), F.max(when("done")).alias("last_done_at"))
    said = m.core("work_item_link").filter("link_type = 'mentions_incident'")
    said = said.select(F.col("from_key").alias("key")).union(said.select("to_key")).distinct().withColumn("mentioned", F.lit(True))
    w = m.core("work_item").join(m.core("team").select("team_id", "org_id"), "team_id", "left").join(moves, "record_id", "left").join(said, "key", "left")
    w = w.withColumn("done_at", F.when(F.col("status_category") == "done", F.coalesce("last_done_at", "resolved_at")))
    days = F.when(F.col("done_at") >= F.col("first_in_progress_at"), (F.unix_timestamp("done_at") - F.unix_timestamp("first_in_progress_at")) / 86400.0)
    unplanned = F.coalesce(F.col("type") == "bug", F.lit(False)) | F.col("mentioned").isNotNull()
    return w.select("record_id", "key", "type", "parent_key", "status_category", "service_id", "team_id", "org_id", "story_points", "created_at", "first_in_progress_at", "done_at", days.alias("cycle_days"), unplanned.alias("is_unplanned"))


def org_closure(m: Model, most_depth: int = 20) -> DataFrame:
    return J.closure(m.core("org"), "org_id", "parent_org_id", most_depth).select("org_id", F.col("ancestor").alias("ancestor_org_id"), "depth")


FACTS = {"incident": incident_fact, "change": change_fact, "work_item": work_item_fact, "org_closure": org_closure}


# -- as SQL -----------------------------------------------------------------------
def _case(key: str, table: dict, default: float) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {v!r}::DOUBLE" for k, v in table.items()) + f" ELSE {default!r}::DOUBLE END"


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


R = RULES
for _n in ("cluster_member", "change_link", "cluster", "cluster_service", "decision"):
    from tarnlake.plans.rawlake import raw_sql as _raw_sql

    CTE[_n] = _raw_sql(_n)
CTE["likeliest"] = f"SELECT DISTINCT ON (record_id) record_id, cluster_id, membership_prob FROM cluster_member WHERE membership_prob >= {R.least_membership} ORDER BY record_id, membership_prob DESC, cluster_id"
CTE["cause_pairs"] = f"SELECT caused_by_change_id AS change_id, record_id AS incident_id FROM core_incident WHERE caused_by_change_id IS NOT NULL UNION SELECT change_id, incident_id FROM change_link WHERE score >= {R.least_link_score}"
CTE["incident_steps"] = f"""SELECT *, CASE WHEN excluded THEN NULL WHEN customer_impact_minutes >= 0 THEN customer_impact_minutes / 60.0 WHEN prio <= {R.fallback_priority} AND resolve_h IS NOT NULL THEN least(resolve_h * {_case('prio', R.outage_share, 0.0)}, {R.cap_hours}) ELSE 0.0 END AS impact_h,
 NOT excluded AND NOT coalesce(customer_impact_minutes >= 0, false) AND prio <= {R.fallback_priority} AND resolve_h IS NOT NULL AS impact_estimated, CASE WHEN NOT excluded AND coalesce(resolve_bh, resolve_h) IS NOT NULL THEN least(coalesce(resolve_bh, resolve_h * {R.business_share}) * {_case('prio', R.effort_share, 0.0)}, {R.most_toil_hours}) END AS toil_h
 FROM (SELECT *, CASE WHEN resolve_h IS NOT NULL AND business_duration_s >= 0 THEN business_duration_s / 3600.0 END AS resolve_bh FROM (SELECT i.*, t.org_id, v.criticality, l.cluster_id, l.membership_prob, coalesce(priority, 5) prio, coalesce(state, '') IN {_in(R.excluded_states)} OR coalesce(close_code, '') IN {_in(R.excluded_codes)} AS excluded,
  CASE WHEN epoch(resolved_at) - epoch(opened_at) BETWEEN 0 AND {R.most_resolve_days * 86400} THEN (epoch(resolved_at) - epoch(opened_at)) / 3600.0 END AS resolve_h FROM core_incident i LEFT JOIN core_team t USING (team_id) LEFT JOIN core_service v ON v.service_id = i.service_id LEFT JOIN likeliest l ON l.record_id = i.record_id))"""
CTE["fact_incident"] = f"""SELECT record_id, number, opened_at, resolved_at, priority, service_id, team_id, org_id, criticality, cluster_id, membership_prob, excluded, resolve_h, resolve_bh, impact_h, impact_estimated, toil_h, downtime_usd, toil_usd, CAST(downtime_usd + toil_usd AS DECIMAL(18,2)) AS total_usd,
 coalesce(NOT excluded AND cluster_id IS NOT NULL AND service_id IS NOT NULL AND epoch(opened_at) - epoch(lag(opened_at) OVER (PARTITION BY excluded, cluster_id, service_id ORDER BY opened_at, record_id)) <= {R.repeat_days * 86400}, false) AS is_repeat, coalesce(reopen_count, 0) > 0 AS is_reopened, coalesce(reassignment_count, 0) > 0 AS is_reassigned, sla_breached,
 caused_by_change_id IS NOT NULL OR record_id IN (SELECT incident_id FROM change_link WHERE score >= {R.least_link_score}) AS change_caused
 FROM (SELECT *, CASE WHEN NOT excluded THEN CAST(impact_h * {_case('criticality', R.downtime_usd, R.downtime_default)} * {_case('prio', R.priority_factor, 0.0)} AS DECIMAL(18,2)) END AS downtime_usd, CASE WHEN NOT excluded THEN CAST(coalesce(toil_h, 0) * {R.engineer_hour} AS DECIMAL(18,2)) END AS toil_usd FROM incident_steps)"""
CTE["fact_change"] = f"""SELECT record_id, "type", service_id, team_id, org_id, actual_end, deployed, deployed AND (bad OR linked_incident_count > 0) AS failed, linked_incident_count, CASE WHEN opened_at <= actual_end THEN (epoch(actual_end) - epoch(opened_at)) / 3600.0 END AS lead_time_h
 FROM (SELECT c.*, t.org_id, actual_end IS NOT NULL AND coalesce(outcome, '') <> 'canceled' AS deployed, coalesce(outcome, '') IN {_in(R.failure_outcomes)} AS bad, CAST((SELECT count(*) FROM cause_pairs p JOIN fact_incident f ON f.record_id = p.incident_id AND NOT f.excluded WHERE p.change_id = c.record_id) AS INTEGER) AS linked_incident_count FROM core_change c LEFT JOIN core_team t USING (team_id))"""
CTE["fact_work_item"] = """SELECT record_id, "key", "type", parent_key, status_category, service_id, team_id, org_id, story_points, created_at, first_in_progress_at, done_at, CASE WHEN done_at >= first_in_progress_at THEN (epoch(done_at) - epoch(first_in_progress_at)) / 86400.0 END AS cycle_days, is_unplanned
 FROM (SELECT w.*, t.org_id, v.first_in_progress_at, CASE WHEN w.status_category = 'done' THEN coalesce(v.last_done_at, w.resolved_at) END AS done_at, coalesce(w."type", '') = 'bug' OR w."key" IN (SELECT unnest([from_key, to_key]) FROM core_work_item_link WHERE link_type = 'mentions_incident') AS is_unplanned
  FROM core_work_item w LEFT JOIN core_team t USING (team_id) LEFT JOIN (SELECT record_id, min(CASE WHEN to_category = 'in_progress' THEN "at" END) first_in_progress_at, max(CASE WHEN to_category = 'done' THEN "at" END) last_done_at FROM core_work_item_transition GROUP BY 1) v USING (record_id))"""
CTE["fact_org_closure"] = """SELECT org_id, ancestor_org_id, CAST(min(depth) AS INTEGER) AS depth FROM (WITH RECURSIVE up(org_id, ancestor_org_id, depth) AS (SELECT org_id, org_id, 0 FROM core_org UNION ALL SELECT u.org_id, o.parent_org_id, u.depth + 1 FROM up u JOIN core_org o ON o.org_id = u.ancestor_org_id WHERE o.parent_org_id IS NOT NULL AND u.depth < 20) SELECT * FROM up) GROUP BY 1, 2"""
