"""Metric values, scores and levers as SQL (DuckDB), for checks."""

from __future__ import annotations

from tarnlake.plans.facts import RULES as R
from tarnlake.plans.model_sql import CTE
from tarnlake.plans.orgscore import CARD as C

_NOW = f"TIMESTAMP '{C.as_of} 00:00:00'"
CTE["os_owner"] = """SELECT DISTINCT ON (service_id) service_id, team_id AS owner FROM core_service_map WHERE "role" IN ('owner', 'support') AND team_id IS NOT NULL AND service_id IS NOT NULL ORDER BY service_id, confidence DESC NULLS LAST, team_id"""
CTE["os_noise"] = """SELECT e.ts, o.owner AS team_id, v.org_id, e.incident_id FROM core_event e LEFT JOIN os_owner o USING (service_id) LEFT JOIN core_service v ON v.service_id = e.service_id WHERE e.severity IN ('info', 'warning')"""
_inc = lambda metric, ts, num, cond: f"SELECT '{metric}' metric, team_id, org_id, {ts} ts, CAST({num} AS DOUBLE) num FROM fact_incident WHERE NOT excluded AND {cond}"
CTE["os_rows"] = " UNION ALL ".join((
    _inc("mttr_hours", "resolved_at", "resolve_h", "resolve_h IS NOT NULL"),
    _inc("reopen_rate", "resolved_at", "CAST(is_reopened AS INTEGER)", "resolved_at IS NOT NULL"),
    _inc("reassignment_rate", "resolved_at", "CAST(is_reassigned AS INTEGER)", "resolved_at IS NOT NULL"),
    _inc("sla_breach_rate", "resolved_at", "CAST(sla_breached AS INTEGER)", "resolved_at IS NOT NULL AND sla_breached IS NOT NULL"),
    _inc("repeat_incident_rate", "opened_at", "CAST(is_repeat AS INTEGER)", "opened_at IS NOT NULL"),
    "SELECT 'change_failure_rate', team_id, org_id, actual_end, CAST(CAST(failed AS INTEGER) AS DOUBLE) FROM fact_change WHERE deployed",
    "SELECT 'alert_noise_ratio', team_id, org_id, ts, CASE WHEN incident_id IS NULL THEN 1.0 ELSE 0.0 END FROM os_noise WHERE ts IS NOT NULL",
))


def _each(table: str) -> str:
    return f"SELECT 'team' AS entity_type, team_id AS entity_id, * FROM {table} WHERE team_id IS NOT NULL UNION ALL SELECT 'org', x.ancestor_org_id, r.* FROM {table} r JOIN fact_org_closure x ON x.org_id = r.org_id"


_least = "CASE metric " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in C.least_sample.items()) + " END"
CTE["os_entity_rows"] = _each("os_rows")
CTE["os_values"] = f"""SELECT metric, entity_type, entity_id, period, period_start, CASE WHEN n >= {_least} THEN num / n END AS "value", num AS numerator, CAST(n AS DOUBLE) AS denominator, n AS sample_size, CASE WHEN metric = 'mttr_hours' THEN 'hours' ELSE 'ratio' END AS unit, CASE WHEN n < {_least} THEN 'insufficient_sample' ELSE '' END AS flags FROM (
 SELECT metric, entity_type, entity_id, 'window' AS period, DATE '{C.as_of}' - {7 * C.window_weeks} AS period_start, sum(num) num, count(*) n FROM os_entity_rows WHERE ts < {_NOW} AND ts >= {_NOW} - INTERVAL {7 * C.window_weeks} DAY GROUP BY ALL
 UNION ALL SELECT metric, entity_type, entity_id, 'week', CAST(date_trunc('week', ts) AS DATE), sum(num), count(*) FROM os_entity_rows WHERE ts < date_trunc('week', {_NOW}) AND ts >= date_trunc('week', {_NOW}) - INTERVAL {7 * C.trend_weeks} DAY GROUP BY ALL)"""
CTE["os_entities"] = """SELECT 'team' AS entity_type, t.team_id AS entity_id, 'team:crit_' || coalesce((SELECT CASE WHEN min(criticality) <= 2 THEN 'hi' WHEN min(criticality) <= 4 THEN 'lo' ELSE 'none' END FROM core_service_map p JOIN core_service v ON v.service_id = p.service_id WHERE p.team_id = t.team_id AND p."role" IN ('owner', 'support')), 'none') AS nat, 'team:all' AS everyone FROM core_team t WHERE active
 UNION ALL SELECT 'org', org_id, 'org:level' || max(depth), 'org:all' FROM fact_org_closure GROUP BY org_id"""
CTE["os_base"] = """SELECT e.*, c.metric, c.w, v."value" AS x, v.sample_size, v.flags = 'insufficient_sample' AS few, CASE WHEN count(v."value") OVER (PARTITION BY e.entity_type, c.metric, e.nat) < 5 THEN e.everyone ELSE e.nat END AS peers FROM os_entities e CROSS JOIN (VALUES CARDROWS) c(metric, w) LEFT JOIN os_values v ON v.metric = c.metric AND v.entity_type = e.entity_type AND v.entity_id = e.entity_id AND v.period = 'window'""".replace("CARDROWS", ", ".join(f"('{k}', {w}::DOUBLE)" for k, w in C.weights.items()))
CTE["os_dev"] = """SELECT *, abs(x - md) AS d FROM (SELECT *, median(x) OVER (PARTITION BY entity_type, metric, grp) AS md FROM (SELECT entity_type, metric, unnest([nat, everyone]) grp, x FROM os_base) WHERE x IS NOT NULL)"""
CTE["os_scale"] = """SELECT entity_type, metric, grp, any_value(md) AS md, CASE WHEN median(d) > 0 THEN 1.4826 * median(d) WHEN avg(d) > 0 THEN 1.2533 * avg(d) END AS den FROM os_dev GROUP BY 1, 2, 3"""
CTE["os_slope"] = f"""SELECT entity_type, entity_id, metric, median(s) AS slope FROM (SELECT a.entity_type, a.entity_id, a.metric, (b."value" - a."value") / (date_diff('day', a.period_start, b.period_start) / 7.0) AS s FROM os_values a JOIN os_values b ON a.entity_type = b.entity_type AND a.entity_id = b.entity_id AND a.metric = b.metric AND b.period_start > a.period_start WHERE a.period = 'week' AND b.period = 'week') WHERE s IS NOT NULL GROUP BY 1, 2, 3"""
CTE["os_points"] = """SELECT entity_type, entity_id, metric, count("value") AS k FROM os_values WHERE period = 'week' GROUP BY 1, 2, 3"""
CTE["os_z"] = """SELECT b.*, s.md, s.den, CASE WHEN p.k >= 6 THEN t.slope END AS slope, CASE WHEN x IS NULL THEN NULL WHEN s.den IS NULL THEN 0.0 ELSE (x - s.md) / s.den END AS z FROM os_base b LEFT JOIN os_scale s ON s.entity_type = b.entity_type AND s.metric = b.metric AND s.grp = b.peers
 LEFT JOIN os_slope t ON t.entity_type = b.entity_type AND t.entity_id = b.entity_id AND t.metric = b.metric LEFT JOIN os_points p ON p.entity_type = b.entity_type AND p.entity_id = b.entity_id AND p.metric = b.metric"""
CTE["os_rank"] = f"""SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY round(composite, 9) DESC NULLS LAST, entity_id) AS rk FROM (SELECT entity_type, entity_id, coalesce(sum(w) FILTER (WHERE z IS NOT NULL) / sum(w) >= {C.least_coverage}, false) AS ok,
 CASE WHEN sum(w) FILTER (WHERE z IS NOT NULL) / sum(w) >= {C.least_coverage} THEN sum(w * (greatest(-5, least(5, z)) + {C.trend_weight} * coalesce(CASE WHEN slope * 12 / den IS NOT NULL THEN greatest(-5, least(5, slope * 12 / den)) END, 0))) FILTER (WHERE z IS NOT NULL) / sum(w) FILTER (WHERE z IS NOT NULL) END AS composite FROM os_z GROUP BY 1, 2)"""
CTE["os_score"] = """SELECT z.entity_type, z.entity_id, z.metric, x AS "value", peers AS peer_group, md AS peer_median, z AS z_score, slope AS trend_slope, coalesce(sample_size, 0) AS sample_size, composite, rk AS "rank",
 array_to_string(list_filter([CASE WHEN few THEN 'insufficient_sample' END, CASE WHEN NOT ok THEN 'low_coverage' END, CASE WHEN sample_size IS NULL THEN 'no_data' END, CASE WHEN slope IS NULL THEN 'no_trend' END, CASE WHEN peers <> nat THEN 'peer_fallback' END], lambda f: f IS NOT NULL), ',') AS flags FROM os_z z JOIN os_rank r ON r.entity_type = z.entity_type AND r.entity_id = z.entity_id"""
_recent = lambda c: f"{c} >= {_NOW} - INTERVAL 12 MONTH AND {c} < {_NOW}"
CTE["os_targets"] = f"""SELECT * FROM (SELECT s.entity_type, s.entity_id, s.metric, s."value" x, s.peer_group, unnest(['peer_median', 'top_quartile']) kind, unnest([s.peer_median, q.q25]) t FROM os_score s JOIN (SELECT entity_type, peer_group, metric, quantile_cont("value", 0.25) q25 FROM os_score GROUP BY 1, 2, 3) q ON q.entity_type = s.entity_type AND q.peer_group = s.peer_group AND q.metric = s.metric WHERE s."rank" <= {C.top_entities} AND s.z_score > 0 AND s."value" IS NOT NULL) WHERE t < x"""
CTE["os_inc12"] = f"SELECT team_id, org_id, downtime_usd, toil_usd, total_usd FROM fact_incident WHERE NOT excluded AND {_recent('opened_at')}"
CTE["os_chg12"] = f"SELECT team_id, org_id, record_id, deployed, failed FROM fact_change WHERE {_recent('actual_end')}"
CTE["os_evt12"] = f"SELECT team_id, org_id FROM os_noise WHERE {_recent('ts')}"
CTE["os_lever"] = f"""SELECT entity_type, entity_id, metric, kind AS target_kind, x AS current_value, t AS target_value, round(delta, 2) AS delta_usd FROM (SELECT g.*, CASE g.metric WHEN 'mttr_hours' THEN CASE WHEN x <> 0 THEN (coalesce(i.dn, 0) + coalesce(i.tl, 0)) * (x - t) / x END WHEN 'repeat_incident_rate' THEN i.n * (x - t) * (i.tt / i.n) WHEN 'reopen_rate' THEN i.n * (x - t) * (i.tl / i.n) * {C.reopen_factor}
  WHEN 'reassignment_rate' THEN i.n * (x - t) * {C.reassign_hours} * {R.engineer_hour} WHEN 'sla_breach_rate' THEN i.n * (x - t) * {C.sla_penalty} WHEN 'change_failure_rate' THEN c.d * (x - t) * ({R.backout_hours * R.engineer_hour!r} + CASE WHEN c.f > 0 THEN coalesce(k.cc, 0) / c.f ELSE 0 END) WHEN 'alert_noise_ratio' THEN e.n * (x - t) * {R.triage_minutes / 60 * R.engineer_hour!r} END AS delta
 FROM os_targets g LEFT JOIN (SELECT entity_type, entity_id, count(*) n, CAST(sum(downtime_usd) AS DOUBLE) dn, CAST(sum(toil_usd) AS DOUBLE) tl, CAST(sum(total_usd) AS DOUBLE) tt FROM ({_each('os_inc12')}) GROUP BY 1, 2) i ON i.entity_type = g.entity_type AND i.entity_id = g.entity_id
 LEFT JOIN (SELECT entity_type, entity_id, count(*) FILTER (WHERE deployed) d, count(*) FILTER (WHERE failed) f FROM ({_each('os_chg12')}) GROUP BY 1, 2) c ON c.entity_type = g.entity_type AND c.entity_id = g.entity_id
 LEFT JOIN (SELECT entity_type, entity_id, CAST(sum(total_usd) AS DOUBLE) cc FROM (SELECT DISTINCT y.entity_type, y.entity_id, f.record_id, f.total_usd FROM ({_each('os_chg12')}) y JOIN cause_pairs p ON p.change_id = y.record_id JOIN fact_incident f ON f.record_id = p.incident_id WHERE y.failed AND NOT f.excluded AND f.opened_at < {_NOW}) GROUP BY 1, 2) k ON k.entity_type = g.entity_type AND k.entity_id = g.entity_id
 LEFT JOIN (SELECT entity_type, entity_id, count(*) n FROM ({_each('os_evt12')}) GROUP BY 1, 2) e ON e.entity_type = g.entity_type AND e.entity_id = g.entity_id) WHERE round(delta, 2) > 0"""
