"""Attribution and funding score as SQL (DuckDB), for checks: every path is listed, nothing is cut short."""

from __future__ import annotations

from tarnlake.plans.facts import RULES as R
from tarnlake.plans.facts import _case
from tarnlake.plans.funding import SETTINGS as S
from tarnlake.plans.model_sql import CTE

_NOW = f"TIMESTAMP '{S.as_of} 00:00:00'"


def window(c: str) -> str:
    return f"{c} >= {_NOW} - INTERVAL {S.window_days} DAY AND {c} < {_NOW}"


CTE["fa_cand"] = """SELECT * FROM core_work_item WHERE "type" IN ('initiative', 'epic', 'feature') AND status_category IN ('todo', 'in_progress')"""
CTE["fa_serv"] = """SELECT candidate_id, service_id, max(confidence) AS confidence FROM (SELECT record_id candidate_id, service_id, 1.0::DOUBLE confidence FROM fa_cand WHERE service_id IS NOT NULL
 UNION ALL SELECT c.record_id, p.service_id, p.confidence FROM fa_cand c, core_service_map p WHERE p.jira_project = c.project AND p.service_id IS NOT NULL AND (p.jira_component IS NULL OR list_contains(coalesce(c.components, []), p.jira_component))) GROUP BY 1, 2"""
CTE["fa_desc"] = """SELECT DISTINCT ancestor_record_id AS above, record_id AS below FROM core_work_item_closure WHERE depth > 0 AND record_id IN (SELECT record_id FROM fa_cand) AND ancestor_record_id IN (SELECT record_id FROM fa_cand)"""
CTE["fa_inc"] = f"""SELECT record_id, number, service_id, cluster_id, membership_prob mp, CAST(total_usd AS DOUBLE) usd FROM fact_incident WHERE NOT excluded AND {window('opened_at')}"""
CTE["fa_cost"] = f"""SELECT 'incident' kind, record_id, service_id, usd FROM fa_inc UNION ALL SELECT 'event', event_id, service_id, {R.triage_minutes / 60.0 * R.engineer_hour!r}::DOUBLE FROM core_event WHERE {window('ts')} AND severity IN ('info', 'warning') AND incident_id IS NULL
 UNION ALL SELECT 'change', f.record_id, f.service_id, {R.backout_hours * R.engineer_hour!r}::DOUBLE FROM fact_change f JOIN core_change c USING (record_id) WHERE f.failed AND c.outcome IN ('failed', 'rolled_back') AND {window('f.actual_end')}"""
CTE["fa_direct"] = """SELECT DISTINCT x.candidate_record_id AS candidate_id, 'incident' AS kind, i.record_id, 1 AS tier, 1.0::DOUBLE AS w, 1.0::DOUBLE AS q FROM (SELECT from_key a, to_key b FROM core_work_item_link WHERE link_type = 'mentions_incident' UNION SELECT to_key, from_key FROM core_work_item_link WHERE link_type = 'mentions_incident') s
 JOIN fa_inc i ON i.number = s.b JOIN core_work_item v ON v."key" = s.a JOIN core_work_item_closure x ON x.record_id = v.record_id AND x.ancestor_record_id = v.record_id WHERE x.candidate_record_id IS NOT NULL"""
CTE["fa_wide"] = f"""SELECT d.candidate_id, i.cluster_id FROM fa_direct d JOIN fa_inc i USING (record_id) WHERE i.cluster_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT record_id) >= {S.least_direct_links}"""
CTE["fa_cause"] = """SELECT DISTINCT ON (record_id) record_id AS candidate_id, answer, probability FROM decision WHERE question = 'root_cause' AND record_id IN (SELECT record_id FROM fa_cand) ORDER BY record_id, decided_at DESC NULLS LAST, probability DESC NULLS LAST, decider"""
CTE["fa_paths"] = f"""SELECT * FROM fa_direct
 UNION ALL SELECT k.candidate_id, 'incident', i.record_id, 2, {S.root_cause_weight} * (i.mp * k.probability), i.mp * k.probability FROM fa_inc i JOIN cluster c USING (cluster_id) JOIN fa_cause k ON k.answer = c.root_cause_category WHERE EXISTS (SELECT 1 FROM cluster_service cs JOIN fa_serv v USING (service_id) WHERE cs.cluster_id = i.cluster_id AND v.candidate_id = k.candidate_id)
 UNION ALL SELECT v.candidate_id, r.kind, r.record_id, 3, {S.service_weight} * v.confidence, 0.5 * v.confidence FROM fa_cost r JOIN fa_serv v USING (service_id)
 UNION ALL SELECT l.candidate_id, 'incident', i.record_id, 2, {S.cluster_weight} * i.mp, i.mp FROM fa_wide l JOIN fa_inc i USING (cluster_id)"""


def _shares(paths: str) -> str:
    return f"""SELECT a.candidate_id, a.kind, a.record_id, a.tier, a.w, a.q, a.w / sum(a.w) OVER (PARTITION BY a.kind, a.record_id) AS share, a.w / sum(a.w) OVER (PARTITION BY a.kind, a.record_id) * r.usd AS pain
 FROM (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY kind, record_id) lowest FROM (SELECT *, row_number() OVER (PARTITION BY kind, record_id, candidate_id ORDER BY tier, w DESC, q DESC) n FROM ({paths}) WHERE w > 0) WHERE n = 1) WHERE tier = lowest) a JOIN fa_cost r ON r.kind = a.kind AND r.record_id = a.record_id
 WHERE NOT EXISTS (SELECT 1 FROM fa_desc d JOIN (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY kind, record_id) lowest FROM ({paths}) WHERE w > 0) WHERE tier = lowest) o ON o.candidate_id = d.below WHERE d.above = a.candidate_id AND o.kind = a.kind AND o.record_id = a.record_id)"""


CTE["fa_first"] = _shares("SELECT * FROM fa_paths")
CTE["fa_days"] = f"SELECT greatest(1, least({S.window_days}, date_diff('day', CAST(min(opened_at) AS DATE), DATE '{S.as_of}'))) AS d FROM fact_incident WHERE NOT excluded"
CTE["fa_worth"] = f"""SELECT cluster_id FROM (SELECT cluster_id, count(*) n, sum(usd) pain FROM fa_inc WHERE cluster_id IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT cluster_id, sum(f.pain) linked FROM fa_first f JOIN fa_inc USING (record_id) WHERE kind = 'incident' AND tier <= 2 GROUP BY 1) USING (cluster_id)
 WHERE n >= {S.fix_incidents} AND pain * 365 / (SELECT d FROM fa_days) >= {S.fix_annual_pain} AND CASE WHEN pain = 0 THEN 0 ELSE coalesce(linked, 0) / pain END < {S.fix_most_linked}"""
CTE["fa_all_paths"] = f"SELECT * FROM fa_paths UNION ALL SELECT 'cluster_fix:' || cluster_id, 'incident', record_id, 2, {S.cluster_weight} * mp, mp FROM fa_inc WHERE cluster_id IN (SELECT cluster_id FROM fa_worth)"
CTE["fa_shares"] = _shares("SELECT * FROM fa_all_paths")

# -- score ------------------------------------------------------------------------------
CTE["fs_cand"] = f"""SELECT record_id candidate_id, "type" candidate_type, "key" k, project, service_id, team_id, estimate_cost_usd est FROM fa_cand UNION ALL SELECT candidate_id, 'cluster_fix', NULL, NULL, o.service_id, NULL, NULL FROM (SELECT DISTINCT candidate_id FROM fa_shares WHERE starts_with(candidate_id, 'cluster_fix:'))
 LEFT JOIN (SELECT DISTINCT ON (candidate_id) candidate_id, service_id FROM (SELECT 'cluster_fix:' || cluster_id candidate_id, service_id, count(*) n FROM fact_incident WHERE NOT excluded AND service_id IS NOT NULL AND {window('opened_at')} GROUP BY 1, 2) ORDER BY candidate_id, n DESC, service_id) o USING (candidate_id)"""
CTE["fs_rows"] = """SELECT f.k, s.kind, s.record_id, s.share, CAST(s.pain AS DECIMAL(18,2)) pain, s.q FROM fa_shares s JOIN (SELECT candidate_id k, candidate_id m FROM fs_cand UNION ALL SELECT above, below FROM fa_desc) f ON f.m = s.candidate_id"""
CTE["fs_week"] = f"""SELECT k, t, sum(CAST(pain AS DOUBLE)) v FROM (SELECT r.*, CAST(date_diff('day', date_trunc('week', {_NOW}), date_trunc('week', x.ts)) / 7 + 12 AS INTEGER) t FROM fs_rows r JOIN (SELECT 'incident' kind, record_id, opened_at ts FROM fact_incident UNION ALL SELECT 'event', event_id, ts FROM core_event UNION ALL SELECT 'change', record_id, actual_end FROM fact_change) x ON x.kind = r.kind AND x.record_id = r.record_id) WHERE t BETWEEN 0 AND 11 GROUP BY 1, 2"""
CTE["fs_dense"] = "SELECT candidate_id k, t, coalesce(v, 0) v FROM fs_cand CROSS JOIN (SELECT unnest(range(12)) t) LEFT JOIN fs_week y ON y.k = candidate_id AND y.t = t".replace("AND y.t = t", "AND y.t = g.t").replace("range(12)) t)", "range(12)) t) g").replace("candidate_id k, t,", "candidate_id k, g.t,")
_org = _case("1", {}, 1.0)
_pick = lambda key, table: "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1.0 END"
CTE["fs_base"] = f"""SELECT c.candidate_id, c.candidate_type, CASE WHEN c.candidate_type = 'cluster_fix' THEN c.candidate_id ELSE c.k END AS title, CAST(coalesce(g.pd, 0) * 365 / (SELECT d FROM fa_days) AS DECIMAL(18,2)) AS annual, CASE c.candidate_type WHEN 'epic' THEN 0.5123 WHEN 'feature' THEN 0.3117 WHEN 'initiative' THEN 0.6131 ELSE 0.7177 END::DOUBLE AS er,
 CAST(round(coalesce(g.ns, 0)) AS BIGINT) AS n, CASE WHEN coalesce(g.p, 0) = 0 THEN 0 ELSE g.pq / g.p END AS c_map, CAST(least({S.clip[1]}, greatest({S.clip[0]}, {_pick('coalesce(pf.key, c.project)', S.portfolio_weight)} * {_pick('coalesce(tm.org_id, sv.org_id)', S.org_weight)})) AS DOUBLE) AS sw,
 CAST(coalesce(CAST(c.est AS DOUBLE), pt.pts * {R.engineer_hour} * {S.hours_per_point}, CASE WHEN c.candidate_type = 'cluster_fix' THEN {S.fix_effort_hours * R.engineer_hour!r} END) AS DECIMAL(18,2)) AS effort,
 (SELECT count(DISTINCT b.candidate_id) FROM core_work_item_link l JOIN fs_cand b ON b.k = l.to_key WHERE lower(l.link_type) = 'blocks' AND l.from_key = c.k) + 5 - coalesce((SELECT min(criticality) FROM core_service WHERE service_id IN (SELECT service_id FROM fa_serv z WHERE z.candidate_id = c.candidate_id UNION SELECT c.service_id)), 5) AS rr_in,
 (SELECT median((b.v - a.v) / (b.t - a.t)) FROM fs_dense a JOIN fs_dense b ON a.k = b.k AND b.t > a.t WHERE a.k = c.candidate_id) AS tc_in,
 EXISTS (SELECT 1 FROM fs_rows r JOIN fact_incident i USING (record_id) WHERE r.k = c.candidate_id AND r.kind = 'incident' AND i.priority = 1 AND i.opened_at >= {_NOW} - INTERVAL 30 DAY AND i.opened_at < {_NOW}) AS hot
 FROM fs_cand c LEFT JOIN (SELECT k, sum(pain) pd, sum(CAST(pain AS DOUBLE)) p, sum(CAST(pain AS DOUBLE) * q) pq, sum(share) FILTER (WHERE kind = 'incident') ns FROM fs_rows GROUP BY 1) g ON g.k = c.candidate_id
 LEFT JOIN (SELECT x.record_id, arg_max(i."key", x.depth) "key" FROM core_work_item_closure x JOIN core_work_item i ON i.record_id = x.ancestor_record_id WHERE i."type" = 'initiative' GROUP BY 1) pf ON pf.record_id = c.candidate_id
 LEFT JOIN (SELECT x.ancestor_record_id a, sum(i.story_points) pts FROM core_work_item_closure x JOIN core_work_item i ON i.record_id = x.record_id WHERE i.status_category <> 'done' GROUP BY 1) pt ON pt.a = c.candidate_id LEFT JOIN core_team tm ON tm.team_id = c.team_id LEFT JOIN core_service sv ON sv.service_id = c.service_id"""
_rank = lambda x: f"CASE WHEN {x} IS NOT NULL THEN percent_rank() OVER (PARTITION BY {x} IS NULL ORDER BY {x}) END"
_fib = lambda x: f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0.15 THEN 1 WHEN {x} <= 0.30 THEN 2 WHEN {x} <= 0.45 THEN 3 WHEN {x} <= 0.60 THEN 5 WHEN {x} <= 0.75 THEN 8 WHEN {x} <= 0.90 THEN 13 ELSE 20 END"
CTE["fs_score"] = f"""SELECT candidate_id, candidate_type, title, annual AS annual_pain_usd, addressable AS addressable_pain_usd, er AS expected_reduction, n AS n_incidents, conf AS confidence, sw AS strategic_weight, effort AS effort_cost_usd, prio AS priority,
 CAST({_fib('r1')} + CASE WHEN hot THEN CASE {_fib('r2')} WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 5 THEN 8 WHEN 8 THEN 13 ELSE 20 END ELSE {_fib('r2')} END + {_fib('r3')} AS DOUBLE) / {_fib('r4')} AS wsjf, CASE WHEN effort IS NULL THEN 'no_estimate' ELSE '' END AS flags
 FROM (SELECT *, {_rank('addressable_d * sw')} r1, {_rank('tc_in')} r2, {_rank('rr_in')} r3, {_rank('effort')} r4 FROM (SELECT *, CAST(addressable AS DOUBLE) addressable_d, CASE WHEN effort > 0 THEN CAST(addressable AS DOUBLE) * conf * sw / CAST(effort AS DOUBLE) END AS prio FROM
 (SELECT *, CAST(CAST(annual AS DOUBLE) * er AS DECIMAL(18,2)) AS addressable, greatest(0.05, least(1.0, c_map * least(1, sqrt(n / 30.0)) * least(1, (SELECT d FROM fa_days) / 365.0))) AS conf FROM fs_base)))"""
