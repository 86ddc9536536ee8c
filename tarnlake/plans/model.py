"""Queries of the staged and canonical tables and of the checks on them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.plans import checks, facts, funding, funding_sql, model_sql, orgscore, orgscore_sql, portfolio, staging  # noqa: F401  the SQL modules add their tables
from tarnlake.plans.adapter import Tables
from tarnlake.plans.canonical import Model
from tarnlake.plans.relational import QUERIES, SQL, query

LISTS = ("components", "labels")


def _flat(df: DataFrame) -> DataFrame:
    """Lists as text, so that rows can be compared."""
    return df.select(*[F.array_join(c, "|").alias(c) if c in LISTS else c for c in df.columns])


def _register(kind: str, name: str) -> None:
    key, table = f"{kind}_{name}", f"{kind}_{name}"
    replaced = ", ".join(f"array_to_string({c}, '|') AS {c}" for c in LISTS) if name in ("issue", "work_item") and kind != "fact" else ""
    select = f"SELECT *{f' REPLACE ({replaced})' if replaced else ''} FROM {table}"
    QUERIES[key] = lambda spark, sf_dir: _flat(getattr(Model.of(Tables(spark, sf_dir)), kind)(name))
    SQL[key] = model_sql.with_tables(select)


for _name in (*staging.BUILDERS, "transition", "link"):
    _register("stg", _name)
for _name in ("org", "team", "service", "service_map", "name_lookup", "incident", "change", "problem", "event", "metric_daily", "build_counts", "work_item", "work_item_transition", "work_item_link", "work_item_closure"):
    _register("core", _name)

for _name in facts.FACTS:
    _register("fact", _name)


_TYPED = {"incident": "opened_at resolved_at closed_at acknowledged_at priority state reassignment_count reopen_count made_sla business_duration_s customer_impact_minutes", "change_request": "type opened_at planned_start planned_end actual_start actual_end outcome", "metric_daily": "date value"}


@query(model_sql.with_tables(" UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) n_rows, count(*) FILTER (WHERE _nn_{c}) n_present, count(*) FILTER (WHERE _cf_{c}) n_failed FROM stg_{t}" for t, cs in _TYPED.items() for c in cs.split())))
def staging_cast_statistics(t: Tables) -> DataFrame:
    m = Model.of(t)
    return staging.cast_statistics({n: m.stg(n) for n in _TYPED})


# -- funding --------------------------------------------------------------------------
@query(model_sql.with_tables("SELECT candidate_id, kind AS record_kind, record_id, tier, round(w, 9) AS weight, round(share, 9) AS share, round(pain, 3) AS pain, round(q, 9) AS quality FROM fa_shares"))
def funding_attribution(t: Tables) -> DataFrame:
    return shares_of(Model.of(t)).select(*funding.RECORD, "candidate_id", "tier", F.round("weight", 9).alias("weight"), F.round("share", 9).alias("share"), F.round("pain", 3).alias("pain"), F.round("quality", 9).alias("quality"))


def parts_of(m: Model) -> funding.Parts:
    return m.kept("score_parts", lambda: funding.attribution(m))


def shares_of(m: Model) -> DataFrame:
    """The attribution's rows, made from its parts where they are read."""
    return parts_of(m).rows()


def funding_of(m: Model) -> DataFrame:
    return m.kept("score_funding", lambda: funding.score(m, parts_of(m)))


_NINE = ", ".join(f"round({c}, 6) AS {c}" for c in ("confidence", "priority", "wsjf"))


@query(model_sql.with_tables(f"SELECT candidate_id, candidate_type, title, annual_pain_usd, addressable_pain_usd, expected_reduction, n_incidents, strategic_weight, effort_cost_usd, flags, {_NINE} FROM fs_score"))
def funding_score(t: Tables) -> DataFrame:
    columns = ["candidate_id", "candidate_type", "title", "annual_pain_usd", "addressable_pain_usd", "expected_reduction", "n_incidents", "strategic_weight", "effort_cost_usd", "flags"]
    return funding_of(Model.of(t)).select(*columns, *[F.round(c, 6).alias(c) for c in ("confidence", "priority", "wsjf")])


# -- portfolio ------------------------------------------------------------------------
_LINKS = """(SELECT from_key, to_key FROM core_work_item_link WHERE lower(link_type) = 'blocks')"""


_OPEN = "SELECT record_id, \"key\", story_points FROM core_work_item WHERE status_category <> 'done'"


@query(model_sql.with_tables(f"""SELECT c.candidate_id, c.candidate_type, CASE WHEN c.candidate_type = 'cluster_fix' THEN f.owner ELSE w.team_id END AS team_id, c.effort_cost_usd, round(c.priority, 6) AS priority, round(CAST(CAST(CAST(c.addressable_pain_usd AS DOUBLE) * c.confidence * c.strategic_weight AS DECIMAL(18,2)) AS DOUBLE), 0) AS expected_impact_usd,
 CASE WHEN c.candidate_type = 'cluster_fix' THEN {funding.SETTINGS.fix_effort_hours / funding.SETTINGS.hours_per_point!r}::DOUBLE ELSE p.points END AS points, coalesce(d.below, '') AS descendants, coalesce(b.ids, '') AS blockers, coalesce(o.n, 0) AS noncandidate_blockers
 FROM fs_score c LEFT JOIN core_work_item w ON w.record_id = c.candidate_id
 LEFT JOIN (SELECT x.ancestor_record_id AS id, sum(i.story_points) AS points FROM core_work_item_closure x JOIN ({_OPEN}) i ON i.record_id = x.record_id GROUP BY 1) p ON p.id = c.candidate_id
 LEFT JOIN (SELECT above, string_agg(DISTINCT below, '|' ORDER BY below) AS below FROM fa_desc GROUP BY 1) d ON d.above = c.candidate_id
 LEFT JOIN (SELECT l.to_key, string_agg(DISTINCT k.record_id, '|' ORDER BY k.record_id) AS ids FROM {_LINKS} l JOIN fa_cand k ON k."key" = l.from_key GROUP BY 1) b ON b.to_key = w."key"
 LEFT JOIN (SELECT l.to_key, count(DISTINCT k.record_id) AS n FROM {_LINKS} l JOIN ({_OPEN}) k ON k."key" = l.from_key ANTI JOIN fs_score s ON s.candidate_id = k.record_id GROUP BY 1) o ON o.to_key = w."key"
 LEFT JOIN (SELECT y.candidate_id, o.owner FROM (SELECT DISTINCT ON (candidate_id) candidate_id, service_id FROM (SELECT 'cluster_fix:' || cluster_id candidate_id, service_id, count(*) n FROM fact_incident WHERE NOT excluded AND service_id IS NOT NULL GROUP BY 1, 2) ORDER BY candidate_id, n DESC, service_id) y LEFT JOIN os_owner o USING (service_id)) f ON f.candidate_id = c.candidate_id"""))
def portfolio_input(t: Tables) -> DataFrame:
    x = _portfolio_input(Model.of(t))
    return x.select("candidate_id", "candidate_type", "team_id", "effort_cost_usd", F.round("priority", 6).alias("priority"), F.round(F.col("expected_impact_usd").cast("double"), 0).alias("expected_impact_usd"), "points", F.array_join("descendants", "|").alias("descendants"), F.array_join("blockers", "|").alias("blockers"), "noncandidate_blockers")


def _portfolio_input(m: Model) -> DataFrame:
    return m.kept("score_portfolio_input", lambda: portfolio.portfolio_input(m, funding_of(m)))


def portfolio_of(m: Model) -> DataFrame:
    limits = portfolio.Limits(budget=60_000.0, capacity={}, default_capacity=25.0, quarters=2)
    return m.kept("score_portfolio", lambda: portfolio.scenario(_portfolio_input(m), "base", limits))


QUERIES["portfolio"] = lambda spark, sf_dir: portfolio_of(Model.of(Tables(spark, sf_dir)))


# -- teams and organisations ----------------------------------------------------------
def metrics_of(m: Model) -> DataFrame:
    return m.kept("score_metrics", lambda: orgscore.metric_values(m))


def orgs_of(m: Model) -> DataFrame:
    return m.kept("score_org", lambda: orgscore.org_score(m, metrics_of(m)))


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


@query(model_sql.with_tables("SELECT * REPLACE (round(\"value\", 6) AS \"value\", round(numerator, 6) AS numerator) FROM os_values"))
def metric_values(t: Tables) -> DataFrame:
    return _rounded(metrics_of(Model.of(t)), "value", "numerator")


_OS = ("value", "peer_median", "z_score", "trend_slope", "composite")


@query(model_sql.with_tables("SELECT * REPLACE (" + ", ".join(f'round("{c}", 6) AS "{c}"' for c in _OS) + ") FROM os_score"))
def org_score(t: Tables) -> DataFrame:
    return _rounded(orgs_of(Model.of(t)), *_OS)


def levers_of(m: Model) -> DataFrame:
    return m.kept("score_lever", lambda: orgscore.levers(m, orgs_of(m)))


def causes_of(m: Model) -> DataFrame:
    return facts.causes(m)


@query(model_sql.with_tables("SELECT entity_type, entity_id, metric, target_kind, round(current_value, 6) AS current_value, round(target_value, 6) AS target_value, round(delta_usd, 0) AS delta_usd FROM os_lever"))
def levers(t: Tables) -> DataFrame:
    x = levers_of(Model.of(t)).drop("template_params")
    return _rounded(x, "current_value", "target_value").withColumn("delta_usd", F.round("delta_usd", 0))


@query(model_sql.with_tables("SELECT true AS entity_found, CASE WHEN n < 5 THEN e.everyone ELSE o.nat END AS key, n < 5 AS fallback, e.entity_id AS member_id FROM os_entities e, (SELECT nat, (SELECT count(*) FROM os_entities x WHERE x.nat = y.nat) n FROM os_entities y WHERE entity_type = 'team' AND entity_id = 'servicenow:sys_user_group:g4') o WHERE e.entity_type = 'team' AND (n < 5 OR e.nat = o.nat)"))
def peer_groups(t: Tables) -> DataFrame:
    return orgscore.peer_group(Model.of(t), "team", "servicenow:sys_user_group:g4")


# -- checks ---------------------------------------------------------------------------
_PREVIOUS, _STARTED = {"org": 9, "incident": 100, "problem": 10**6}, "2001-03-01 00:00:00"


def _check_sql() -> str:
    c = checks
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.0 END"
    out = []
    for t in c.COUNTED:
        p = _PREVIOUS.get(t, 0)
        out.append(f"SELECT 'row_count_drop:core.{t}' AS check_name, 'error' AS severity, {share(f'({p} - count(*))', str(p))} AS v, {c.MOST_DROP} AS th FROM core_{t}")
    out += [f"SELECT 'future_timestamp:core.{t}.{x}', 'warn', CAST(count(*) FILTER (WHERE {x} > TIMESTAMP '{_STARTED}') AS DOUBLE), {c.MOST_FUTURE} FROM core_{t}" for t, xs in c.FUTURE.items() for x in xs]
    out += [f"SELECT 'duplicate_key:core.{t}', 'error', CAST(count(*) - count(DISTINCT {'(' + ', '.join(f'{chr(34)}{k}{chr(34)}' for k in ks) + ')' if len(ks) > 1 else ks[0]}) AS DOUBLE), {c.MOST_DUPLICATES} FROM core_{t}" for t, ks in c.KEYS.items()]
    nulls = share("count(*) FILTER (WHERE service_id IS NULL)", "count(*)")
    out.append(f"SELECT 'incident_service_null', CASE WHEN v > {c.NULL_ERROR} THEN 'error' ELSE 'warn' END, v, CASE WHEN v > {c.NULL_ERROR} THEN {c.NULL_ERROR} ELSE {c.NULL_WARN} END FROM (SELECT {nulls} v FROM core_incident)")
    out.append(f"SELECT 'work_item_service_null', 'warn', {nulls}, {c.ITEM_NULL_WARN} FROM core_work_item")
    out.append(f"SELECT 'resolved_before_opened', 'warn', {share('count(*) FILTER (WHERE resolved_at < opened_at)', 'count(*)')}, {c.BEFORE_WARN} FROM core_incident WHERE resolved_at IS NOT NULL AND opened_at IS NOT NULL")
    typed = _TYPED | {"problem": "opened_at resolved_at known_error", "ci": "criticality", "group": "active", "task_sla": "has_breached", "issue": "type status_category created_at resolved_at story_points estimate_cost_usd", "event": "ts end_ts severity"}
    out += [f"SELECT 'cast_fail:stg.{t}.{x}', 'warn', {share(f'count(*) FILTER (WHERE _cf_{x})', f'count(*) FILTER (WHERE _nn_{x})')}, {c.CAST_WARN} FROM stg_{t} HAVING count(*) FILTER (WHERE _nn_{x}) > 0" for t, xs in typed.items() for x in xs.split()]
    out.append(f"""SELECT 'metric_daily_unmapped_service', 'warn', {share("sum(\"value\") FILTER (WHERE name = 'metric_daily_unmapped')", "sum(\"value\") FILTER (WHERE name = 'metric_daily_raw')")}, {c.UNMAPPED_WARN} FROM core_build_counts""")
    body = " UNION ALL ".join(out)
    cover = f"SELECT 'decision_coverage_incident', 'warn', {share('count(*) FILTER (WHERE record_id IN (SELECT record_id FROM cluster_member))', 'count(*)')}, {c.LEAST_COVERED} FROM core_incident"
    return model_sql.with_tables(f"SELECT check_name, severity, round(v, 9) AS \"value\", CAST(th AS DOUBLE) AS threshold, v <= th AS passed FROM ({body}) UNION ALL SELECT check_name, severity, round(v, 9), CAST(th AS DOUBLE), v >= th FROM ({cover}) q(check_name, severity, v, th)")


@query(_check_sql())
def quality_checks(t: Tables) -> DataFrame:
    return build_checks_of(Model.of(t)).withColumn("value", F.round("value", 9))


def build_checks_of(m: Model) -> DataFrame:
    return checks.build_checks(m, _PREVIOUS, _STARTED)


_NAMES = "fact_duration_negative:incident fact_duration_negative:change fact_duration_negative:work_item metric_ratio_range metric_pct_range metric_negative metric_count_integral share_sum share_range pain_total confidence_range funding_rank_unique org_z_finite portfolio_budget portfolio_parent_child portfolio_blockers".split()


@query(model_sql.with_tables("SELECT unnest([" + ", ".join(f"'{n}'" for n in _NAMES) + "]) AS check_name, CAST(0 AS BIGINT) AS n_bad UNION ALL SELECT 'work_item_cycle', count(*) FROM core_work_item_closure WHERE depth = 10"))
def invariants(t: Tables) -> DataFrame:
    m = Model.of(t)
    usd = funding.record_costs(m).select(*funding.RECORD, "usd")
    return checks.invariants(m, shares_of(m), funding_of(m), metrics_of(m), orgs_of(m), portfolio_of(m), usd, ("incident_count",))
