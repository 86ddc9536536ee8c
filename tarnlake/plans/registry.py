"""Named queries over the driver's tables, each with the SQL that checks it."""

from __future__ import annotations

from tarnlake.plans import enrichment, metrics, relational, scoring, model, canonical_metrics, stages, more  # noqa: F401  modules that add their queries
from tarnlake.plans.adapter import FACTS_SQL, Tables, fact
from tarnlake.streaming import queries as _stream  # noqa: F401

FLAGSHIP = "m03_mttr_hours"
#: Entity and period of each metric's query.
GRAIN = {"event_fact": ("service_id", "week"), "daily_fact": ("service_id", "month")}


def _metric(name: str):
    m = metrics.CATALOGUE[name]
    entity, unit = GRAIN.get(m.fact, ("team_id", "month"))
    return (lambda spark, sf_dir: metrics.compute(fact(Tables(spark, sf_dir), m.fact), m, entity, unit)), metrics.sql(FACTS_SQL[m.fact], m, entity, unit)


def queries() -> dict:
    return {n: _metric(n)[0] for n in metrics.CATALOGUE} | relational.QUERIES


def oracle_sql() -> dict[str, str]:
    return {n: _metric(n)[1] for n in metrics.CATALOGUE} | relational.SQL
