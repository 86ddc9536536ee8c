"""Every invariant fires on rows that break it, and on no others."""

import pytest

from tarnlake.plans import canonical, checks
from tarnlake.plans.adapter import Tables

GOOD = {
    "incident": [(1.0, 1.0, 1.0, 1.0)],
    "change": [(2.0,)],
    "work": [(3.0,)],
    "metrics": [("incident_count", "count", 4.0, 4.0, 1.0, 4), ("rate", "ratio", 0.5, 1.0, 2.0, 2), ("share", "pct", 99.0, 1.0, 2.0, 2)],
    "shares": [("incident", "i1", "a", 0.5), ("incident", "i1", "b", 0.5)],
    "usd": [("incident", "i1", 100.0)],
    "scores": [("a", 0.5, 1, 10.0), ("b", 0.9, 2, 10.0), ("c", 0.9, 3, 10.0)],
    "orgs": [(1.0, 1.0, None)],
    "portfolio": [("base", "a", True, 25.0), ("base", "b", True, 25.0), ("base", "c", False, 25.0)],
    "closure": [("a", "a", 0), ("x", "a", 1)],
    "items": [("a", "A", "todo"), ("b", "B", "todo"), ("c", "C", "todo")],
    "links": [("A", "B", "Blocks")],
}
SCHEMAS = {
    "incident": "resolve_h double, resolve_bh double, impact_h double, toil_h double",
    "change": "lead_time_h double",
    "work": "cycle_days double",
    "metrics": "metric string, unit string, value double, numerator double, denominator double, sample_size long",
    "shares": "record_kind string, record_id string, candidate_id string, share double",
    "usd": "record_kind string, record_id string, usd double",
    "scores": "candidate_id string, confidence double, rank long, effort_cost_usd double",
    "orgs": "z_score double, composite double, trend_slope double",
    "portfolio": "scenario string, candidate_id string, selected boolean, budget_usd double",
    "closure": "record_id string, ancestor_record_id string, depth int",
    "items": "record_id string, key string, status_category string",
    "links": "from_key string, to_key string, link_type string",
}
BROKEN = {
    "fact_duration_negative:incident": {"incident": [(1.0, 1.0, None, -1.0)]},
    "fact_duration_negative:change": {"change": [(-2.0,)]},
    "fact_duration_negative:work_item": {"work": [(-0.5,)]},
    "metric_ratio_range": {"metrics": [("rate", "ratio", 1.5, 1.0, 2.0, 2)]},
    "metric_pct_range": {"metrics": [("share", "pct", 101.0, 1.0, 2.0, 2)]},
    "metric_negative": {"metrics": [("hours", "h", 1.0, -1.0, 2.0, 2)]},
    "metric_count_integral": {"metrics": [("incident_count", "count", 4.5, 4.0, 1.0, 4)]},
    "share_sum": {"shares": [("incident", "i1", "a", 0.7), ("incident", "i1", "b", 0.7)]},
    "share_range": {"shares": [("incident", "i1", "a", 0.0), ("incident", "i2", "a", 1.0)]},
    "pain_total": {"shares": [("incident", "i1", "a", 1.2)]},
    "confidence_range": {"scores": [("a", 0.01, 1, 10.0), ("b", None, 2, 10.0)]},
    "funding_rank_unique": {"scores": [("a", 0.5, 1, 10.0), ("b", 0.9, 1, 10.0), ("c", 0.9, 3, 10.0)]},
    "org_z_finite": {"orgs": [(float("nan"), 1.0, None), (1.0, float("inf"), 1.0)]},
    "portfolio_budget": {"portfolio": [("base", "a", True, 15.0), ("base", "b", True, 15.0)]},
    "portfolio_parent_child": {"closure": [("b", "a", 1)]},
    "portfolio_blockers": {"links": [("C", "B", "blocks")]},
    "work_item_cycle": {"closure": [("a", "z", 10)]},
}


class Fixture:
    def __init__(self, spark, rows):
        self.t = {k: spark.createDataFrame(rows[k], SCHEMAS[k]) for k in SCHEMAS}

    def fact(self, name):
        return self.t[{"incident": "incident", "change": "change", "work_item": "work"}[name]]

    def core(self, name):
        return self.t[{"work_item": "items", "work_item_link": "links", "work_item_closure": "closure"}[name]]


def found(spark, rows):
    m = Fixture(spark, rows)
    out = checks.invariants(m, m.t["shares"], m.t["scores"], m.t["metrics"], m.t["orgs"], m.t["portfolio"], m.t["usd"], ("incident_count",))
    return {r["check_name"]: r["n_bad"] for r in out.collect()}


def test_good_rows_break_nothing(spark):
    got = found(spark, GOOD)
    assert set(got) == set(BROKEN) and set(got.values()) == {0}


@pytest.mark.parametrize("name", sorted(BROKEN))
def test_each_invariant_fires(spark, name):
    got = found(spark, GOOD | BROKEN[name])
    assert got[name] > 0
    # 1.2 of a record is over its sum and its range as well
    also = {"pain_total": {"share_sum", "share_range"}, "share_sum": {"pain_total"}, "share_range": set()}.get(name, set())
    assert {k for k, n in got.items() if n} <= {name} | also


def test_the_gate(spark):
    rows = [("a", "error", True), ("b", "warn", False)]
    make = lambda r: spark.createDataFrame(r, "check_name string, severity string, passed boolean")
    assert checks.may_promote(make(rows)) and not checks.may_promote(make([*rows, ("c", "error", False)])) and not checks.may_promote(make([]))


def test_a_model_is_that_of_the_files_as_they_are(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "region.parquet"))
    t = Tables(spark, str(tmp_path))
    before = canonical.Model.of(t)
    assert canonical.Model.of(Tables(spark, str(tmp_path))) is before
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "nation.parquet"))
    assert canonical.Model.of(t) is not before
