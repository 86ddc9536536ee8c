"""Checks of the canonical tables, and invariants of facts and scores: one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.plans import staging
from tarnlake.plans.canonical import Model
from tarnlake.store import written

COUNTED = ("org", "team", "service", "service_map", "incident", "change", "problem", "event", "metric_daily", "work_item", "work_item_transition", "work_item_link")
FUTURE = {"incident": ("opened_at", "resolved_at", "closed_at"), "change": ("opened_at", "actual_start", "actual_end"), "problem": ("opened_at", "resolved_at"), "event": ("ts",), "work_item": ("created_at", "resolved_at")}
KEYS = {"org": ("org_id",), "team": ("team_id",), "service": ("service_id",), "incident": ("record_id",), "change": ("record_id",), "problem": ("record_id",), "work_item": ("record_id",), "event": ("event_id",), "metric_daily": ("date", "service_id", "metric_name", "source_tool")}
#: Limits of the checks.
MOST_DROP, NULL_WARN, NULL_ERROR, ITEM_NULL_WARN, CAST_WARN, MOST_FUTURE, BEFORE_WARN, MOST_DUPLICATES, LEAST_COVERED, UNMAPPED_WARN = 0.2, 0.05, 0.5, 0.3, 0.05, 0.0, 0.01, 0.0, 0.8, 0.1
CHECK = ["check_name", "severity", "value", "threshold", "passed"]


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _row(df: DataFrame, name: Column, severity: Column, value: Column, threshold: Column, least: bool = False) -> DataFrame:
    v, t = value.cast("double"), threshold.cast("double")
    return df.select(name.alias("check_name"), severity.alias("severity"), v.alias("value"), t.alias("threshold"), ((v >= t) if least else (v <= t)).alias("passed"))


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_checks(m: Model, previous: dict[str, int], started_at: str) -> DataFrame:
    """CHECK of a build: counts against the ``previous`` one, nulls, casts, times, keys, unmapped rows.

    Each table is read once for all its checks.
    """
    L = F.lit
    start = L(started_at).cast("timestamp")
    parts = []
    for name in COUNTED:
        t = m.core(name)
        aggs = [F.count("*").alias("n")]
        for c in FUTURE.get(name, ()):
            aggs.append(F.count_if(F.col(c) > start).alias(f"future_{c}"))
        if name in KEYS:
            key = F.struct(*KEYS[name]) if len(KEYS[name]) > 1 else F.col(KEYS[name][0])
            aggs.append((F.count("*") - F.count_distinct(key)).alias("dup"))
        if name in ("incident", "work_item"):
            aggs.append(F.count_if(F.col("service_id").isNull()).alias("nulls"))
        if name == "incident":
            both = F.col("resolved_at").isNotNull() & F.col("opened_at").isNotNull()
            aggs += [F.count_if(both & (F.col("resolved_at") < F.col("opened_at"))).alias("before"), F.count_if(both).alias("both")]
        one = t.agg(*aggs)
        n, prev = F.col("n"), L(previous.get(name, 0))
        rows = [(L(f"row_count_drop:core.{name}"), L("error"), _share(prev - n, prev), L(MOST_DROP))]
        rows += [(L(f"future_timestamp:core.{name}.{c}"), L("warn"), F.col(f"future_{c}"), L(MOST_FUTURE)) for c in FUTURE.get(name, ())]
        if name in KEYS:
            rows.append((L(f"duplicate_key:core.{name}"), L("error"), F.col("dup"), L(MOST_DUPLICATES)))
        if name == "incident":
            v = _share(F.col("nulls"), n)
            high = v > NULL_ERROR
            rows.append((L("incident_service_null"), F.when(high, "error").otherwise("warn"), v, F.when(high, L(NULL_ERROR)).otherwise(L(NULL_WARN))))
            rows.append((L("resolved_before_opened"), L("warn"), _share(F.col("before"), F.col("both")), L(BEFORE_WARN)))
        if name == "work_item":
            rows.append((L("work_item_service_null"), L("warn"), _share(F.col("nulls"), n), L(ITEM_NULL_WARN)))
        x = one.select(F.explode(F.array(*[F.struct(a.alias("name"), b.alias("severity"), c.cast("double").alias("value"), d.cast("double").alias("threshold")) for a, b, c, d in rows])).alias("r")).select("r.*")
        parts.append(_row(x, F.col("name"), F.col("severity"), F.col("value"), F.col("threshold")))
    typed = staging.cast_statistics({n: m.stg(n) for n in staging.BUILDERS}).filter("n_present > 0")
    parts.append(_row(typed, F.concat(L("cast_fail:stg."), "table_name", L("."), "column_name"), L("warn"), _share(F.col("n_failed"), F.col("n_present")), L(CAST_WARN)))
    counts = m.core("build_counts").groupBy().pivot("name", ["metric_daily_raw", "metric_daily_unmapped"]).agg(F.sum("value"))
    parts.append(_row(counts, L("metric_daily_unmapped_service"), L("warn"), _share(F.col("metric_daily_unmapped"), F.col("metric_daily_raw")), L(UNMAPPED_WARN)))
    texts = m.core("incident").filter("short_description is not null").select("record_id")
    decided = m.raw("cluster_member").select("record_id").distinct().withColumn("d", L(True))
    covered = texts.join(decided, "record_id", "left").agg(F.count("*").alias("n"), F.count("d").alias("d"))
    parts.append(_row(covered, L("decision_coverage_incident"), L("warn"), F.when(F.col("n") == 0, L(1.0)).otherwise(F.col("d") / F.col("n")), L(LEAST_COVERED), least=True))
    return _united(parts)


def may_promote(checks: DataFrame) -> bool:
    """At least one check, and no failed one that is an error."""
    r = checks.agg(F.count("*").alias("n"), F.count_if(~F.col("passed") & (F.col("severity") == "error")).alias("bad")).head()
    return r["n"] > 0 and r["bad"] == 0


def invariants(m: Model, shares: DataFrame, scores: DataFrame, metrics: DataFrame, orgs: DataFrame, portfolio: DataFrame, usd: DataFrame, counts: tuple[str, ...]) -> DataFrame:
    """check_name, n_bad of each invariant of facts and scores; ``usd``: RECORD and usd of what is shared out."""
    L = F.lit
    bad = lambda df, name, cond: df.agg(F.count_if(cond).alias("n_bad")).select(L(name).alias("check_name"), F.coalesce("n_bad", L(0)).cast("long").alias("n_bad"))
    finite = lambda c: F.col(c).isNull() | (~F.isnan(c) & (F.abs(c) < float("inf")))
    neg = lambda *cs: F.coalesce(F.greatest(*[(F.col(c) < 0).cast("int") for c in cs], L(0)), L(0)) > 0
    parts = [
        bad(m.fact("incident"), "fact_duration_negative:incident", neg("resolve_h", "resolve_bh", "impact_h", "toil_h")),
        bad(m.fact("change"), "fact_duration_negative:change", F.col("lead_time_h") < 0),
        bad(m.fact("work_item"), "fact_duration_negative:work_item", F.col("cycle_days") < 0),
        bad(metrics, "metric_ratio_range", (F.col("unit") == "ratio") & ((F.col("value") < 0) | (F.col("value") > 1))),
        bad(metrics, "metric_pct_range", (F.col("unit") == "pct") & ((F.col("value") < 0) | (F.col("value") > 100))),
        bad(metrics, "metric_negative", neg("value", "numerator", "denominator", "sample_size")),
        bad(metrics, "metric_count_integral", F.col("metric").isin(*counts) & (F.col("value") != F.floor("value"))),
    ]
    # a record's shares are summed where its rows are made; its cost is met once
    out_of_range = (F.col("share") <= 0) | (F.col("share") > 1 + 1e-9)
    per = written(shares.groupBy("record_kind", "record_id").agg(F.sum("share").alias("s"), F.count_if(out_of_range).alias("n")), "shares")
    parts.append(bad(per, "share_sum", F.col("s") > 1 + 1e-9))
    parts.append(per.agg(F.coalesce(F.sum("n"), L(0)).cast("long").alias("n_bad")).select(L("share_range").alias("check_name"), "n_bad"))
    spread = per.join(usd, ["record_kind", "record_id"]).agg(F.sum(F.col("s") * F.col("usd")).alias("a"))
    total = spread.join(F.broadcast(usd.agg(F.sum("usd").alias("t"))), how="cross")  # one row each
    parts.append(bad(total, "pain_total", F.coalesce("a", L(0.0)) - F.coalesce("t", L(0.0)) > 0.01 + 1e-9 * F.coalesce("t", L(0.0))))
    parts.append(bad(scores, "confidence_range", ~F.coalesce(F.col("confidence").between(0.05, 1), L(False))))
    parts.append(scores.agg((F.count("*") - F.count_distinct("rank")).alias("n_bad")).select(L("funding_rank_unique").alias("check_name"), "n_bad"))
    parts.append(bad(orgs, "org_z_finite", ~(finite("z_score") & finite("composite") & finite("trend_slope"))))
    chosen = portfolio.filter("selected").select("scenario", "candidate_id", "budget_usd")
    spent = chosen.join(scores.select("candidate_id", "effort_cost_usd"), "candidate_id").groupBy("scenario").agg(F.sum(F.ceil("effort_cost_usd")).alias("spent"), F.floor(F.min("budget_usd")).alias("b"))
    parts.append(bad(spent, "portfolio_budget", F.col("spent") > F.col("b")))
    below = m.core("work_item_closure").filter("depth >= 1").select(F.col("ancestor_record_id").alias("candidate_id"), "record_id")
    both = chosen.join(below, "candidate_id").join(chosen.select("scenario", F.col("candidate_id").alias("record_id")), ["scenario", "record_id"])
    parts.append(bad(both, "portfolio_parent_child", L(True)))
    w = m.core("work_item").select("record_id", "key", "status_category")
    links = m.core("work_item_link").filter("lower(link_type) = 'blocks'").select("from_key", "to_key")
    needs = chosen.join(w.select(F.col("record_id").alias("candidate_id"), F.col("key").alias("to_key")), "candidate_id").join(links, "to_key").join(w.filter("status_category <> 'done'").select(F.col("key").alias("from_key"), F.col("record_id").alias("a")), "from_key")
    needs = needs.join(scores.select(F.col("candidate_id").alias("a")), "a", "left_semi").select("scenario", "candidate_id", "a")
    missing = needs.join(chosen.select("scenario", F.col("candidate_id").alias("a")), ["scenario", "a"], "left_anti").select("scenario", "candidate_id").distinct()
    parts.append(bad(missing, "portfolio_blockers", L(True)))
    parts.append(bad(m.core("work_item_closure"), "work_item_cycle", F.col("depth") == 10))
    return _united(parts)
