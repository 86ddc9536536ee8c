"""Teams and organisations: metric values, scores against peers, and what closing a gap is worth."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import columns as X
from tarnlake.operators import aggregates as A
from tarnlake.operators import joins as J
from tarnlake.plans.canonical import Model
from tarnlake.plans.facts import RULES, Rules, causes
from tarnlake.store import written


@dataclass(frozen=True)
class Card:
    """Metrics of the score with weight, unit and least sample; all are better when lower."""

    as_of: str = "2001-07-02"
    window_weeks: int = 320
    trend_weeks: int = 12
    weights: dict = field(default_factory=lambda: {"mttr_hours": 0.3, "reopen_rate": 0.15, "repeat_incident_rate": 0.15, "reassignment_rate": 0.1, "sla_breach_rate": 0.1, "change_failure_rate": 0.15, "alert_noise_ratio": 0.05})
    least_sample: dict = field(default_factory=lambda: {"mttr_hours": 3, "reopen_rate": 3, "repeat_incident_rate": 5, "reassignment_rate": 3, "sla_breach_rate": 3, "change_failure_rate": 3, "alert_noise_ratio": 5})
    models: dict = field(default_factory=lambda: {"mttr_hours": "mttr", "repeat_incident_rate": "repeat", "reopen_rate": "reopen", "reassignment_rate": "reassign", "sla_breach_rate": "sla", "change_failure_rate": "cfr", "alert_noise_ratio": "noise"})
    least_peers: int = 5
    trend_weight: float = 0.5
    least_coverage: float = 0.5
    top_entities: int = 50
    reopen_factor: float = 0.5
    reassign_hours: float = 0.75
    sla_penalty: float = 250.0


CARD = Card()


def _end(c: Card) -> Column:
    return F.lit(c.as_of).cast("timestamp")


def best_owner(m: Model) -> DataFrame:
    """service_id, owner: one team for each service, the surest first."""
    rows = m.core("service_map").filter("role in ('owner', 'support') and team_id is not null and service_id is not null")
    return J.best_by(rows, ["service_id"], F.desc_nulls_last("confidence"), F.asc("team_id")).select("service_id", F.col("team_id").alias("owner"))


def noise_events(m: Model, rules: Rules = RULES) -> DataFrame:
    e = m.core("event").filter(F.col("severity").isin(*rules.noise_severities)).select("event_id", "ts", "service_id", "incident_id")
    return e.join(best_owner(m), "service_id", "left").join(m.core("service").select("service_id", "org_id"), "service_id", "left").withColumnRenamed("owner", "team_id")


def observations(m: Model, rules: Rules = RULES) -> DataFrame:
    """metric, team_id, org_id, ts, num, den: a metric's value is the sum of num by the sum of den."""
    one = lambda metric, ts, num, fits: F.when(fits, F.struct(F.lit(metric).alias("metric"), ts.alias("ts"), num.cast("double").alias("num")))
    done, flag = F.col("resolved_at"), lambda c: F.col(c).cast("int")
    of_incident = F.array(
        one("mttr_hours", done, F.col("resolve_h"), F.col("resolve_h").isNotNull()),
        one("reopen_rate", done, flag("is_reopened"), done.isNotNull()),
        one("reassignment_rate", done, flag("is_reassigned"), done.isNotNull()),
        one("sla_breach_rate", done, flag("sla_breached"), done.isNotNull() & F.col("sla_breached").isNotNull()),
        one("repeat_incident_rate", F.col("opened_at"), flag("is_repeat"), F.lit(True)),
    )
    inc = m.fact("incident").filter("not excluded").select("team_id", "org_id", F.explode(F.filter(of_incident, lambda x: x.isNotNull())).alias("o")).select("team_id", "org_id", "o.*")
    chg = m.fact("change").filter("deployed").select("team_id", "org_id", F.lit("change_failure_rate").alias("metric"), F.col("actual_end").alias("ts"), flag("failed").cast("double").alias("num"))
    evt = noise_events(m, rules).select("team_id", "org_id", F.lit("alert_noise_ratio").alias("metric"), "ts", F.col("incident_id").isNull().cast("int").cast("double").alias("num"))
    return inc.unionByName(chg).unionByName(evt).filter("ts is not null")


def by_entity(m: Model, rows: DataFrame) -> DataFrame:
    """Rows once for their team and once for each ancestor of their organisation."""
    teams = rows.filter("team_id is not null").withColumn("entity_type", F.lit("team")).withColumn("entity_id", F.col("team_id"))
    up = m.fact("org_closure").select("org_id", F.col("ancestor_org_id").alias("entity_id"))
    return teams.unionByName(rows.join(up, "org_id").withColumn("entity_type", F.lit("org")).select(*teams.columns))


def metric_values(m: Model, c: Card = CARD) -> DataFrame:
    """One row for each metric, entity and period (the whole window, and each week of the trend)."""
    o = by_entity(m, observations(m)).filter(F.col("ts") < _end(c))
    week = F.date_trunc("week", "ts")
    start = F.lit(c.as_of).cast("date") - F.lit(7 * c.window_weeks)
    periods = F.array(
        F.when(F.col("ts") >= start.cast("timestamp"), F.struct(F.lit("window").alias("period"), start.alias("period_start"))),
        F.when(week >= F.date_trunc("week", _end(c)) - F.make_dt_interval(days=F.lit(7 * c.trend_weeks)), F.struct(F.lit("week").alias("period"), F.to_date(week).alias("period_start"))),
    )
    x = o.withColumn("p", F.explode(F.filter(periods, lambda p: p.isNotNull()))).filter((F.col("p.period") != "week") | (F.col("p.period_start") < F.to_date(F.date_trunc("week", _end(c)))))
    g = x.groupBy("metric", "entity_type", "entity_id", "p.period", "p.period_start").agg(F.sum("num").alias("numerator"), F.count("*").alias("sample_size"))
    least = X.lookup(F.col("metric"), c.least_sample, 1)
    few = F.col("sample_size") < least
    value = F.when(~few, F.col("numerator") / F.col("sample_size"))
    unit = F.when(F.col("metric") == "mttr_hours", "hours").otherwise("ratio")
    return g.select("metric", "entity_type", "entity_id", "period", "period_start", value.alias("value"), "numerator", F.col("sample_size").cast("double").alias("denominator"), "sample_size", unit.alias("unit"), X.flags(("insufficient_sample", few)).alias("flags"))


def entities(m: Model) -> DataFrame:
    """entity_type, entity_id, natural_group, all_group: active teams by criticality, organisations by level."""
    served = m.core("service_map").filter("role in ('owner', 'support')").select("team_id", "service_id").join(m.core("service").select("service_id", "criticality"), "service_id").groupBy("team_id").agg(F.min("criticality").alias("c"))
    bucket = F.when(F.col("c").between(1, 2), "hi").when(F.col("c").between(3, 4), "lo").otherwise("none")
    team = m.core("team").filter("active").join(served, "team_id", "left").select(F.lit("team").alias("entity_type"), F.col("team_id").alias("entity_id"), F.concat(F.lit("team:crit_"), bucket).alias("natural_group"), F.lit("team:all").alias("all_group"))
    level = m.fact("org_closure").groupBy("org_id").agg(F.max("depth").alias("d"))
    org = level.select(F.lit("org").alias("entity_type"), F.col("org_id").alias("entity_id"), F.concat(F.lit("org:level"), F.col("d").cast("string")).alias("natural_group"), F.lit("org:all").alias("all_group"))
    return team.unionByName(org)


def org_score(m: Model, values: DataFrame, c: Card = CARD) -> DataFrame:
    """Each entity's metrics against its peers: z, trend, composite and rank within its type."""
    keys = ["entity_type", "metric"]
    e = entities(m).withColumn("metric", F.explode(F.array(*[F.lit(k) for k in c.weights])))
    v = values.filter("period = 'window'").select("entity_type", "entity_id", "metric", F.col("value").alias("x"), "sample_size", F.col("flags").contains("insufficient_sample").alias("few"))
    base = written(e.join(v, ["entity_type", "entity_id", "metric"], "left").withColumn("w", X.lookup(F.col("metric"), c.weights, 0.0)), "base")
    enough = base.groupBy(*keys, "natural_group").agg((F.count("x") >= c.least_peers).alias("enough"))
    base = base.join(enough, [*keys, "natural_group"]).withColumn("peer_group", F.when(F.col("enough"), F.col("natural_group")).otherwise(F.col("all_group")))
    member = base.select(*keys, F.explode(F.array("natural_group", "all_group")).alias("peer_group"), "x").filter("x is not null")
    med = member.groupBy(*keys, "peer_group").agg(F.median("x").alias("median"))
    dev = member.join(med, [*keys, "peer_group"]).withColumn("d", F.abs(F.col("x") - F.col("median")))
    scale = dev.groupBy(*keys, "peer_group", "median").agg(F.median("d").alias("mad"), F.avg("d").alias("mean_dev"))
    scale = scale.withColumn("denom", F.when(F.col("mad") > 0, 1.4826 * F.col("mad")).when(F.col("mean_dev") > 0, 1.2533 * F.col("mean_dev"))).drop("mad", "mean_dev")
    weeks = values.filter("period = 'week' and value is not null").withColumn("t", F.datediff("period_start", F.lit(c.as_of).cast("date")) / 7)
    slopes = A.theil_sen(weeks, ["entity_type", "entity_id", "metric"], "t", "value", least=6)
    z = base.join(scale, [*keys, "peer_group"], "left").join(slopes, ["entity_type", "entity_id", "metric"], "left")
    z = z.withColumn("z", F.when(F.col("x").isNotNull(), F.coalesce((F.col("x") - F.col("median")) / F.col("denom"), F.lit(0.0))))
    z = written(z.withColumn("b", X.clip(F.col("z"), -5, 5)).withColumn("trend", X.clip(F.col("slope") * 12 / F.col("denom"), -5, 5)), "scores")
    has = F.col("b").isNotNull()
    agg = z.groupBy("entity_type", "entity_id").agg(F.sum(F.when(has, F.col("w"))).alias("covered"), F.sum("w").alias("total"), F.sum(F.when(has, F.col("w") * (F.col("b") + c.trend_weight * F.coalesce("trend", F.lit(0.0))))).alias("num"))
    ok = F.coalesce(F.col("covered") / F.col("total") >= c.least_coverage, F.lit(False))
    agg = agg.select("entity_type", "entity_id", ok.alias("ok"), F.when(ok, F.col("num") / F.col("covered")).alias("composite"))
    # a ranking of teams and of organisations, not of facts; rounded, so that sums in another order rank alike
    ranked = J.top_n(agg.withColumn("r", F.round("composite", 9)), ["entity_type"], 2**31 - 1, F.desc_nulls_last("r"), F.asc("entity_id")).drop("r")
    flags = X.flags(("insufficient_sample", F.coalesce("few", F.lit(False))), ("low_coverage", ~F.col("ok")), ("no_data", F.col("sample_size").isNull()), ("no_trend", F.col("slope").isNull()), ("peer_fallback", F.col("peer_group") != F.col("natural_group")))
    out = z.join(ranked, ["entity_type", "entity_id"])
    return out.select("entity_type", "entity_id", "metric", F.col("x").alias("value"), "peer_group", F.col("median").alias("peer_median"), F.col("z").alias("z_score"), F.col("slope").alias("trend_slope"), F.coalesce("sample_size", F.lit(0)).cast("long").alias("sample_size"), "composite", "rank", flags.alias("flags"))


def levers(m: Model, scores: DataFrame, c: Card = CARD, rules: Rules = RULES) -> DataFrame:
    """What reaching the peers' median, or their best quarter, would save a year, by the metric's model."""
    worse = scores.filter((F.col("rank") <= c.top_entities) & (F.col("z_score") > 0) & F.col("value").isNotNull()).withColumn("model", X.lookup(F.col("metric"), c.models, "")).filter("model <> ''")
    best = scores.groupBy("entity_type", "peer_group", "metric").agg(F.percentile("value", F.lit(0.25)).alias("q25"))
    targets = F.explode(F.array(F.struct(F.lit("peer_median").alias("kind"), F.col("peer_median").alias("t")), F.struct(F.lit("top_quartile").alias("kind"), F.col("q25").alias("t"))))
    t = written(worse.join(best, ["entity_type", "peer_group", "metric"]).withColumn("g", targets).filter("g.t < value").select("entity_type", "entity_id", "metric", "model", "peer_group", F.col("value").alias("x"), "g.kind", "g.t"), "targets")
    since = _end(c) - F.expr("interval 12 months")
    recent = lambda col: (F.col(col) >= since) & (F.col(col) < _end(c))
    ids = t.select("entity_type", "entity_id").distinct()
    per = lambda df: by_entity(m, df).join(F.broadcast(ids), ["entity_type", "entity_id"], "left_semi")
    inc = per(m.fact("incident").filter(~F.col("excluded") & recent("opened_at")).select("team_id", "org_id", "downtime_usd", "toil_usd", "total_usd"))
    money = lambda col: F.sum(col).cast("double")
    inc = inc.groupBy("entity_type", "entity_id").agg(F.count("*").alias("n"), money("downtime_usd").alias("down"), money("toil_usd").alias("toil"), money("total_usd").alias("total"))
    changes = per(m.fact("change").filter(recent("actual_end")).select("team_id", "org_id", "record_id", "deployed", "failed"))
    chg = changes.groupBy("entity_type", "entity_id").agg(F.count_if("deployed").alias("d"), F.count_if("failed").alias("f"))
    caused = changes.filter("failed").select("entity_type", "entity_id", F.col("record_id").alias("change_id")).join(causes(m, rules), "change_id").select("entity_type", "entity_id", F.col("incident_id").alias("record_id")).distinct()
    caused = caused.join(m.fact("incident").filter(~F.col("excluded") & (F.col("opened_at") < _end(c))).select("record_id", "total_usd"), "record_id").groupBy("entity_type", "entity_id").agg(money("total_usd").alias("cc"))
    evt = per(noise_events(m, rules).filter(recent("ts")).select("team_id", "org_id")).groupBy("entity_type", "entity_id").agg(F.count("*").alias("e"))
    x = t
    for part in (inc, chg, caused, evt):
        x = x.join(part, ["entity_type", "entity_id"], "left")
    x = x.fillna(0, ["n", "down", "toil", "d", "f", "cc", "e"])
    gap, n = F.col("x") - F.col("t"), F.col("n")
    each = lambda col: F.try_divide(F.col(col), n)
    kind = F.col("model")
    per_failure = rules.backout_hours * rules.engineer_hour + F.coalesce(F.try_divide(F.col("cc"), F.col("f")), F.lit(0.0))
    delta = (
        F.when(kind == "mttr", F.when(F.col("x") != 0, (F.col("down") + F.col("toil")) * gap / F.col("x")))
        .when(kind == "repeat", n * gap * each("total"))
        .when(kind == "reopen", n * gap * each("toil") * c.reopen_factor)
        .when(kind == "reassign", n * gap * c.reassign_hours * rules.engineer_hour)
        .when(kind == "sla", F.when(F.lit(c.sla_penalty != 0), n * gap * c.sla_penalty))
        .when(kind == "cfr", F.col("d") * gap * per_failure)
        .when(kind == "noise", F.col("e") * gap * (rules.triage_minutes / 60 * rules.engineer_hour))
    )
    x = x.withColumn("delta_usd", F.round(delta, 2)).filter("delta_usd > 0")
    names = m.core("team").select(F.lit("team").alias("entity_type"), F.col("team_id").alias("entity_id"), "name").unionByName(m.core("org").select(F.lit("org").alias("entity_type"), F.col("org_id").alias("entity_id"), "name"))
    basis = F.when(kind == "cfr", F.col("d")).when(kind == "noise", F.col("e")).otherwise(n)
    x = x.join(names, ["entity_type", "entity_id"], "left")
    params = F.to_json(F.struct(F.col("name").alias("entity_name"), F.col("metric").alias("metric_label"), F.col("kind").alias("target_kind"), basis.cast("long").alias("n_basis"), "peer_group"))
    return x.select("entity_type", "entity_id", "metric", F.col("kind").alias("target_kind"), F.col("x").alias("current_value"), F.col("t").alias("target_value"), "delta_usd", params.alias("template_params"))


def peer_group(m: Model, entity_type: str, entity_id: str, least: int = 5) -> DataFrame:
    """entity_found, key, fallback, member_id: the members of one entity's group, or of all where it is too small."""
    e = entities(m).filter(F.col("entity_type") == entity_type)
    own = e.filter(F.col("entity_id") == entity_id).select(F.col("natural_group").alias("own"), F.col("all_group").alias("everyone"))  # one row
    j = e.join(F.broadcast(own), F.lit(True), "left").withColumn("near", F.col("natural_group") == F.col("own"))
    n = j.agg(F.count_if("near").alias("n"))
    j = j.join(F.broadcast(n), F.lit(True)).withColumn("fallback", F.col("n") < least)
    key = F.when(F.col("fallback"), F.col("everyone")).otherwise(F.col("own"))
    return j.filter(F.col("own").isNotNull() & (F.col("fallback") | F.col("near"))).select(F.lit(True).alias("entity_found"), key.alias("key"), "fallback", F.col("entity_id").alias("member_id"))
