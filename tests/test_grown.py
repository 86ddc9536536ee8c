"""What only shows on larger or odd tables: each of these failed once."""

import math
import random
import time
from datetime import datetime, timedelta

from oracle import difference

from pyspark.sql import functions as F

from tarnlake.functions import columns as X
from tarnlake.operators import joins as J
from tarnlake.plans import canonical, canonical_metrics, checks, funding, metrics, model, portfolio, registry, stages
from tarnlake.plans.adapter import Tables

T0 = datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def tables(spark, folder, **rows):
    """Parquet tables of the driver's names in ``folder``; the others are those of sf0.001."""
    import os

    from oracle import TABLES

    for t in TABLES:
        if t in rows:
            data, schema = rows[t]
            spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/new-{t}")
            part = next(f for f in os.listdir(f"{folder}/new-{t}") if f.endswith(".parquet"))
            os.link(f"{folder}/new-{t}/{part}", f"{folder}/{t}.parquet")
        else:
            os.symlink(f"/root/testdata/sf0.001/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


def matches(spark, name, folder):
    return difference(spark, registry.queries()[name], registry.oracle_sql()[name], folder)


EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def test_sessions_end_after_two_hours_to_the_second(spark, tmp_path):
    gaps = [0, 1, 7199, 7200, 7201, 7202, 7200, 7201, 0, 86_400]
    rows, n = [], 0
    for user, part in ((1, 0), (2, 999_000), (3, 1_000)):
        at = T0
        for g in gaps * 2:
            at, n = at + timedelta(seconds=g), n + 1
            rows.append((n, at.replace(microsecond=part if n % 2 else 0), user, "view", 1.0, "{}"))
    assert matches(spark, "session_windows", tables(spark, tmp_path, events=(rows, EVENTS))) == ""


class Items:
    """A model of work items whose rows come in another order each time that they are read."""

    def __init__(self, items, spans):
        dealt = F.udf(lambda _: random.randrange(1_000_000), "int").asNondeterministic()
        self.items, self.spans = (df.repartition(4, dealt("record_id")) for df in (items, spans))

    def fact(self, name):
        return self.items

    def kept(self, name, build):
        return self.spans


def test_carry_over_does_not_hang_on_the_order_of_rows(spark):
    items = [(f"i{k}", "bug", f"t{k % 3}") for k in range(200)]
    moves = [(datetime(2000, 1, 10), "in_progress"), (datetime(2000, 2, 10), "done"), (datetime(2000, 3, 10), "in_progress"), (datetime(2000, 4, 10), "todo")]
    ends = [*[at for at, _ in moves[1:]], None]
    spans = [(i[0], since, until, c) for i in items for (since, c), until in zip(moves, ends, strict=True)]
    m = Items(spark.createDataFrame(items, "record_id string, type string, team_id string"), spark.createDataFrame(spans, "record_id string, since timestamp, until timestamp, category string"))
    got = sorted((r["record_id"], r["start_ts"].month, r["is_open"]) for r in canonical_metrics._carried(m).collect())
    assert got == sorted((i[0], month, still) for i in items for month, still in ((1, False), (3, True)))


def test_time_formats_are_tried_only_on_texts_with_their_signs(spark):
    texts = ["2024-01-02 03:04:05.123456", "2024-01-02 03:04:05", "2024-01-02T03:04:05.5-05:30", "2024-01-02t03:04:05z", "2024-01-02T03:04:05", "2024-01-02", "2024-01-02 03:04", "soon", "", None, "T-", "-.: "]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    plain = F.coalesce(*[F.try_to_timestamp(F.trim("x"), F.lit(f)) for f in X.TIME_FORMATS])
    assert df.filter(~plain.eqNullSafe(X.to_utc(F.col("x")))).count() == 0
    tried = df.select(X.to_utc(F.col("x")))._jdf.queryExecution().analyzed().toString()
    assert tried.lower().count("case when") >= len(X.TIME_FORMATS)


def test_attribution_makes_no_pairs(spark):
    m = canonical.Model.of(Tables(spark, SF))
    parts, costs = model.parts_of(m), funding.record_costs(m)
    assert parts.records.join(costs, funding.RECORD, "left_anti").isEmpty() and parts.records.groupBy(*funding.RECORD).count().filter("count > 1").isEmpty()
    assert parts.pots.groupBy("pot", "candidate_id").count().filter("count > 1").isEmpty()
    assert parts.records.join(parts.direct, funding.RECORD, "left_semi").isEmpty()


def test_sums_of_parts_are_those_of_their_rows(spark):
    t0 = datetime(2024, 1, 20)
    rec = [("incident" if k % 2 else "event", f"r{k}", 10.0 + k, 0.5 + k % 3 / 10, f"cluster/c{k % 2}", t0 - timedelta(days=k), k % 3) for k in range(60)]
    pots = [("cluster/c0", "a", 2, 0.6, 0.5, 1.0, 0.25), ("cluster/c0", "b", 2, 0.6, 0.5, 1.0, 0.25), ("cluster/c0", "d", 2, 0.8, 1.0, 1.0, 0.5), ("cluster/c1", "a", 2, 0.8, 1.0, 1.0, 1.0)]
    one = [("e", "incident", "x", 1, 1.0, 1.0, 1.0, 7.0, t0, 1)]
    p = funding.Parts(
        spark.createDataFrame(one, "candidate_id string, record_kind string, record_id string, tier int, weight double, quality double, share double, pain double, ts timestamp, priority int"),
        spark.createDataFrame(rec, "record_kind string, record_id string, usd double, scale double, pot string, ts timestamp, priority int"),
        spark.createDataFrame(pots, "pot string, candidate_id string, tier int, factor double, part double, level double, share double"),
    )
    usd = F.col("pain").cast("decimal(18,2)").cast("double")
    figures = [F.round(F.sum(x), 6) for x in (usd, usd * F.col("quality"))]
    want = {tuple(r) for r in p.rows().groupBy("candidate_id").agg(*figures, F.round(F.sum(F.when(F.col("record_kind") == "incident", F.col("share"))), 6)).collect()}
    sums = funding._sums(p, funding.SETTINGS)
    assert want == {tuple(r) for r in sums.groupBy("candidate_id").agg(*[F.round(F.sum(x), 6) for x in ("pain", "pq", "n_share")]).collect()}
    assert p.rows().count() == 30 * 3 + 30 + 1 and {r["candidate_id"] for r in sums.filter("urgent").collect()} == {"a", "e"}


def test_a_choice_among_many_candidates_ends(spark):
    r = random.Random(7)
    items = [portfolio.Item(f"i{k}", r.uniform(0, 5000), r.uniform(100, 5000), f"t{k % 40}", r.randint(1, 6)) for k in range(30_000)]
    began = time.time()
    c = portfolio.choose(items, portfolio.Limits(budget=60_000.0, capacity={}, default_capacity=25.0, quarters=2, most_nodes=30_000))
    assert time.time() - began < 20 and sum(portfolio._cost(i) for i in items if i.id in set(c.chosen)) <= 60_000


def test_invariants_make_the_shares_once(spark):
    from test_invariants import GOOD, Fixture

    m, made = Fixture(spark, GOOD), spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    shares = m.t["shares"].withColumn("share", F.udf(seen, "double").asNondeterministic()("share"))
    out = checks.invariants(m, shares, m.t["scores"], m.t["metrics"], m.t["orgs"], m.t["portfolio"], m.t["usd"], ("incident_count",))
    assert {r["n_bad"] for r in out.collect()} == {0} and made.value == len(GOOD["shares"])


def test_either_key_shuffles_no_pairs(spark):
    left = spark.createDataFrame([(k, k % 3 if k % 5 else None, "same") for k in range(40)], "a long, g int, l string").union(spark.createDataFrame([(1, 1, "same")], "a long, g int, l string"))
    right = spark.createDataFrame([(k, str(k % 4)) for k in range(60)] + [(None, "1"), (3, None)], "b int, h string")
    out = J.either_key(left, right, [("g", "h"), ("a", "b")])
    rows = [(x, y) for x in left.collect() for y in right.collect()]
    agree = lambda x, y: 0 if x["g"] is not None and str(x["g"]) == y["h"] else 1 if x["a"] == y["b"] else None
    got = sorted(((r["a"], r["b"], r["matched"]) for r in out.collect()), key=repr)
    assert got == sorted(((x["a"], y["b"], agree(x, y)) for x, y in rows if agree(x, y) is not None), key=repr)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan[: plan.index("Join")]


class Tickets:
    def __init__(self, inc, chg):
        self.t = {"incident": inc, "change": chg}

    def core(self, name):
        return self.t[name]


def test_links_are_the_best_of_all_pairs_and_no_pair_is_shuffled(spark, monkeypatch):
    r = random.Random(11)
    monkeypatch.setattr(stages, "MOST_PAIRS", 50)
    at = lambda h: T0 + timedelta(minutes=15 * h)
    inc = [(f"i{k}", r.choice(["a", "b", None]), r.choice(["s", None]), at(r.randrange(2000)), r.choice([None, f"c{r.randrange(90)}"]), r.choice(["change it", "Order 5", "Order 1", None])) for k in range(150)]
    chg = []
    for k in range(90):
        t = at(r.randrange(2000))
        chg.append((f"c{k}", r.choice(["a", "b", None]), r.choice(["s", "u"]), r.choice([None, t - timedelta(hours=r.choice([0, 5, 90]))]), r.choice([None, t]), t, r.choice(["failed", "success", None]), r.choice(["emergency", "normal"])))
    m = Tickets(
        spark.createDataFrame(inc, "record_id string, ci_id string, service_id string, opened_at timestamp, caused_by_change_id string, short_description string"),
        spark.createDataFrame(chg, "record_id string, ci_id string, service_id string, actual_start timestamp, actual_end timestamp, planned_end timestamp, outcome string, type string"),
    )
    want = set()
    for i, ci, sv, opened, named, text in inc:
        told = bool(text) and (text.startswith("change") or text[-1] in "05")
        if named:
            want.add((i, named, "source_field", 1.0))
        best = []
        for c, c_ci, c_sv, start, end, plan, outcome, kind in chg:
            t = end or start or plan
            d = (opened - t).total_seconds()
            near = -3600 <= d <= 72 * 3600 or (start and end and start <= opened <= end)
            w = [x for same, x in ((ci and ci == c_ci, 1.0), (sv and sv == c_sv, 0.6)) if same]
            if w and near and d <= 72 * 3600 and c != named:
                raw = min(1.0, max(w) * math.exp(-max(0.0, d / 3600) / 12.0) * ((1.25 if outcome == "failed" else 1.0) * (1.1 if kind == "emergency" else 1.0)))
                score = raw if told else min(raw, 0.45)
                if score >= 0.3:
                    best.append((-score, -raw, c))
        want |= {(i, c, "time_ci_window", round(-s, 9)) for s, _, c in sorted(best)[:3]}
    out = stages.link_candidates(m)
    assert len(want) > 100 and want == {(x["incident_id"], x["change_id"], x["method"], round(x["score"], 9)) for x in out.collect()}
    # every join of the plan is that of the named changes
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_medians_count_equal_values_first(spark):
    m = metrics.Metric("f", "ts", "days", 3, where="TRUE", **metrics._median("x"))
    rows = [(f"e{k % 3}", T0 + timedelta(days=k % 60), None if k % 7 == 0 else float(k % 5)) for k in range(3000)]
    fact = spark.createDataFrame(rows, "e string, ts timestamp, x double")
    out = metrics.compute(fact, m, "e")
    keys = [F.col("e").alias("entity_id"), X.bucket_start(F.col("ts"), "month", metrics.ZONE).alias("period_start")]
    want = fact.groupBy(*keys).agg(F.median("x"), F.count("x").cast("double"), F.count("*").cast("double"), F.count("x"))
    assert {tuple(r) for r in want.collect()} == {tuple(r)[:6] for r in out.select("entity_id", "period_start", "value", "numerator", "denominator", "sample_size").collect()}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
