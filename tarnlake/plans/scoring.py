"""Snapshots of work, outcome statistics, decisions and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import columns as X
from tarnlake.operators import joins as J
from tarnlake.plans.adapter import FACTS_SQL, INCIDENT_SQL, Tables, item_fact
from tarnlake.plans.relational import query

AS_OF = "2001-12-01"


# -- snapshots: an item is repeated for the month starts it spans, never crossed with all --
def _at_month_starts(items: DataFrame, since: str, until: str) -> DataFrame:
    """Items with each month start s where since <= s < until (no end: up to AS_OF)."""
    end = F.least(F.coalesce(F.col(until), F.lit(AS_OF).cast("timestamp")), F.lit(AS_OF).cast("timestamp"))
    first = F.add_months(F.trunc(since, "month"), 1).cast("timestamp")
    first = F.when(F.date_trunc("month", since) == F.col(since), F.date_trunc("month", since)).otherwise(first)
    span = F.when(first <= end, F.sequence(first, end, F.expr("interval 1 month"))).otherwise(F.array().cast("array<timestamp>"))
    return items.filter(F.col(since).isNotNull()).withColumn("s", F.explode(span)).filter(F.col(until).isNull() | (F.col("s") < F.col(until)))


MONTHS_SQL = f"months AS (SELECT unnest(range(TIMESTAMP '1995-01-01', TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY, INTERVAL 1 MONTH)) s)"


@query(f"""WITH {FACTS_SQL['item_fact']}, {MONTHS_SQL} SELECT team_id, CAST(s AS DATE) AS snapshot, count(*) wip FROM item_fact JOIN months ON acknowledged_at <= s AND (done_at IS NULL OR done_at > s) AND acknowledged_at IS NOT NULL GROUP BY 1, 2""")
def m24_wip_count(t: Tables) -> DataFrame:
    return _at_month_starts(item_fact(t), "acknowledged_at", "done_at").groupBy("team_id", F.to_date("s").alias("snapshot")).agg(F.count("*").alias("wip"))


@query(f"""WITH {FACTS_SQL['item_fact']}, {MONTHS_SQL} SELECT team_id, CAST(s AS DATE) AS snapshot, round(median((epoch(s) - epoch(opened_at)) / 86400.0), 6) age_days, count(*) n
FROM item_fact JOIN months ON opened_at <= s AND (acknowledged_at IS NULL OR acknowledged_at > s) GROUP BY 1, 2""")
def m23_backlog_age_days(t: Tables) -> DataFrame:
    x = _at_month_starts(item_fact(t), "opened_at", "acknowledged_at")
    age = (F.unix_timestamp("s") - F.unix_timestamp("opened_at")) / 86400.0
    return x.groupBy("team_id", F.to_date("s").alias("snapshot")).agg(F.round(F.median(age), 6).alias("age_days"), F.count("*").alias("n"))


@query(f"""WITH {FACTS_SQL['item_fact']}, {MONTHS_SQL} SELECT team_id, CAST(s AS DATE) AS snapshot, round(CAST(count(*) FILTER (WHERE done_at IS NULL OR done_at > s + INTERVAL 1 MONTH) AS DOUBLE) / count(*), 9) carryover, count(*) n
FROM item_fact JOIN months ON acknowledged_at <= s AND (done_at IS NULL OR done_at > s) GROUP BY 1, 2""")
def m22_carryover_rate(t: Tables) -> DataFrame:
    x = _at_month_starts(item_fact(t), "acknowledged_at", "done_at")
    late = F.col("done_at").isNull() | (F.col("done_at") > F.col("s") + F.expr("interval 1 month"))
    return x.groupBy("team_id", F.to_date("s").alias("snapshot")).agg(F.round(F.count_if(late) / F.count("*"), 9).alias("carryover"), F.count("*").alias("n"))


@query(f"""WITH {INCIDENT_SQL} SELECT cluster_id AS epic, CAST(sum(reassignments + 1) AS BIGINT) committed, CAST(coalesce(sum(reassignments + 1) FILTER (WHERE state = 'resolved'), 0) AS BIGINT) done,
round(CAST(coalesce(sum(reassignments + 1) FILTER (WHERE state = 'resolved'), 0) AS DOUBLE) / nullif(sum(reassignments + 1), 0), 9) ratio FROM incident_fact WHERE NOT excluded GROUP BY 1""")
def m26_epic_predictability(t: Tables) -> DataFrame:
    pts = F.col("reassignments") + 1
    done = F.coalesce(F.sum(F.when(F.col("state") == "resolved", pts)), F.lit(0))
    return t.incident_fact().filter("NOT excluded").groupBy(F.col("cluster_id").alias("epic")).agg(F.sum(pts).alias("committed"), done.alias("done"), F.round(F.try_divide(done.cast("double"), F.sum(pts)), 9).alias("ratio"))


@query("""WITH d AS (SELECT event_type, "value" v, ts >= TIMESTAMP '2024-01-16' AS late, user_id % 2 = 0 treated FROM events), g AS (SELECT event_type, treated, avg(v) FILTER (WHERE late) - avg(v) FILTER (WHERE NOT late) diff FROM d GROUP BY 1, 2)
SELECT event_type, round(max(diff) FILTER (WHERE treated) - max(diff) FILTER (WHERE NOT treated), 6) did FROM g GROUP BY 1""")
def difference_in_differences(t: Tables) -> DataFrame:
    late, v = F.col("ts") >= F.lit("2024-01-16").cast("timestamp"), F.col("value")
    g = t.events().groupBy("event_type", (F.col("user_id") % 2 == 0).alias("treated")).agg((F.avg(F.when(late, v)) - F.avg(F.when(~late, v))).alias("diff"))
    return g.groupBy("event_type").agg(F.round(F.max(F.when(F.col("treated"), F.col("diff"))) - F.max(F.when(~F.col("treated"), F.col("diff"))), 6).alias("did"))


# -- decisions ----------------------------------------------------------------
@query("""WITH c AS (SELECT user_id, event_type AS question, event_id, "value", 1 / (1 + exp(-ln(p / (1 - p)) / 2.0)) p, CASE WHEN event_id % 11 = 0 THEN 1 WHEN p > 0.2 THEN 2 ELSE 3 + event_id % 3 END pos FROM (SELECT *, least(greatest("value" / 500, 1e-6), 1 - 1e-6) p FROM events)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, question ORDER BY pos, p DESC, event_id) k FROM c)
SELECT user_id, question, event_id AS answer, round(p, 9) probability, CASE WHEN pos <= 2 THEN 'final' ELSE 'queue' END AS status FROM r WHERE k = 1""")
def decision_resolution(t: Tables) -> DataFrame:
    raw = F.least(F.greatest(F.col("value") / 500, F.lit(1e-6)), F.lit(1 - 1e-6))
    e = t.raw("events").withColumn("raw", raw).withColumn("p", X.scaled_sigmoid(F.col("raw"), F.lit(2.0)))
    pos = F.when(F.col("event_id") % 11 == 0, 1).when(F.col("raw") > 0.2, 2).otherwise(3 + F.col("event_id") % 3)
    best = J.best_by(e.withColumn("pos", pos), ["user_id", "event_type"], F.asc("pos"), F.desc("p"), F.asc("event_id"))
    return best.select("user_id", F.col("event_type").alias("question"), F.col("event_id").alias("answer"), F.round("p", 9).alias("probability"), F.when(F.col("pos") <= 2, "final").otherwise("queue").alias("status"))


@query("""WITH c AS (SELECT lang, source, count(*) n FROM documents GROUP BY 1, 2), t AS (SELECT lang, sum(n) total FROM c GROUP BY 1), r AS (SELECT lang, source, n, total, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) k FROM c JOIN t USING (lang))
SELECT lang, CAST(max(total) AS BIGINT) AS size, string_agg(source, ',' ORDER BY k) FILTER (WHERE k <= 5 AND n >= 0.05 * total) AS sources FROM r GROUP BY 1""")
def cluster_description(t: Tables) -> DataFrame:
    c = t.raw("documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    total = c.groupBy("lang").agg(F.sum("n").alias("size"))
    top = J.top_n(c, ["lang"], 5, F.desc("n"), F.asc("source")).join(total, "lang").filter(F.col("n") >= 0.05 * F.col("size"))
    named = top.groupBy("lang").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]), ",").alias("sources"))
    return total.join(named, "lang", "left").select("lang", "size", "sources")
