"""The canonical tables, built from the driver's tables, and the same as SQL.

=============  ====================================================================
incident       orders with their line items: opened, acknowledged (first shipment),
               resolved (last shipment), priority, state, cost, flags
change         returned line items: one change for each order and part
transition     events of the four known types as steps of a user's item
metric_daily   daily figures of each user from events
org            world, regions, nations
team, service  suppliers; nations with an owner
=============  ====================================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.functions import columns as X

EXCLUDED_STATES = ("canceled",)
MOST_RESOLVE_DAYS = 365
REPEAT_DAYS = 30


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def lineitem(self) -> DataFrame:
        return self.raw("lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))

    def orders(self) -> DataFrame:
        return self.raw("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))

    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def incident(self) -> DataFrame:
        lines = self.lineitem().groupBy("l_orderkey").agg(
            F.min("l_shipdate").alias("first_ship"),
            F.max("l_shipdate").alias("last_ship"),
            F.count("*").alias("n_lines"),
            F.count_if(F.col("l_returnflag") == "R").alias("n_returned"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("cost_usd"),
            F.sum("l_quantity").alias("quantity"),
            F.max("l_discount").alias("max_discount"),
        )
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        x = self.orders().join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
        state = X.lookup(F.col("o_orderstatus"), {"F": "resolved", "O": "open", "P": "canceled"}, "unknown")
        return x.select(
            F.col("o_orderkey").alias("record_id"),
            F.col("o_orderdate").alias("opened_at"),
            F.col("first_ship").alias("acknowledged_at"),
            F.when(F.col("o_orderstatus") != "O", F.col("last_ship")).alias("resolved_at"),
            X.lead_int(F.col("o_orderpriority"), 1, 5).alias("priority"),
            state.alias("state"),
            F.col("c_nationkey").cast("bigint").alias("service_id"),
            (F.col("o_custkey") % 40).alias("team_id"),
            (F.col("o_custkey") % 25).alias("cluster_id"),
            (F.coalesce("n_lines", F.lit(0)) - 1).alias("reassignments"),
            F.coalesce("n_returned", F.lit(0)).alias("reopens"),
            (F.col("max_discount") > 0.095).alias("sla_breached"),
            F.col("quantity").alias("business_minutes"),
            F.coalesce("cost_usd", F.lit(0).cast("decimal(18,2)")).alias("cost_usd"),
        )

    def incident_fact(self) -> DataFrame:
        i = self.incident()
        i = i.withColumn("excluded", F.col("state").isin(*EXCLUDED_STATES))
        i = i.withColumn("resolve_h", X.elapsed_hours(F.col("opened_at"), F.col("resolved_at"), MOST_RESOLVE_DAYS))
        i = i.withColumn("ack_m", F.when(F.col("acknowledged_at") >= F.col("opened_at"), (F.unix_timestamp("acknowledged_at") - F.unix_timestamp("opened_at")) / 60.0))
        from pyspark.sql import Window

        # keyed by cluster and service, so the window never holds more than one such group
        w = Window.partitionBy("excluded", "cluster_id", "service_id").orderBy("opened_at", "record_id")
        gap = F.unix_timestamp("opened_at") - F.unix_timestamp(F.lag("opened_at").over(w))
        return i.withColumn("is_repeat", F.coalesce((gap <= REPEAT_DAYS * 86400) & ~F.col("excluded") & F.col("service_id").isNotNull(), F.lit(False)))

    def change(self) -> DataFrame:
        o = self.orders().select("o_orderkey", "o_orderdate", "o_custkey", "o_orderpriority")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        x = self.lineitem().filter("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
        return x.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"),
            F.col("l_orderkey").alias("incident_id"),
            F.col("o_orderdate").alias("opened_at"),
            F.col("l_shipdate").alias("actual_end"),
            F.col("c_nationkey").cast("bigint").alias("service_id"),
            (F.col("o_custkey") % 40).alias("team_id"),
            F.when(F.col("o_orderpriority").startswith("1"), "emergency").otherwise("normal").alias("type"),
            (F.col("l_linestatus") == "F").alias("deployed"),
            (F.col("l_tax") > 0.06).alias("bad_outcome"),
        )

    def change_fact(self) -> DataFrame:
        c = self.change()
        return c.withColumn("failed", F.col("deployed") & F.col("bad_outcome")).withColumn("lead_h", X.elapsed_hours(F.col("opened_at"), F.col("actual_end"), MOST_RESOLVE_DAYS))

    def org(self) -> DataFrame:
        r = self.raw("region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("org_id"), F.lit("W").alias("parent_org_id"), F.col("r_name").alias("name"))
        n = self.raw("nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("org_id"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("parent_org_id"), F.col("n_name").alias("name"))
        w = self.spark.range(1).select(F.lit("W").alias("org_id"), F.lit(None).cast("string").alias("parent_org_id"), F.lit("world").alias("name"))
        return w.unionByName(r).unionByName(n)

    def transition(self) -> DataFrame:
        e = self.events()
        return e.select(F.col("user_id").alias("item_id"), F.col("ts").alias("at"), F.col("event_type").alias("category"), "event_id")


#: The same tables as common table expressions, for the SQL that checks the queries.
INCIDENT_SQL = f"""
lines AS (
  SELECT l_orderkey, min(l_shipdate) first_ship, max(l_shipdate) last_ship, count(*) n_lines,
    count(*) FILTER (WHERE l_returnflag = 'R') n_returned, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) cost_usd,
    sum(l_quantity) quantity, max(l_discount) max_discount
  FROM lineitem GROUP BY 1),
incident AS (
  SELECT o_orderkey record_id, o_orderdate opened_at, first_ship acknowledged_at,
    CASE WHEN o_orderstatus <> 'O' THEN last_ship END resolved_at,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) priority,
    CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' WHEN 'P' THEN 'canceled' ELSE 'unknown' END state,
    CAST(c_nationkey AS BIGINT) service_id, o_custkey % 40 team_id, o_custkey % 25 cluster_id,
    coalesce(n_lines, 0) - 1 reassignments, coalesce(n_returned, 0) reopens, max_discount > 0.095 sla_breached,
    quantity business_minutes, coalesce(cost_usd, 0) cost_usd
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey),
timed AS (
  SELECT *, state IN ('canceled') excluded, epoch(resolved_at) - epoch(opened_at) took FROM incident),
incident_fact AS (
  SELECT *, CASE WHEN took BETWEEN 0 AND {MOST_RESOLVE_DAYS} * 86400 THEN took / 3600.0 END resolve_h,
    CASE WHEN acknowledged_at >= opened_at THEN (epoch(acknowledged_at) - epoch(opened_at)) / 60.0 END ack_m,
    coalesce(epoch(opened_at) - epoch(lag(opened_at) OVER (PARTITION BY excluded, cluster_id, service_id ORDER BY opened_at, record_id)) <= {REPEAT_DAYS} * 86400
      AND NOT excluded AND service_id IS NOT NULL, false) is_repeat
  FROM timed)"""

CHANGE_SQL = f"""
change AS (
  SELECT l_orderkey * 10 + l_linenumber record_id, l_orderkey incident_id, o_orderdate opened_at, l_shipdate actual_end,
    CAST(c_nationkey AS BIGINT) service_id, o_custkey % 40 team_id,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'emergency' ELSE 'normal' END AS "type", l_linestatus = 'F' deployed, l_tax > 0.06 bad_outcome
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'R'),
change_fact AS (
  SELECT *, deployed AND bad_outcome AS failed,
    CASE WHEN epoch(actual_end) - epoch(opened_at) BETWEEN 0 AND {MOST_RESOLVE_DAYS} * 86400 THEN (epoch(actual_end) - epoch(opened_at)) / 3600.0 END lead_h
  FROM change)"""

ORG_SQL = """
org AS (
  SELECT 'W' org_id, CAST(NULL AS VARCHAR) parent_org_id, 'world' AS "name"
  UNION ALL SELECT 'R' || r_regionkey, 'W', r_name FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM nation),
closure AS (
  WITH RECURSIVE c AS (SELECT org_id, org_id ancestor, 0 depth FROM org
    UNION ALL SELECT c.org_id, o.parent_org_id, c.depth + 1 FROM c JOIN org o ON o.org_id = c.ancestor WHERE o.parent_org_id IS NOT NULL AND c.depth < 20)
  SELECT org_id, ancestor, min(depth) depth FROM c GROUP BY 1, 2)"""

EVENT_SQL = """
event_fact AS (
  SELECT event_id, ts, user_id service_id, event_type, "value", event_type IN ('view', 'click') noisy, event_id % 3 = 0 linked FROM events),
item_fact AS (
  SELECT record_id, team_id, service_id, opened_at, acknowledged_at, CASE WHEN resolved_at >= opened_at THEN resolved_at END done_at,
    CASE WHEN resolved_at >= opened_at THEN (epoch(resolved_at) - epoch(opened_at)) / 86400.0 END cycle_days, priority = 1 unplanned, reassignments + 1 points
  FROM incident_fact WHERE NOT excluded),
daily_fact AS (
  SELECT user_id service_id, date_trunc('day', ts) ts, avg("value") AS "value", CASE WHEN user_id % 4 <> 0 THEN CAST(count(*) AS DOUBLE) END requests, CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) errors
  FROM events GROUP BY user_id, date_trunc('day', ts))"""


def event_fact(t: Tables) -> DataFrame:
    e = t.events()
    return e.select("event_id", "ts", F.col("user_id").alias("service_id"), "event_type", "value", F.col("event_type").isin("view", "click").alias("noisy"), (F.col("event_id") % 3 == 0).alias("linked"))


def item_fact(t: Tables) -> DataFrame:
    done = F.when(F.col("resolved_at") >= F.col("opened_at"), F.col("resolved_at"))
    i = t.incident_fact().filter("NOT excluded").withColumn("done_at", done)
    return i.select("record_id", "team_id", "service_id", "opened_at", "acknowledged_at", "done_at", ((F.unix_timestamp("done_at") - F.unix_timestamp("opened_at")) / 86400.0).alias("cycle_days"), (F.col("priority") == 1).alias("unplanned"), (F.col("reassignments") + 1).alias("points"))


def daily_fact(t: Tables) -> DataFrame:
    g = t.events().groupBy(F.col("user_id").alias("service_id"), F.date_trunc("day", "ts").alias("ts"))
    return g.agg(F.avg("value").alias("value"), F.when(F.col("service_id") % 4 != 0, F.count("*").cast("double")).alias("requests"), F.count_if(F.col("event_type") == "error").cast("double").alias("errors"))


def fact(t: Tables, name: str) -> DataFrame:
    return {"incident_fact": t.incident_fact, "change_fact": t.change_fact, "event_fact": lambda: event_fact(t), "item_fact": lambda: item_fact(t), "daily_fact": lambda: daily_fact(t)}[name]()


FACTS_SQL = {
    "incident_fact": INCIDENT_SQL,
    "change_fact": CHANGE_SQL,
    "event_fact": EVENT_SQL[: EVENT_SQL.index("item_fact AS")].rstrip().rstrip(","),
    "item_fact": INCIDENT_SQL + "," + EVENT_SQL[EVENT_SQL.index("item_fact AS") : EVENT_SQL.index("daily_fact AS")].rstrip().rstrip(","),
    "daily_fact": EVENT_SQL[EVENT_SQL.index("daily_fact AS") :],
}
