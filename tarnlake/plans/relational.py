"""Relational queries: each a use of the library's operators, with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tarnlake.functions import columns as X
from tarnlake.operators import aggregates as A
from tarnlake.operators import joins as J
from tarnlake.operators import ranks as R
from tarnlake.operators import vectors as V
from tarnlake.operators.concordance import kendall_tau as kendall
from tarnlake.plans.adapter import CHANGE_SQL, INCIDENT_SQL, ORG_SQL, Tables
from tarnlake.sources import lake

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- lake ---------------------------------------------------------------------
VERSIONS_SQL = """versions AS (SELECT user_id, ts, event_id, event_type, "value", event_type = 'error' AS gone FROM events)"""


def _versions(t: Tables) -> DataFrame:
    return t.events().select("user_id", "ts", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("gone"))


@query(f"""WITH {VERSIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) k FROM versions)
SELECT user_id, event_id, event_type, "value" FROM r WHERE k = 1 AND NOT gone AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)""")
def latest_version(t: Tables) -> DataFrame:
    deleted = t.raw("customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("user_id"))
    return lake.latest(_versions(t), deleted, key="user_id", deleted="gone", order=("ts", "event_id")).select("user_id", "event_id", "event_type", "value")


@query(f"""WITH {VERSIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) k FROM versions)
SELECT user_id, event_id, true AS gone FROM r WHERE k = 1 AND NOT gone AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 8 <> 5)""")
def reconcile_missing_keys(t: Tables) -> DataFrame:
    """Live records whose key the source no longer lists, as tombstones."""
    v = _versions(t).select(F.col("user_id").alias("_source_key"), F.col("user_id").alias("_record_id"), F.col("ts").alias("_source_updated_at"), F.col("ts").alias("_fetched_at"), F.col("event_id").alias("_file"), F.col("gone").alias("_deleted"))
    keys = t.raw("customer").filter("c_custkey % 8 <> 5").select(F.col("c_custkey").alias("_source_key"))
    return lake.reconcile(v, keys, most_share=0.5).select(F.col("_source_key").alias("user_id"), F.col("_file").alias("event_id"), F.col("_deleted").alias("gone"))


@query("""WITH x AS (SELECT p_type, p_brand, TRY_CAST(substr(p_brand, 7) AS BIGINT) brand_no, TRY_CAST(p_type AS BIGINT) type_no FROM part)
SELECT 'part' AS table_name, 'brand' AS column_name, count(*) n_rows, count(p_brand) n_present, count(*) FILTER (WHERE brand_no IS NULL AND p_brand IS NOT NULL) n_failed FROM x
UNION ALL SELECT 'part', 'type', count(*), count(p_type), count(*) FILTER (WHERE type_no IS NULL AND p_type IS NOT NULL) FROM x""")
def cast_statistics(t: Tables) -> DataFrame:
    raw = t.raw("part").select(F.substring("p_brand", 7, 20).alias("brand"), F.col("p_type").alias("type"))
    typed = lake.typed(raw, {"brand": F.col("brand").try_cast("bigint"), "type": F.col("type").try_cast("bigint")})
    return lake.cast_statistics(typed, "part", ["brand", "type"])


# -- functions ----------------------------------------------------------------
@query("""SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) priority, CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders""")
def enum_and_leading_integer(t: Tables) -> DataFrame:
    return t.raw("orders").select("o_orderkey", X.lead_int(F.col("o_orderpriority"), 1, 5).alias("priority"), X.lookup(F.col("o_orderstatus"), {"F": "resolved", "O": "open"}, "other").alias("state"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events""")
def json_properties(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("""SELECT doc_id, substr(sha256(coalesce(source, '') || chr(10) || coalesce("text", '')), 1, 32) AS content_hash FROM documents""")
def content_hash(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", X.content_hash(F.col("source"), F.col("text")).alias("content_hash"))


@query("""SELECT o_orderkey, CAST(date_trunc('week', timezone('Europe/Berlin', timezone('UTC', o_orderdate))) AS DATE) week_start,
CAST(date_trunc('quarter', timezone('Europe/Berlin', timezone('UTC', o_orderdate))) AS DATE) quarter_start FROM orders""")
def local_periods(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders().select("o_orderkey", X.bucket_start(d, "week", "Europe/Berlin").alias("week_start"), X.bucket_start(d, "quarter", "Europe/Berlin").alias("quarter_start"))


@query("""SELECT event_id, date_diff('day', TIMESTAMP '2024-01-01 12:00:00', ts) AS days, date_diff('hour', TIMESTAMP '2024-01-01 12:00:00', ts) AS hours FROM events""")
def date_boundaries(t: Tables) -> DataFrame:
    noon = F.lit("2024-01-01 12:00:00").cast("timestamp")
    return t.events().select("event_id", X.boundaries(noon, F.col("ts"), 86400).alias("days"), X.boundaries(noon, F.col("ts"), 3600).alias("hours"))


@query("""SELECT doc_id, len(regexp_extract_all("text", '[A-Za-z]+ing')) n_ing, regexp_extract("text", '([A-Za-z]+)[.]', 1) AS first_end FROM documents""")
def regex_extraction(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+ing"), 0)).cast("bigint").alias("n_ing"), F.regexp_extract("text", "([A-Za-z]+)[.]", 1).alias("first_end"))


@query("""SELECT event_id, round(1 / (1 + exp(-ln(p / (1 - p)) / 1.5)), 9) calibrated FROM (SELECT event_id, least(greatest("value" / 500, 1e-6), 1 - 1e-6) p FROM events)""")
def temperature_scaling(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.round(X.scaled_sigmoid(F.col("value") / 500, F.lit(1.5)), 9).alias("calibrated"))


# -- joins --------------------------------------------------------------------
@query(f"""WITH {ORG_SQL} SELECT org_id, ancestor, depth FROM closure""")
def org_closure(t: Tables) -> DataFrame:
    return J.closure(t.org(), "org_id", "parent_org_id")


@query(f"""WITH {ORG_SQL} SELECT ancestor, count(*) n_suppliers, round(sum(s_acctbal), 2) balance FROM supplier JOIN closure ON org_id = 'N' || s_nationkey GROUP BY 1""")
def closure_rollup(t: Tables) -> DataFrame:
    c = J.closure(t.org(), "org_id", "parent_org_id")
    s = t.raw("supplier").withColumn("org_id", F.concat(F.lit("N"), "s_nationkey"))
    return s.join(F.broadcast(c), "org_id").groupBy("ancestor").agg(F.count("*").alias("n_suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@query("""WITH probe AS (SELECT DISTINCT user_id, d AS probe_at FROM events, (SELECT unnest([TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-15', TIMESTAMP '2024-01-25']) d)),
x AS (SELECT p.user_id, p.probe_at, e.event_type, row_number() OVER (PARTITION BY p.user_id, p.probe_at ORDER BY e.ts DESC, e.event_id DESC) k FROM probe p LEFT JOIN events e ON e.user_id = p.user_id AND e.ts <= p.probe_at)
SELECT user_id, probe_at, event_type AS category FROM x WHERE k = 1""")
def as_of_category(t: Tables) -> DataFrame:
    days = F.explode(F.array(*[F.lit(f"2024-01-{d}").cast("timestamp") for d in ("05", "15", "25")]))
    probe = t.events().select("user_id").distinct().withColumn("probe_at", days)
    trans = t.transition().withColumnRenamed("item_id", "user_id").withColumnRenamed("at", "since")
    return J.as_of(probe, trans, "user_id", "probe_at", "since", ["category"], rank="event_id")


@query(f"""WITH {INCIDENT_SQL}, {CHANGE_SQL} SELECT i.record_id incident_id, c.record_id change_id FROM incident i JOIN change c ON c.service_id = i.service_id
AND i.opened_at >= c.actual_end - INTERVAL 1 HOUR AND i.opened_at <= c.actual_end + INTERVAL 6 HOUR WHERE c.deployed AND c.type = 'emergency'""")
def interval_join(t: Tables) -> DataFrame:
    hours = lambda n: F.expr(f"actual_end + INTERVAL {n} HOURS")
    spans = t.change().filter("deployed AND type = 'emergency'").select("service_id", F.col("record_id").alias("change_id"), hours(-1).alias("begin"), hours(6).alias("until"))
    points = t.incident().select("service_id", F.col("record_id").alias("incident_id"), "opened_at")
    return J.interval(points, spans, "service_id", "opened_at", "begin", "until", 3 * 3600).select("incident_id", "change_id")


@query("""SELECT s_suppkey, c_custkey, CASE WHEN s_nationkey = c_nationkey THEN 0 ELSE 1 END matched FROM supplier, customer
WHERE s_nationkey = c_nationkey OR s_suppkey = c_custkey""")
def either_key_join(t: Tables) -> DataFrame:
    s = t.raw("supplier").select("s_suppkey", "s_nationkey")
    c = t.raw("customer").select("c_custkey", "c_nationkey")
    return J.either_key(s, c, [("s_nationkey", "c_nationkey"), ("s_suppkey", "c_custkey")]).select("s_suppkey", "c_custkey", "matched")


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)""")
def anti_join_idle_customers(t: Tables) -> DataFrame:
    """Customers without a large order; a null key would make NOT IN hold for nobody, so nulls go first."""
    o = t.raw("orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).filter("c_custkey IS NOT NULL")
    return t.raw("customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def semi_join_large_buyers(t: Tables) -> DataFrame:
    o = t.raw("orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t.raw("customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("""WITH r AS (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) k FROM supplier)
SELECT n_nationkey, n_name, s_suppkey AS owner FROM nation LEFT JOIN r ON s_nationkey = n_nationkey AND k = 1""")
def best_owner(t: Tables) -> DataFrame:
    s = J.best_by(t.raw("supplier"), ["s_nationkey"], F.desc("s_acctbal"), F.asc("s_suppkey"))
    return t.raw("nation").join(F.broadcast(s), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", "n_name", F.col("s_suppkey").alias("owner"))


@query("""SELECT lower(trim(p_type || ' ' || p_size)) AS name, min(p_partkey) p_partkey FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1""")
def unique_names(t: Tables) -> DataFrame:
    return J.only_owner(t.raw("part").select(F.concat_ws(" ", "p_type", "p_size").alias("name"), "p_partkey"), "name", "p_partkey")


@query("""WITH o AS (SELECT o_custkey, list(DISTINCT o_orderpriority) ps FROM orders GROUP BY 1)
SELECT o_custkey FROM o WHERE list_has_any(ps, ['1-URGENT', '2-HIGH']) AND NOT list_contains(ps, '5-LOW')""")
def array_overlap(t: Tables) -> DataFrame:
    o = t.raw("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("ps"))
    return o.filter(F.arrays_overlap("ps", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))) & ~F.coalesce(F.array_contains("ps", "5-LOW"), F.lit(False))).select("o_custkey")


@query("""SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') n_returned, (SELECT max(l_discount) FROM lineitem WHERE l_suppkey = s_suppkey) most FROM supplier""")
def correlated_scalars(t: Tables) -> DataFrame:
    g = t.raw("lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n"), F.max("l_discount").alias("most"))
    return t.raw("supplier").join(g, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("s_suppkey", F.coalesce("n", F.lit(0)).alias("n_returned"), "most")


@query("""SELECT n_name, r_name, count(*) n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def dimension_joins(t: Tables) -> DataFrame:
    c = t.raw("customer").groupBy("c_nationkey").count()
    n = t.raw("nation").join(F.broadcast(t.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.sum("count").alias("n"))


# -- aggregates and windows ---------------------------------------------------
@query("""SELECT s_nationkey, round(sum(s_acctbal), 4) total, round(avg(s_acctbal), 4) mean FROM supplier GROUP BY 1""")
def ordered_sums(t: Tables) -> DataFrame:
    return t.raw("supplier").groupBy("s_nationkey").agg(F.round(A.ordered_sum(F.col("s_acctbal")), 4).alias("total"), F.round(A.ordered_avg(F.col("s_acctbal")), 4).alias("mean"))


@query("""SELECT l_returnflag, l_linestatus, median(l_extendedprice) med, round(quantile_cont(l_extendedprice, 0.25), 6) q1, round(quantile_cont(l_extendedprice, 0.75), 6) q3 FROM lineitem GROUP BY 1, 2""")
def medians_and_quartiles(t: Tables) -> DataFrame:
    p = lambda q: F.round(F.percentile("l_extendedprice", F.lit(q)), 6)
    return t.raw("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.median("l_extendedprice").alias("med"), p(0.25).alias("q1"), p(0.75).alias("q3"))


@query("""WITH m AS (SELECT c_nationkey, median(c_acctbal) median FROM customer GROUP BY 1), d AS (SELECT c.*, m.median, abs(c_acctbal - m.median) d FROM customer c JOIN m USING (c_nationkey)),
s AS (SELECT c_nationkey, median(d) mad, avg(d) mean_dev FROM d GROUP BY 1)
SELECT c_custkey, round(CASE WHEN mad > 0 THEN (c_acctbal - median) / (1.4826 * mad) WHEN mean_dev > 0 THEN (c_acctbal - median) / (1.2533 * mean_dev) ELSE 0 END, 8) z FROM d JOIN s USING (c_nationkey)""")
def robust_z(t: Tables) -> DataFrame:
    return A.robust_scale(t.raw("customer"), ["c_nationkey"], "c_acctbal").select("c_custkey", F.round("z", 8).alias("z"))


@query("""WITH w AS (SELECT event_type, date_diff('week', DATE '2024-01-01', CAST(ts AS DATE)) * 7 + dayofweek(ts) x, sum("value") y FROM events GROUP BY ALL),
p AS (SELECT a.event_type, (b.y - a.y) / (b.x - a.x) s FROM w a JOIN w b ON a.event_type = b.event_type AND b.x > a.x) SELECT event_type, round(median(s), 6) slope FROM p GROUP BY 1""")
def theil_sen_trend(t: Tables) -> DataFrame:
    x = (X.boundaries(F.lit("2024-01-01").cast("timestamp"), F.date_trunc("week", "ts"), 7 * 86400) * 7 + F.dayofweek("ts") - 1).alias("x")
    w = t.events().groupBy("event_type", x).agg(F.sum("value").alias("y"))
    return A.theil_sen(w, ["event_type"], "x", "y", least=6).select("event_type", F.round("slope", 6).alias("slope"))


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) top_order, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority FROM orders GROUP BY 1""")
def arg_min_and_max(t: Tables) -> DataFrame:
    return t.raw("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("top_order"), F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("first_priority"))


@query("""SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations, count(*) n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def ordered_lists(t: Tables) -> DataFrame:
    j = t.raw("nation").join(F.broadcast(t.raw("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"), F.count("*").alias("n"))


@query("""SELECT user_id, max("value") FILTER (WHERE event_type = 'view') AS view, max("value") FILTER (WHERE event_type = 'click') AS click, max("value") FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1""")
def pivot_wide(t: Tables) -> DataFrame:
    return t.raw("events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.max("value"))


@query("""SELECT l_suppkey, CASE WHEN bool_and(l_quantity > 1) THEN round(sum(l_discount * l_quantity) / sum(l_quantity), 9) ELSE round(avg(l_discount), 9) END ratio FROM lineitem GROUP BY 1""")
def guarded_weighted_ratio(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.raw("lineitem").groupBy("l_suppkey").agg(F.round(F.when(F.bool_and(q > 1), F.sum(F.col("l_discount") * q) / F.sum(q)).otherwise(F.avg("l_discount")), 9).alias("ratio"))


@query(f"""WITH {INCIDENT_SQL} SELECT record_id, is_repeat FROM incident_fact WHERE NOT excluded""")
def repeat_within_30_days(t: Tables) -> DataFrame:
    return t.incident_fact().filter("NOT excluded").select("record_id", "is_repeat")


@query("""WITH x AS (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN round(s_acctbal / 10) END v, s_suppkey % 9 = 0 AS hot FROM supplier), r AS (SELECT *, CASE WHEN v IS NOT NULL THEN percent_rank() OVER (PARTITION BY v IS NULL ORDER BY v) END pr FROM x),
f AS (SELECT *, CASE WHEN pr IS NULL THEN NULL WHEN pr <= 0.15 THEN 1 WHEN pr <= 0.30 THEN 2 WHEN pr <= 0.45 THEN 3 WHEN pr <= 0.60 THEN 5 WHEN pr <= 0.75 THEN 8 WHEN pr <= 0.90 THEN 13 ELSE 20 END fib FROM r)
SELECT s_suppkey, round(pr, 9) AS share, fib AS bucket, CASE WHEN NOT hot THEN fib ELSE CASE fib WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 5 WHEN 5 THEN 8 WHEN 8 THEN 13 WHEN 13 THEN 20 WHEN 20 THEN 20 END END AS bumped FROM f""")
def percent_rank_buckets(t: Tables) -> DataFrame:
    v = F.when(F.col("s_acctbal") > 0, F.round(F.col("s_acctbal") / 10))
    r = R.percent_rank(t.raw("supplier").select("s_suppkey", v.alias("v")), "v", "pr")
    return r.select("s_suppkey", F.round("pr", 9).alias("share"), X.fibonacci_bucket(F.col("pr")).alias("bucket"), X.fibonacci_bucket(F.col("pr"), F.col("s_suppkey") % 9 == 0).alias("bumped"))


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS "rank" FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, "rank" FROM r WHERE "rank" <= 3""")
def top_n_per_group(t: Tables) -> DataFrame:
    top = J.top_n(t.raw("lineitem"), ["l_suppkey"], 3, F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"))
    return top.select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("""SELECT c_custkey, sha256('night' || c_custkey) AS sample_key FROM customer ORDER BY sample_key, c_custkey LIMIT 50""")
def hash_sample(t: Tables) -> DataFrame:
    return A.hash_sample(t.raw("customer").select("c_custkey"), "c_custkey", "night", 50)


@query("""WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) n FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, c_nationkey) k FROM c)
SELECT c_mktsegment, c_nationkey, n FROM r WHERE k = 1""")
def majority_by_group(t: Tables) -> DataFrame:
    c = t.raw("customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return J.best_by(c, ["c_mktsegment"], F.desc("n"), F.asc("c_nationkey"))


@query(f"""WITH {CHANGE_SQL}, pairs AS (SELECT record_id, incident_id FROM change_fact WHERE failed UNION SELECT record_id, incident_id FROM change_fact WHERE "type" = 'emergency')
SELECT record_id, count(DISTINCT incident_id) n FROM pairs GROUP BY 1""")
def distinct_cause_pairs(t: Tables) -> DataFrame:
    c = t.change_fact()
    p = c.filter("failed").select("record_id", "incident_id").union(c.filter("type = 'emergency'").select("record_id", "incident_id")).distinct()
    return p.groupBy("record_id").agg(F.count("*").alias("n"))


@query("""SELECT c_mktsegment, c_nationkey, count(*) n, round(sum(c_acctbal), 2) balance FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())""")
def grouping_sets(t: Tables) -> DataFrame:
    t.raw("customer").createOrReplaceTempView("tarnlake_customer")
    return t.spark.sql("SELECT c_mktsegment, c_nationkey, count(*) n, round(sum(c_acctbal), 2) balance FROM tarnlake_customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")


@query("""SELECT DISTINCT n_regionkey k FROM nation WHERE n_regionkey < 3 INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey > 0""")
def set_operations(t: Tables) -> DataFrame:
    return t.raw("nation").filter("n_regionkey < 3").select(F.col("n_regionkey").alias("k")).intersect(t.raw("region").filter("r_regionkey > 0").select("r_regionkey"))


@query("""SELECT 'customer' AS table_name, 'c_custkey' AS key_name, count(*) - count(DISTINCT c_custkey) n FROM customer
UNION ALL SELECT 'lineitem', 'l_orderkey,l_linenumber', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem UNION ALL SELECT 'documents', 'text', count(*) - count(DISTINCT "text") FROM documents""")
def duplicate_keys(t: Tables) -> DataFrame:
    one = lambda name, *cols: t.raw(name).agg((F.count("*") - F.count_distinct(F.struct(*cols))).alias("n")).select(F.lit(name).alias("table_name"), F.lit(",".join(cols)).alias("key_name"), "n")
    return one("customer", "c_custkey").unionByName(one("lineitem", "l_orderkey", "l_linenumber")).unionByName(one("documents", "text"))


@query("""WITH p AS (SELECT event_id, "value" / 500 p, CAST("value" > 100 AS INTEGER) y FROM events), b AS (SELECT p, y, ntile(15) OVER (ORDER BY p, event_id) b FROM p)
SELECT round(sum(abs(a) * n) / sum(n), 9) ece FROM (SELECT b, avg(p) - avg(y) a, count(*) n FROM b GROUP BY 1)""")
def calibration_error(t: Tables) -> DataFrame:
    p = t.raw("events").select("event_id", (F.col("value") / 500).alias("p"), (F.col("value") > 100).cast("int").alias("y"))
    g = R.ntile(p, [F.asc("p"), F.asc("event_id")], 15, "b").groupBy("b").agg((F.avg("p") - F.avg("y")).alias("a"), F.count("*").alias("n"))
    return g.agg(F.round(F.sum(F.abs("a") * F.col("n")) / F.sum("n"), 9).alias("ece"))


@query("""WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) m, count(*) c FROM embeddings, (SELECT unnest(range(1, 65)) i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) n, max(c) AS size FROM m GROUP BY 1)
SELECT label, size, array_to_string(list(CAST(CAST(round(m / n * 1000) AS BIGINT) AS VARCHAR) ORDER BY i), ',') AS centroid FROM m JOIN n USING (label) GROUP BY 1, 2""")
def centroids(t: Tables) -> DataFrame:
    c = V.centroids(t.raw("embeddings"), "label", "embedding")
    return c.select("label", "size", F.array_join(F.transform("centroid", lambda x: F.round(x * 1000).cast("bigint").cast("string")), ",").alias("centroid"))


_COSINE_SQL = "list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(e[i] AS DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) * list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * x)))"


@query(f"""WITH q AS (SELECT vec_id q_id, embedding e FROM embeddings WHERE vec_id IN (0, 7)), r AS (SELECT q_id, vec_id, round({_COSINE_SQL}, 6) score FROM embeddings, q WHERE vec_id <> q_id AND label <> 3)
SELECT q_id, vec_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS "rank" FROM r QUALIFY "rank" <= 10""")
def cosine_top_k(t: Tables) -> DataFrame:
    """Nearest by cosine of a few queries among the rows that pass a filter."""
    q = t.raw("embeddings").filter("vec_id in (0, 7)").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("e"))
    return V.cosine_top_k(t.raw("embeddings").filter("label <> 3"), "vec_id", "embedding", q, "q_id", "e", 10)


@query("""SELECT l.quality, l.toxic, count(*) n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2""")
def confusion_counts(t: Tables) -> DataFrame:
    return t.raw("labels").join(t.raw("documents").select("doc_id"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT s_suppkey k, s_acctbal x, s_nationkey y FROM supplier), p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) s, a.x = b.x tx, a.y = b.y ty FROM a JOIN a b ON a.k < b.k)
SELECT round(sum(s) / sqrt(CAST(count(*) FILTER (WHERE NOT tx) AS DOUBLE) * count(*) FILTER (WHERE NOT ty)), 9) tau FROM p""")
def kendall_tau(t: Tables) -> DataFrame:
    return _tau(t.raw("supplier"), "s_acctbal", "s_nationkey")


def _tau(df: DataFrame, x: str, y: str) -> DataFrame:
    tau = kendall(df, x, y)
    return df.sparkSession.createDataFrame([(None if tau is None else round(tau, 9),)], "tau double")


@query("""WITH a AS (SELECT o_orderkey k, o_totalprice x, o_orderdate y FROM orders), p AS (SELECT sign(a.x - b.x) * CASE WHEN a.y > b.y THEN 1 WHEN a.y < b.y THEN -1 ELSE 0 END s, a.x = b.x tx, a.y = b.y ty FROM a JOIN a b ON a.k < b.k)
SELECT round(sum(s) / sqrt(CAST(count(*) FILTER (WHERE NOT tx) AS DOUBLE) * count(*) FILTER (WHERE NOT ty)), 9) tau FROM p""")
def kendall_tau_orders(t: Tables) -> DataFrame:
    """Over facts: no pair is made."""
    return _tau(t.raw("orders"), "o_totalprice", "o_orderdate")


@query("""WITH t AS (SELECT lang, doc_id, w FROM (SELECT lang, doc_id, unnest(regexp_extract_all(lower("text"), '[a-z]{4,}')) w FROM documents WHERE lang IS NOT NULL)), tf AS (SELECT lang, w, count(*) tf FROM t GROUP BY 1, 2),
df AS (SELECT w, count(*) df FROM tf GROUP BY 1), r AS (SELECT lang, w, round(tf * (ln((1 + 4) / CAST(1 + df AS DOUBLE)) + 1), 9) score FROM tf JOIN df USING (w)), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, w) AS "rank" FROM r) SELECT lang, w AS term, score, "rank" FROM k WHERE "rank" <= 10""")
def class_terms(t: Tables) -> DataFrame:
    w = t.raw("documents").filter("lang IS NOT NULL").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("term"))
    tf = w.groupBy("lang", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    s = tf.join(df, "term").select("lang", "term", F.round(F.col("tf") * (F.log(5 / (1 + F.col("df"))) + 1), 9).alias("score"))
    return J.top_n(s, ["lang"], 10, F.desc("score"), F.asc("term"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 100 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25""")
def keyset_page(t: Tables) -> DataFrame:
    t.raw("orders").createOrReplaceTempView("tarnlake_orders")
    sql = "SELECT o_orderkey, o_totalprice FROM tarnlake_orders WHERE o_orderkey > :after AND (:status IS NULL OR o_orderstatus = :status) ORDER BY o_orderkey LIMIT 25"
    return t.spark.sql(sql, args={"after": 100, "status": "F"})


@query("""SELECT json_extract_string(props, '$.k') AS k, count(*) n FROM events GROUP BY 1""")
def count_by_json_key(t: Tables) -> DataFrame:
    return t.raw("events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) n FROM events GROUP BY 1, 2""")
def tumbling_windows(t: Tables) -> DataFrame:
    from tarnlake.streaming.merge import windowed_counts

    return windowed_counts(t.events(), "ts", "1 hour", "1 hour", ["event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN date_diff('second', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) <= 7200 THEN 0 ELSE 1 END fresh FROM (SELECT user_id, event_id, date_trunc('second', ts) ts FROM events)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) s FROM g) SELECT user_id, min(ts) AS session_start, count(*) n FROM s GROUP BY user_id, s""")
def session_windows(t: Tables) -> DataFrame:
    e = t.events().select("user_id", F.date_trunc("second", "ts").alias("ts"))
    # windows that only touch are merged too: the gap lies between two whole seconds
    s = e.groupBy("user_id", F.session_window("ts", "7200500 milliseconds").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def _cell_sql(name: str, kind: str) -> str:
    text = {"int": f"CAST({name} AS VARCHAR)", "double": f"printf('%.8e', {name})", "text": f"length({name}) || ':' || {name}"}[kind]
    return f"coalesce({text}, '-')"


_PART_CELLS = " || chr(31) || ".join(_cell_sql(c, k) for c, k in (("p_brand", "text"), ("p_name", "text"), ("p_partkey", "int"), ("p_retailprice", "double"), ("p_size", "int"), ("p_type", "text")))


@query(f"""WITH h AS (SELECT sha256({_PART_CELLS}) h FROM part) SELECT count(*) n, sha256(array_to_string([{", ".join(f"CAST(coalesce(sum(CAST(('0x' || substr(h, {1 + 12 * k}, 12)) AS BIGINT)), 0) AS VARCHAR)" for k in range(4))}], ',')) AS rows_sha256 FROM h""")
def row_set_hash(t: Tables) -> DataFrame:
    return A.row_set_hash(t.raw("part"))
