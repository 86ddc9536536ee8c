"""Links, series, roll-ups and selection queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.operators import joins as J
from tarnlake.plans.adapter import CHANGE_SQL, INCIDENT_SQL, ORG_SQL, Tables
from tarnlake.plans.relational import query

BEFORE_H, AFTER_H, TAU_H, LEAST, TOP = 72, 1, 12.0, 0.30, 3


@query(f"""WITH {INCIDENT_SQL}, {CHANGE_SQL}, p AS (SELECT i.record_id incident_id, c.record_id change_id, (epoch(i.opened_at) - epoch(c.actual_end)) / 3600.0 d, bad_outcome, c.type = 'emergency' urgent
  FROM incident_fact i JOIN change_fact c ON c.service_id = i.service_id AND epoch(i.opened_at) - epoch(c.actual_end) BETWEEN -{AFTER_H} * 3600 AND {BEFORE_H} * 3600 WHERE NOT i.excluded AND c.deployed),
s AS (SELECT incident_id, change_id, round(least(1.0, exp(-greatest(0.0, d) / {TAU_H}) * CASE WHEN bad_outcome THEN 1.25 ELSE 1.0 END * CASE WHEN urgent THEN 1.1 ELSE 1.0 END), 9) score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, change_id) AS "rank" FROM s WHERE score >= {LEAST}) SELECT incident_id, change_id, score, "rank" FROM r WHERE "rank" <= {TOP}""")
def link_candidates(t: Tables) -> DataFrame:
    """Changes shortly before an incident of their service, by decaying score, three at most.

    A score under LEAST can't be reached after tau ln(1.375 / LEAST) hours, so spans end there.
    """
    import math

    reach = min(BEFORE_H, TAU_H * math.log(1.375 / LEAST) + 1 / 60)
    c = t.change_fact().filter("deployed").select("service_id", F.col("record_id").alias("change_id"), "actual_end", "bad_outcome", (F.col("type") == "emergency").alias("urgent"))
    c = c.withColumn("begin", F.col("actual_end") - F.expr(f"INTERVAL {AFTER_H} HOURS")).withColumn("until", F.col("actual_end") + F.make_dt_interval(secs=F.lit(round(reach * 3600))))
    i = t.incident_fact().filter("NOT excluded").select("service_id", F.col("record_id").alias("incident_id"), "opened_at")
    p = J.interval(i, c, "service_id", "opened_at", "begin", "until", 3 * 3600)
    d = (F.unix_timestamp("opened_at") - F.unix_timestamp("actual_end")) / 3600.0
    boost = F.when(F.col("bad_outcome"), 1.25).otherwise(1.0) * F.when(F.col("urgent"), 1.1).otherwise(1.0)
    score = F.round(F.least(F.lit(1.0), F.exp(-F.greatest(F.lit(0.0), d) / TAU_H) * boost), 9)
    s = p.select("incident_id", "change_id", score.alias("score")).filter(F.col("score") >= LEAST)
    return J.top_n(s, ["incident_id"], TOP, F.desc("score"), F.asc("change_id"))


@query(f"""WITH {INCIDENT_SQL}, {ORG_SQL} SELECT ancestor, count(*) n, round(avg(resolve_h), 6) mttr FROM incident_fact JOIN closure ON org_id = 'N' || service_id WHERE NOT excluded GROUP BY 1""")
def org_rollup_mttr(t: Tables) -> DataFrame:
    """A record counts once for each ancestor; figures are summed by nation before the fan-out."""
    f = t.incident_fact().filter("NOT excluded").groupBy("service_id").agg(F.count("*").alias("n"), F.sum("resolve_h").alias("s"), F.count("resolve_h").alias("k"))
    c = J.closure(t.org(), "org_id", "parent_org_id")
    j = f.withColumn("org_id", F.concat(F.lit("N"), "service_id")).join(F.broadcast(c), "org_id")
    return j.groupBy("ancestor").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("k"), 6).alias("mttr"))


@query(f"""WITH {INCIDENT_SQL}, spine AS (SELECT unnest(range(12)) k), teams AS (SELECT DISTINCT team_id FROM incident_fact),
w AS (SELECT team_id, CAST(floor((epoch(TIMESTAMP '1998-01-01') - epoch(opened_at)) / 604800.0) AS BIGINT) k, count(*) n FROM incident_fact WHERE opened_at < TIMESTAMP '1998-01-01' AND opened_at >= TIMESTAMP '1998-01-01' - INTERVAL 84 DAY GROUP BY 1, 2)
SELECT teams.team_id, CAST(spine.k AS INTEGER) weeks_ago, coalesce(n, 0) n FROM teams CROSS JOIN spine LEFT JOIN w ON w.team_id = teams.team_id AND w.k = spine.k""")
def dense_twelve_weeks(t: Tables) -> DataFrame:
    """Counts by week with zeros for weeks without; the spine is a sequence in each team's row."""
    end = F.lit("1998-01-01").cast("timestamp")
    i = t.incident_fact().select("team_id", "opened_at")
    inside = (F.col("opened_at") < end) & (F.col("opened_at") >= end - F.expr("INTERVAL 84 DAYS"))
    k = F.when(inside, F.floor((F.unix_timestamp(end) - F.unix_timestamp("opened_at")) / 604800.0).cast("int"))
    counts = i.groupBy("team_id", k.alias("k")).agg(F.count("*").alias("n"))
    m = counts.groupBy("team_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "n")))).alias("m"))
    return m.select("team_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("weeks_ago"), "m").select("team_id", "weeks_ago", F.coalesce(F.try_element_at("m", F.col("weeks_ago")), F.lit(0)).alias("n"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum("value") v FROM events GROUP BY 1, 2)
SELECT user_id, day, round(sum(v) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 6) week_value FROM d""".replace("AS day", "AS d_day").replace(", day,", ", d_day,").replace("BY day", "BY d_day"))
def rolling_week(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    d = t.events().groupBy("user_id", F.to_date("ts").alias("d_day")).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy(F.unix_date("d_day")).rangeBetween(-6, 0)
    return d.select("user_id", "d_day", F.round(F.sum("v").over(w), 6).alias("week_value"))


@query("""SELECT sha256(coalesce("text", '')) AS content, min(doc_id) AS record_id, count(*) copies FROM documents GROUP BY 1""")
def representative_by_content(t: Tables) -> DataFrame:
    """The lowest id of each content; copies cost one partial row a task."""
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    return t.raw("documents").groupBy(h.alias("content")).agg(F.min("doc_id").alias("record_id"), F.count("*").alias("copies"))


@query("""SELECT doc_id, (ascii(substr(sha256(CAST(doc_id AS VARCHAR)), 1, 1)) % 2) = 0 AS even_fold FROM documents""")
def hash_folds(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", (F.ascii(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 1)) % 2 == 0).alias("even_fold"))


@query("""SELECT p_brand, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) FILTER (WHERE p_size >= 45) AS large, count(*) FILTER (WHERE p_size < 5) small, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1""")
def filtered_lists(t: Tables) -> DataFrame:
    """Ordered lists and filtered counts of each candidate group, one aggregation."""
    ids = F.array_sort(F.collect_list(F.when(F.col("p_size") >= 45, F.col("p_partkey"))))
    return t.raw("part").groupBy("p_brand").agg(F.nullif(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), F.lit("")).alias("large"), F.count_if(F.col("p_size") < 5).alias("small"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query("""SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7' AND event_type IS DISTINCT FROM 'view'""")
def json_subset_match(t: Tables) -> DataFrame:
    return t.raw("events").filter((F.get_json_object("props", "$.k") == "7") & ~F.col("event_type").eqNullSafe("view")).select("event_id")


@query("""WITH n AS (SELECT conv_id, count(*) turns, count(*) FILTER (WHERE role = 'user') users, max(turn) last_turn FROM conversations GROUP BY 1) SELECT turns, users, count(*) n FROM n GROUP BY 1, 2""")
def conversation_shapes(t: Tables) -> DataFrame:
    n = t.raw("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("users"))
    return n.groupBy("turns", "users").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, html FROM pages), r AS (SELECT host, count(*) pages, CAST(sum(octet_length(encode(coalesce(html, '')))) AS BIGINT) AS size FROM h GROUP BY 1) SELECT host, pages, size FROM r ORDER BY pages DESC, host LIMIT 20""")
def top_hosts(t: Tables) -> DataFrame:
    h = t.raw("pages").groupBy(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.octet_length(F.coalesce("html", F.lit("")))).alias("size"))
    return h.orderBy(F.desc("pages"), "host").limit(20)


@query("""SELECT k, words, n_docs FROM (SELECT CAST(least(5, floor(n / 200)) AS BIGINT) k, CAST(sum(n) AS BIGINT) words, count(*) n_docs FROM (SELECT len(string_split(trim("text"), ' ')) n FROM documents WHERE "text" IS NOT NULL) GROUP BY 1)""")
def length_bands(t: Tables) -> DataFrame:
    n = t.raw("documents").filter("text IS NOT NULL").select(F.size(F.split(F.trim("text"), " ")).alias("n"))
    return n.groupBy(F.least(F.lit(5), F.floor(F.col("n") / 200)).cast("bigint").alias("k")).agg(F.sum("n").alias("words"), F.count("*").alias("n_docs"))
