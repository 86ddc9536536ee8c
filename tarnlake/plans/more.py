"""Filters through hierarchies, pruning, fuzzy names, purges, due measurements, classifier and ranking figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import columns as X
from tarnlake.operators import density, findings
from tarnlake.operators import joins as J
from tarnlake.operators import vectors as V
from tarnlake.plans import model_sql
from tarnlake.plans.adapter import Tables
from tarnlake.plans.canonical import Model
from tarnlake.plans.rawlake import raw, raw_sql
from tarnlake.plans.relational import query

TOP_ORG = "servicenow:cmn_department:d0"


# -- filters through closures and owners --------------------------------------------------
def under_org(m: Model, rows: DataFrame, org: str) -> DataFrame:
    """Rows of teams in an organisation or below it: a semi-join, so no row is counted twice."""
    below = m.fact("org_closure").filter(F.col("ancestor_org_id") == org).select("org_id")
    return rows.join(m.core("team").join(below, "org_id", "left_semi").select("team_id"), "team_id", "left_semi")


def of_owner(m: Model, rows: DataFrame, team: str) -> DataFrame:
    """Rows of services that a team owns or supports."""
    own = m.core("service_map").filter((F.col("team_id") == team) & F.col("role").isin("owner", "support")).select("service_id")
    return rows.join(own, "service_id", "left_semi")


@query(model_sql.with_tables(f"SELECT 'under_org' AS kind, count(*) n FROM core_incident i WHERE EXISTS (SELECT 1 FROM core_team t JOIN fact_org_closure c ON c.org_id = t.org_id WHERE t.team_id = i.team_id AND c.ancestor_org_id = '{TOP_ORG}') UNION ALL SELECT 'of_owner', count(*) FROM core_incident i WHERE EXISTS (SELECT 1 FROM core_service_map p WHERE p.service_id = i.service_id AND p.team_id = 'servicenow:sys_user_group:g3' AND p.\"role\" IN ('owner', 'support'))"))
def hierarchy_filters(t: Tables) -> DataFrame:
    m = Model.of(t)
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(under_org(m, m.core("incident"), TOP_ORG), "under_org").unionByName(count(of_owner(m, m.core("incident"), "servicenow:sys_user_group:g3"), "of_owner"))


@query(model_sql.with_tables("SELECT record_id, cluster_id, membership_prob FROM cluster_member WHERE record_id IN (SELECT record_id FROM core_incident UNION SELECT record_id FROM core_change) AND cluster_id IN (SELECT cluster_id FROM cluster WHERE root_cause_category <> 'code')"))
def pruned_members(t: Tables) -> DataFrame:
    """Memberships of records that are still there, in clusters that are."""
    m = Model.of(t)
    live = m.core("incident").select("record_id").union(m.core("change").select("record_id")).distinct()
    kept = m.raw("cluster").filter("root_cause_category <> 'code'").select("cluster_id")
    return m.raw("cluster_member").join(live, "record_id", "left_semi").join(kept, "cluster_id", "left_semi").select("record_id", "cluster_id", "membership_prob")


# -- names ----------------------------------------------------------------------------------
def closest_names(left: DataFrame, left_id: str, left_name: str, right: DataFrame, right_id: str, right_name: str, n: int, least: float) -> DataFrame:
    """left_id, right_id, score (0 to 1), rank: the n likest names, by the words that both have over the longer's words.

    Only names with a word in common meet: an equi-join on words.
    """
    words = lambda df, i, name: df.select(F.col(i), F.array_distinct(F.filter(F.split(X.normal_name(F.col(name)), " "), lambda w: w != "")).alias("w")).filter(F.size("w") > 0)
    a, b = words(left, left_id, left_name).withColumnRenamed("w", "wa"), words(right, right_id, right_name).withColumnRenamed("w", "wb")
    pairs = a.withColumn("word", F.explode("wa")).join(b.withColumn("word", F.explode("wb")), "word").groupBy(left_id, right_id).agg(F.count("*").alias("both"), F.max(F.greatest(F.size("wa"), F.size("wb"))).alias("most"))
    scored = pairs.withColumn("score", F.round(F.col("both") / F.col("most"), 6)).filter(F.col("score") >= least)
    return J.top_n(scored, [left_id], n, F.desc("score"), F.asc(right_id)).select(left_id, right_id, "score", "rank")


_WORDS = lambda c: f"list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower({c}), '[[:punct:]]', ' ', 'g'), '\\s+', ' ', 'g'), ' '), lambda w: w <> ''))"


@query(f"WITH a AS (SELECT p_partkey, {_WORDS('p_type')} wa FROM part), b AS (SELECT DISTINCT p_brand, {_WORDS('p_brand || chr(32) || p_type')} wb, p_type FROM part WHERE p_size < 6), s AS (SELECT p_partkey, p_brand || '/' || p_type AS other, round(len(list_intersect(wa, wb)) / CAST(greatest(len(wa), len(wb)) AS DOUBLE), 6) score FROM a, b) SELECT p_partkey, other, score, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, other) AS \"rank\" FROM s WHERE score >= 0.3 QUALIFY \"rank\" <= 3")
def fuzzy_names(t: Tables) -> DataFrame:
    p = t.raw("part")
    other = p.filter("p_size < 6").select(F.concat_ws("/", "p_brand", "p_type").alias("other"), F.concat_ws(" ", "p_brand", "p_type").alias("name")).distinct()
    return closest_names(p, "p_partkey", "p_type", other, "other", "name", 3, 0.3)


# -- purge, runs, measurements ----------------------------------------------------------------
@query(f"WITH r AS ({raw_sql('issue')}), l AS (SELECT _record_id, _source_updated_at, issuelinks FROM r WHERE NOT _deleted) SELECT _record_id, count(*) n FROM l WHERE NOT coalesce(CASE WHEN json_valid(issuelinks) THEN len(list_filter(json_extract_string(issuelinks, '$[*].outwardIssue.key'), lambda k: k LIKE 'P1-%')) > 0 END, false) GROUP BY 1")
def purged_by_mention(t: Tables) -> DataFrame:
    """Records without those whose JSON array names an entity that is to be forgotten."""
    rows = raw(t, "issue").filter("NOT _deleted").select("_record_id", "_source_updated_at", "issuelinks")
    links = F.from_json(F.when(F.col("issuelinks") != "", F.col("issuelinks")), "array<struct<outwardIssue:struct<key:string>>>")
    named = F.coalesce(F.exists(links, lambda x: F.coalesce(x["outwardIssue"]["key"].startswith("P1-"), F.lit(False))), F.lit(False))
    return rows.filter(~named).groupBy("_record_id").agg(F.count("*").alias("n"))


@query("WITH runs AS (SELECT DISTINCT CAST(ts AS DATE) AS run FROM events ORDER BY run DESC LIMIT 3) SELECT run, event_type, count(*) n FROM events JOIN runs ON CAST(ts AS DATE) = run GROUP BY 1, 2")
def latest_runs(t: Tables) -> DataFrame:
    e = t.events().withColumn("run", F.to_date("ts"))
    runs = e.select("run").distinct().orderBy(F.desc("run")).limit(3)
    return e.join(F.broadcast(runs), "run").groupBy("run", "event_type").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'), d AS (SELECT a.*, m FROM a, (SELECT unnest([1, 2]) m)) SELECT o_orderkey, m AS measurement, o_orderdate + to_days(CAST(m * 30 AS INTEGER)) AS due_at FROM d WHERE o_orderdate + to_days(CAST(m * 30 AS INTEGER)) < TIMESTAMP '2000-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = m)")
def due_measurements(t: Tables) -> DataFrame:
    """Accepted recommendations whose first or second measurement is due and not there."""
    a = t.orders().filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate", F.explode(F.array(F.lit(1), F.lit(2))).alias("measurement"))
    a = a.withColumn("due_at", F.col("o_orderdate") + F.make_dt_interval(days=F.col("measurement") * 30)).filter(F.col("due_at") < F.lit("2000-01-01").cast("timestamp"))
    done = t.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("int").alias("measurement"))
    return a.join(done, ["o_orderkey", "measurement"], "left_anti").select("o_orderkey", "measurement", "due_at")


@query("SELECT doc_id, replace(\"text\", 'the ', '[gone] ') AS scrubbed FROM documents WHERE contains(\"text\", ' the a')")
def scrubbed_texts(t: Tables) -> DataFrame:
    return t.raw("documents").filter(F.contains("text", F.lit(" the a"))).select("doc_id", F.replace("text", F.lit("the "), F.lit("[gone] ")).alias("scrubbed"))


# -- figures of classifiers and rankings --------------------------------------------------------
def classifier_figures(confusion: DataFrame) -> DataFrame:
    """accuracy, macro_f1, mean_error, within_one of counts (truth, guess, n) over integer classes."""
    per = confusion.select(F.explode(F.array(F.struct(F.col("truth").alias("c"), F.col("n").alias("t"), F.lit(0).alias("g"), F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0).alias("h")), F.struct(F.col("guess").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("g"), F.lit(0).cast("long").alias("h")))).alias("x")).select("x.*")
    per = per.groupBy("c").agg(F.sum("t").alias("t"), F.sum("g").alias("g"), F.sum("h").alias("h"))
    f1 = per.agg(F.avg(F.when(F.col("t") + F.col("g") > 0, 2 * F.col("h") / (F.col("t") + F.col("g"))).otherwise(0.0)).alias("macro_f1"))
    gap = F.abs(F.col("truth") - F.col("guess"))
    one = confusion.agg(*[(F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")).alias(k) for k, c in (("accuracy", gap == 0), ("within_one", gap <= 1))], (F.sum(gap * F.col("n")) / F.sum("n")).alias("mean_error"))
    return one.join(F.broadcast(f1), F.lit(True)).select(*[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "mean_error", "within_one")])


@query("WITH c AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) truth, 1 + CAST(o_custkey % 5 AS INTEGER) guess, count(*) n FROM orders GROUP BY 1, 2), k AS (SELECT unnest(range(1, 6)) c), f AS (SELECT k.c, (SELECT sum(n) FROM c WHERE truth = k.c) t, (SELECT sum(n) FROM c WHERE guess = k.c) g, (SELECT sum(n) FROM c WHERE truth = k.c AND guess = k.c) h FROM k) SELECT round(sum(n) FILTER (WHERE truth = guess) / sum(n), 9) AS accuracy, round((SELECT avg(2 * coalesce(h, 0) / (t + g)) FROM f), 9) AS macro_f1, round(sum(abs(truth - guess) * n) / sum(n), 9) AS mean_error, round(sum(n) FILTER (WHERE abs(truth - guess) <= 1) / sum(n), 9) AS within_one FROM c")
def classifier_report(t: Tables) -> DataFrame:
    c = t.raw("orders").groupBy(X.lead_int(F.col("o_orderpriority"), 1, 5).alias("truth"), (1 + F.col("o_custkey") % 5).cast("int").alias("guess")).agg(F.count("*").alias("n"))
    return classifier_figures(c)


@query("SELECT event_type, quantile_disc(\"value\", 0.5) AS p50, quantile_disc(\"value\", 0.95) AS p95, round(avg(CAST(\"value\" < 100 AS INTEGER)), 9) AS pass_rate FROM events GROUP BY 1")
def latency_percentiles(t: Tables) -> DataFrame:
    disc = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    return t.raw("events").groupBy("event_type").agg(disc(0.5).alias("p50"), disc(0.95).alias("p95"), F.round(F.avg((F.col("value") < 100).cast("int")), 9).alias("pass_rate"))


# -- clusters of vectors ---------------------------------------------------------------------------
def assigned(vectors: DataFrame, id_col: str, vector_col: str, centroids: DataFrame, group: str, low: float, high: float, most: int = 10_000) -> DataFrame:
    """id, group, similarity, probability: the nearest centroid by cosine; the probability rises from 0 at ``low`` to 1 at ``high``.

    Centroids go by broadcast: more than ``most`` are an error.
    """
    if centroids.limit(most + 1).count() > most:
        raise ValueError("too many centroids for a broadcast")
    x = V.cosine_pairs(vectors, id_col, vector_col, centroids.select(F.col(group), "centroid"), group, "centroid")
    best = J.best_by(x, [id_col], F.desc("similarity"), F.asc(group))
    return best.withColumn("probability", F.round(X.clip((F.col("similarity") - low) / (high - low), 0, 1), 6))


_CENTROIDS = """c AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) m FROM embeddings, (SELECT unnest(range(1, 65)) i) GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) n FROM c GROUP BY 1),
s AS (SELECT vec_id, c.label, round(sum(CAST(embedding[i] AS DOUBLE) * m / n) / sqrt(sum(CAST(embedding[i] AS DOUBLE) ** 2)), 6) AS similarity FROM embeddings e JOIN c ON true JOIN n ON n.label = c.label GROUP BY vec_id, c.label)"""


@query(f"WITH {_CENTROIDS} SELECT DISTINCT ON (vec_id) vec_id, label, similarity, round(greatest(0, least(1, (similarity - 0.1) / 0.41)), 6) AS probability FROM s ORDER BY vec_id, similarity DESC, label")
def cluster_assignment(t: Tables) -> DataFrame:
    e = t.raw("embeddings")
    return assigned(e, "vec_id", "embedding", V.centroids(e, "label", "embedding"), "label", 0.1, 0.51).select("vec_id", "label", "similarity", "probability")


@query(f"WITH {_CENTROIDS}, o AS (SELECT s.vec_id, s.label, s.similarity, vec_id % 37 AS content FROM s JOIN embeddings USING (vec_id, label)), u AS (SELECT DISTINCT ON (label, content) * FROM o ORDER BY label, content, similarity DESC, vec_id) SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS \"rank\" FROM u QUALIFY \"rank\" <= 5")
def representative_members(t: Tables) -> DataFrame:
    """The members nearest to their centroid, one for each content."""
    e = t.raw("embeddings")
    own = V.cosine_pairs(e.select("vec_id", "embedding", F.col("label").alias("own")), "vec_id", "embedding", V.centroids(e, "label", "embedding"), "label", "centroid", keep=["own"]).filter("own = label").withColumn("content", F.col("vec_id") % 37)
    once = J.best_by(own, ["label", "content"], F.desc("similarity"), F.asc("vec_id"))
    return J.top_n(once, ["label"], 5, F.desc("similarity"), F.asc("vec_id")).select("label", "vec_id", "rank")


@query()
def density_clusters(t: Tables) -> DataFrame:
    """vec_id, cluster_id, probability: HDBSCAN over prototypes of all vectors; tests hold its steps against plain versions."""
    return density.density_clusters(t.raw("embeddings"), "vec_id", "embedding", 200, min_cluster_size=3, min_samples=2, iters=8, least=0.3, full=0.8, min_members=5)


@query("""WITH RECURSIVE n AS (SELECT l_orderkey id, list_distinct(list(l_linestatus || l_returnflag || CAST(l_quantity AS INTEGER))) ts, list_sort(list_distinct(list(l_returnflag))) qs FROM lineitem GROUP BY 1),
f AS (SELECT o_custkey e, o_orderkey id, ts, qs, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice * len(ts) DESC, o_orderdate, CAST(o_orderkey AS VARCHAR)) AS place FROM orders JOIN n ON n.id = o_orderkey),
l AS (SELECT a.e, a.place a, b.place b FROM f a JOIN f b ON a.e = b.e AND a.place <> b.place AND a.qs = b.qs AND list_has_any(a.ts, b.ts) WHERE a.place <= 200 AND b.place <= 200),
r(e, place, reached) AS (SELECT e, place, place FROM f UNION SELECT r.e, r.place, l.b FROM r JOIN l ON l.e = r.e AND l.a = r.reached), m AS (SELECT e, place, min(reached) least FROM r GROUP BY 1, 2)
SELECT m.e AS entity_id, CAST(k.id AS VARCHAR) AS keep_id, CAST(f.id AS VARCHAR) AS duplicate_id FROM m JOIN f ON f.e = m.e AND f.place = m.place JOIN f k ON k.e = m.e AND k.place = m.least WHERE m.least <> m.place""")
def finding_duplicates(t: Tables) -> DataFrame:
    """Orders of a customer as findings about it: their numbers are the kinds of their lines, their queries the return flags."""
    lines = t.raw("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.struct(F.col("l_linestatus").alias("query_id"), F.col("l_returnflag").alias("column"), F.col("l_quantity").cast("int").cast("string").alias("row_key"))).alias("numbers"), F.collect_set("l_returnflag").alias("query_ids"))  # a few kinds of lines
    f = t.raw("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").cast("string").alias("finding_id"), F.col("o_custkey").alias("entity_id"), F.col("o_totalprice").alias("confidence"), F.col("o_orderdate").alias("created_at"), "numbers", "query_ids")
    return findings.duplicates(f, ("entity_id",))


# -- outcome ------------------------------------------------------------------------------------------
def verdict(t_stat, relative, n, least_n: int = 8, t: float = 2.0, least: float = 0.05):
    """paid_off, worse, no_effect or inconclusive of a difference in differences (a fall is good)."""
    return F.when((n < least_n) | t_stat.isNull() | relative.isNull(), "inconclusive").when((F.abs(t_stat) >= t) & (relative <= -least), "paid_off").when((F.abs(t_stat) >= t) & (relative >= least), "worse").when(F.abs(relative) < least, "no_effect").otherwise("inconclusive")


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg("value") FILTER (WHERE user_id % 2 = 0) - avg("value") FILTER (WHERE user_id % 2 = 1) AS gap, avg("value") AS lvl FROM events GROUP BY 1, 2), g AS (SELECT event_type, avg(gap) FILTER (WHERE day >= DATE '2024-01-16') a, avg(gap) FILTER (WHERE day < DATE '2024-01-16') b, var_samp(gap) FILTER (WHERE day >= DATE '2024-01-16') va, var_samp(gap) FILTER (WHERE day < DATE '2024-01-16') vb, count(gap) FILTER (WHERE day >= DATE '2024-01-16') na, count(gap) FILTER (WHERE day < DATE '2024-01-16') nb, avg(lvl) FILTER (WHERE day < DATE '2024-01-16') base FROM d GROUP BY 1),
s AS (SELECT event_type, a - b AS did, (a - b) / nullif(sqrt(va / na + vb / nb), 0) AS t, (a - b) / nullif(base, 0) AS rel, least(na, nb) n FROM g) SELECT event_type, round(did, 6) AS did, round(t, 6) AS t_stat, round(rel, 6) AS relative, CASE WHEN n < 8 OR t IS NULL OR rel IS NULL THEN 'inconclusive' WHEN abs(t) >= 2 AND rel <= -0.05 THEN 'paid_off' WHEN abs(t) >= 2 AND rel >= 0.05 THEN 'worse' WHEN abs(rel) < 0.05 THEN 'no_effect' ELSE 'inconclusive' END AS verdict FROM s""")
def outcome_verdicts(t: Tables) -> DataFrame:
    """Daily gaps between treated and control users, before and after: difference, t and what it says."""
    v, treated = F.col("value"), F.col("user_id") % 2 == 0
    d = t.events().groupBy("event_type", F.to_date("ts").alias("day")).agg((F.avg(F.when(treated, v)) - F.avg(F.when(~treated, v))).alias("gap"), F.avg(v).alias("level"))
    late = F.col("day") >= F.lit("2024-01-16").cast("date")
    a, b = F.when(late, F.col("gap")), F.when(~late, F.col("gap"))
    g = d.groupBy("event_type").agg((F.avg(a) - F.avg(b)).alias("did"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(F.when(~late, F.col("level"))).alias("base"))
    g = g.withColumn("t", F.try_divide(F.col("did"), F.sqrt(F.col("va") / F.col("na") + F.col("vb") / F.col("nb")))).withColumn("rel", F.try_divide(F.col("did"), F.col("base")))
    return g.select("event_type", F.round("did", 6).alias("did"), F.round("t", 6).alias("t_stat"), F.round("rel", 6).alias("relative"), verdict(F.col("t"), F.col("rel"), F.least("na", "nb")).alias("verdict"))
