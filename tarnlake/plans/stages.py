"""Stages of enrichment: what is carried over, what is still to do, how answers are resolved, what is sampled."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tarnlake.functions import columns as X
from tarnlake.operators import joins as J
from tarnlake.plans import model_sql
from tarnlake.plans.adapter import Tables
from tarnlake.plans.canonical import Model
from tarnlake.plans.model_sql import CTE
from tarnlake.plans.rawlake import raw, raw_sql
from tarnlake.plans.relational import query

for _n in ("cases", "cases_before", "answers", "questions", "human_answers", "embedded"):
    CTE[_n] = raw_sql(_n)


# -- text, vectors, questions -------------------------------------------------------------
def carried_text(now: DataFrame, before: DataFrame) -> DataFrame:
    """Records whose source has not changed since, with the text made then."""
    return now.join(before.select("record_id", "updated_at", "text_redacted"), ["record_id", "updated_at"])


def new_text(now: DataFrame, before: DataFrame) -> DataFrame:
    """The other records: their text is to be made."""
    return now.join(before.select("record_id", "updated_at"), ["record_id", "updated_at"], "left_anti")


@query(model_sql.with_tables("SELECT c.record_id, b.text_redacted, b.record_id IS NOT NULL AS carried FROM cases c LEFT JOIN cases_before b ON b.record_id = c.record_id AND b.updated_at = c.updated_at"))
def text_stage(t: Tables) -> DataFrame:
    now, before = raw(t, "cases"), raw(t, "cases_before")
    kept = carried_text(now, before).select("record_id", "text_redacted", F.lit(True).alias("carried"))
    return kept.unionByName(new_text(now, before).select("record_id", F.lit(None).cast("string").alias("text_redacted"), F.lit(False).alias("carried")))


@query(model_sql.with_tables("SELECT content_hash, min(record_id) AS record_id, count(*) n FROM cases WHERE content_hash NOT IN (SELECT content_hash FROM embedded WHERE model = 'm1') GROUP BY 1"))
def embed_todo(t: Tables) -> DataFrame:
    """One record for each content without a vector of the model; records of one content share it."""
    done = raw(t, "embedded").filter("model = 'm1'")
    return raw(t, "cases").join(done, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("record_id").alias("record_id"), F.count("*").alias("n"))


def _applicable(t: Tables) -> DataFrame:
    q = raw(t, "questions")  # configuration: some dozens of rows
    per = q.select("question", "fingerprint", "threshold", "first_decider", "chain", F.explode(F.split("applies_to", ",")).alias("entity"))
    return raw(t, "cases").join(F.broadcast(per), "entity")


def current_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """The latest answer of each decider to the question as it reads now, its probability calibrated."""
    q = F.broadcast(questions.select("question", "fingerprint", "qtype", "t"))
    best = J.best_by(answers.join(q, ["question", "fingerprint"]), ["content_hash", "question", "decider"], F.desc("decided_at"), F.asc("answer"), F.asc("answer_id"), F.asc("p_true"))
    p = F.least(F.greatest(F.col("p_true"), F.lit(1e-9)), F.lit(1 - 1e-9))
    yes = 1 / (1 + F.exp(-F.log(p / (1 - p)) / F.col("t")))
    shares = F.create_map(F.lit("true"), F.col("p_true"), F.lit("false"), 1 - F.col("p_true"))
    soft = X.softmax_of(shares, F.col("answer"), F.col("t"))
    return best.select("content_hash", "question", "decider", "answer", "decided_at", F.when(F.col("qtype") != "bool", soft).when(F.col("answer") == "false", 1 - yes).otherwise(yes).alias("p_cal"))


CTE["st_now"] = """SELECT * FROM (SELECT a.*, q.qtype, q.t, row_number() OVER (PARTITION BY content_hash, question, decider ORDER BY decided_at DESC, answer, answer_id, p_true) n FROM answers a JOIN questions q USING (question, fingerprint)) WHERE n = 1"""
CTE["st_cal"] = """SELECT content_hash, question, decider, answer, decided_at, CASE WHEN qtype <> 'bool' THEN own / (exp(ln(p_true + 1e-9) / t) + exp(ln(1 - p_true + 1e-9) / t)) WHEN answer = 'false' THEN 1 - y ELSE y END AS p_cal
 FROM (SELECT *, exp(ln(CASE WHEN answer = 'true' THEN p_true ELSE 1 - p_true END + 1e-9) / t) own, 1 / (1 + exp(-ln(least(greatest(p_true, 1e-9), 1 - 1e-9) / (1 - least(greatest(p_true, 1e-9), 1 - 1e-9))) / t)) y FROM st_now)"""
CTE["st_asked"] = """SELECT c.record_id, c.entity, c.content_hash, c.opened_at, q.question, q.fingerprint, q.threshold, q.first_decider, q.chain FROM cases c JOIN questions q ON list_contains(string_split(q.applies_to, ','), c.entity)"""


@query(model_sql.with_tables("SELECT content_hash, question, decider, answer, round(p_cal, 9) AS p_cal FROM st_cal"))
def calibrated_answers(t: Tables) -> DataFrame:
    return current_answers(raw(t, "answers"), raw(t, "questions")).select("content_hash", "question", "decider", "answer", F.round("p_cal", 9).alias("p_cal"))


def resolved(t: Tables) -> DataFrame:
    """The answer that holds for each record and question: the ensemble's, the first decider's if sure enough, then the chain's; a human's over all."""
    asked = _applicable(t)
    now = current_answers(raw(t, "answers"), raw(t, "questions"))
    place = F.array_position(F.split("chain", ","), F.col("decider"))
    rank = F.when(F.col("decider") == "ensemble", 1).when((F.col("decider") == F.col("first_decider")) & (F.col("p_cal") >= F.col("threshold")), 2).when(place > 0, 3 + place)
    ranked = asked.join(now, ["content_hash", "question"]).withColumn("place", rank).filter("place is not null")
    best = J.best_by(ranked, ["record_id", "question"], F.asc("place"), F.asc("decider")).select("record_id", "question", "decider", "answer", "p_cal")
    human = J.best_by(raw(t, "human_answers"), ["content_hash", "question"], F.desc("labeled_at")).select("content_hash", "question", F.col("answer").alias("h_answer"))
    x = asked.join(best, ["record_id", "question"], "left").join(human, ["content_hash", "question"], "left")
    over = F.col("h_answer").isNotNull() & ~F.col("answer").eqNullSafe(F.col("h_answer"))
    has = F.col("decider").isNotNull()
    return x.select(
        "record_id",
        "question",
        "content_hash",
        "opened_at",
        F.when(has | F.col("h_answer").isNotNull(), "final").otherwise("queue").alias("status"),
        F.when(over, F.col("h_answer")).otherwise(F.col("answer")).alias("answer"),
        F.when(over, F.lit(1.0)).otherwise(F.col("p_cal")).alias("probability"),
        F.when(over, "human").otherwise(F.col("decider")).alias("decider"),
        F.when(over & has, "corrected").when(F.col("h_answer").isNotNull(), "confirmed").otherwise("none").alias("review_status"),
    )


CTE["st_final"] = """SELECT a.record_id, a.question, a.content_hash, a.opened_at, CASE WHEN b.decider IS NOT NULL OR h.answer IS NOT NULL THEN 'final' ELSE 'queue' END AS status, CASE WHEN h.answer IS NOT NULL AND h.answer IS DISTINCT FROM b.answer THEN h.answer ELSE b.answer END AS answer,
 CASE WHEN h.answer IS NOT NULL AND h.answer IS DISTINCT FROM b.answer THEN 1.0 ELSE b.p_cal END AS probability, CASE WHEN h.answer IS NOT NULL AND h.answer IS DISTINCT FROM b.answer THEN 'human' ELSE b.decider END AS decider, CASE WHEN h.answer IS NULL THEN 'none' WHEN b.decider IS NOT NULL AND h.answer IS DISTINCT FROM b.answer THEN 'corrected' ELSE 'confirmed' END AS review_status
 FROM st_asked a LEFT JOIN (SELECT DISTINCT ON (record_id, question) record_id, question, decider, answer, p_cal FROM (SELECT a.record_id, a.question, c.decider, c.answer, c.p_cal, CASE WHEN c.decider = 'ensemble' THEN 1 WHEN c.decider = a.first_decider AND c.p_cal >= a.threshold THEN 2 WHEN list_contains(string_split(a.chain, ','), c.decider) THEN 3 + list_position(string_split(a.chain, ','), c.decider) END pl FROM st_asked a JOIN st_cal c USING (content_hash, question)) WHERE pl IS NOT NULL ORDER BY record_id, question, pl, decider) b USING (record_id, question)
 LEFT JOIN (SELECT DISTINCT ON (content_hash, question) content_hash, question, answer FROM human_answers ORDER BY content_hash, question, labeled_at DESC) h ON h.content_hash = a.content_hash AND h.question = a.question"""


@query(model_sql.with_tables("SELECT record_id, question, status, answer, round(probability, 9) AS probability, decider, review_status FROM st_final"))
def resolved_decisions(t: Tables) -> DataFrame:
    return resolved(t).select("record_id", "question", "status", "answer", F.round("probability", 9).alias("probability"), "decider", "review_status")


@query(model_sql.with_tables("SELECT content_hash, count(*) n, string_agg(question, ',' ORDER BY question) AS questions FROM (SELECT DISTINCT content_hash, question FROM st_asked WHERE (content_hash, question) NOT IN (SELECT (content_hash, question) FROM st_cal)) GROUP BY 1"))
def decide_todo(t: Tables) -> DataFrame:
    """Questions without a current answer, by content."""
    asked = _applicable(t).select("content_hash", "question").distinct()
    todo = asked.join(current_answers(raw(t, "answers"), raw(t, "questions")).select("content_hash", "question"), ["content_hash", "question"], "left_anti")
    return todo.groupBy("content_hash").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("question")), ",").alias("questions"))


@query(model_sql.with_tables("SELECT content_hash, question, max(opened_at) AS latest, count(*) AS n FROM st_final WHERE status = 'queue' GROUP BY 1, 2 ORDER BY latest DESC, content_hash, question LIMIT 50"))
def escalation_queue(t: Tables) -> DataFrame:
    """What is still open, the newest records first: a queue of a stated length."""
    g = resolved(t).filter("status = 'queue'").groupBy("content_hash", "question").agg(F.max("opened_at").alias("latest"), F.count("*").alias("n"))
    return g.orderBy(F.desc("latest"), "content_hash", "question").limit(50)


@query(model_sql.with_tables("SELECT c.record_id, CASE WHEN b.record_id IS NULL THEN 'new' WHEN b.content_hash <> c.content_hash THEN 'changed' WHEN c.content_hash IN (SELECT content_hash FROM human_answers WHERE labeled_at > TIMESTAMP '2001-05-01 00:10:00') THEN 'touched' ELSE 'settled' END AS scope FROM cases c LEFT JOIN cases_before b USING (record_id)"))
def nightly_scope(t: Tables) -> DataFrame:
    """Settled records keep what they had; new, changed and touched ones are resolved again."""
    before = raw(t, "cases_before").select("record_id", F.col("content_hash").alias("was"))
    touched = raw(t, "human_answers").filter("labeled_at > timestamp'2001-05-01 00:10:00'").select("content_hash").distinct().withColumn("touched", F.lit(True))
    x = raw(t, "cases").join(before, "record_id", "left").join(touched, "content_hash", "left")
    return x.select("record_id", F.when(F.col("was").isNull(), "new").when(F.col("was") != F.col("content_hash"), "changed").when(F.col("touched"), "touched").otherwise("settled").alias("scope"))


@query(model_sql.with_tables("""SELECT content_hash, question, round(min(p_cal), 9) AS low, round(max(p_cal), 9) AS high FROM st_cal WHERE decider <> 'ensemble' GROUP BY 1, 2 HAVING count(DISTINCT answer) > 1 OR (min(p_cal) BETWEEN 0.4 AND 0.6)"""))
def ensemble_band(t: Tables) -> DataFrame:
    """Pairs on which the deciders differ, or one of them is unsure."""
    a = current_answers(raw(t, "answers"), raw(t, "questions")).filter("decider <> 'ensemble'")
    g = a.groupBy("content_hash", "question").agg(F.min("p_cal").alias("low"), F.max("p_cal").alias("high"), F.count_distinct("answer").alias("n"))
    return g.filter((F.col("n") > 1) | F.col("low").between(0.4, 0.6)).select("content_hash", "question", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def spot_checks(rows: DataFrame, id_cols: list[str], rate: float, most: int, salt: str) -> DataFrame:
    """About a share ``rate`` of the rows, ``most`` at the most, by salted hash: the same rows on every run."""
    h = F.sha2(F.concat_ws("|", F.lit(salt), *id_cols), 256)
    part = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 2.0**32
    return rows.withColumn("key", h).filter(part < rate).orderBy("key", *id_cols).limit(most).drop("key")


@query(model_sql.with_tables("SELECT record_id, question FROM (SELECT record_id, question, sha256('spot|' || record_id || '|' || question) h FROM st_final WHERE status = 'final' AND probability BETWEEN 0.3 AND 0.9) WHERE CAST(('0x' || substr(h, 1, 8)) AS BIGINT) / 4294967296.0 < 0.1 ORDER BY h, record_id, question LIMIT 40"))
def spot_check_sample(t: Tables) -> DataFrame:
    return spot_checks(resolved(t).filter("status = 'final' and probability between 0.3 and 0.9"), ["record_id", "question"], 0.1, 40, "spot").select("record_id", "question")


@query(model_sql.with_tables("SELECT record_id, question, \"rank\" FROM (SELECT record_id, question, row_number() OVER (PARTITION BY question ORDER BY round(abs(probability - 0.5), 9), record_id) AS \"rank\" FROM st_final WHERE status = 'final' AND decider <> 'human') WHERE \"rank\" <= 10"))
def active_selection(t: Tables) -> DataFrame:
    """The records whose answers are least sure, so many for each question."""
    x = resolved(t).filter("status = 'final' and decider <> 'human'").withColumn("doubt", F.round(F.abs(F.col("probability") - 0.5), 9))
    return J.top_n(x, ["question"], 10, F.asc("doubt"), F.asc("record_id")).select("record_id", "question", "rank")


def stratum(service: Column, priority: Column, at: Column, length: Column) -> Column:
    """service|priority band|quarter|length band"""
    band = F.when(priority <= 2, "high").when(priority <= 3, "middle").otherwise("low")
    size = F.when(length < 12, "short").when(length < 40, "medium").otherwise("long")
    return F.concat_ws("|", F.coalesce(service.cast("string"), F.lit("none")), band, F.concat(F.year(at).cast("string"), F.lit("Q"), F.quarter(at).cast("string")), size)


@query(model_sql.with_tables("SELECT coalesce(CAST(service_id AS VARCHAR), 'none') || '|' || CASE WHEN priority <= 2 THEN 'high' WHEN priority <= 3 THEN 'middle' ELSE 'low' END || '|' || year(opened_at) || 'Q' || quarter(opened_at) || '|' || CASE WHEN length(content_hash) < 12 THEN 'short' WHEN length(content_hash) < 40 THEN 'medium' ELSE 'long' END AS stratum, count(*) AS n FROM cases GROUP BY 1"))
def strata(t: Tables) -> DataFrame:
    return raw(t, "cases").groupBy(stratum(F.col("service_id"), F.col("priority"), F.col("opened_at"), F.length("content_hash")).alias("stratum")).agg(F.count("*").alias("n"))


# -- links -----------------------------------------------------------------------------------
BEFORE_H, AFTER_H, TAU_H, CI_WEIGHT, SERVICE_WEIGHT, LEAST_SCORE, TOP, CAP = 72.0, 1.0, 12.0, 1.0, 0.6, 0.30, 3, 0.45
WEEK = 7 * 86_400
#: Pairs of incidents and changes that are looked at in one go.
MOST_PAIRS = 500_000
_FOUND = "incident_id string, change_id string, raw double, score double"


def _reach(w: float) -> float:
    """Seconds after a change in which its score can still count."""
    return min(BEFORE_H, TAU_H * math.log(w * 1.375 / LEAST_SCORE) + 1 / 60) * 3600


def _best(c: dict, i: dict) -> list[np.ndarray]:
    """Of each incident the TOP changes of its item or service: places of both, raw and score.

    Where raw is the same the first counts, so changes come by id.  The score is raw under a
    cap and so in the order of raw.
    """
    d = i["at"][:, None] - c["at"][None, :]
    near = (d >= -AFTER_H * 3600) & (d <= BEFORE_H * 3600) | (i["at"][:, None] >= c["start"][None, :]) & (i["at"][:, None] <= c["end"][None, :])
    row, col = np.nonzero(near & (d <= _reach(i["w"])))
    raw = np.minimum(1.0, i["w"] * np.exp(-np.maximum(0.0, d[row, col] / 3600.0) / TAU_H) * c["boost"][col])
    counts = raw >= LEAST_SCORE
    of = np.full(d.shape, -1.0)
    of[row[counts], col[counts]] = raw[counts]
    own = np.array([c["place"].get(n, -1) for n in i["named"]])
    of[own >= 0, own[own >= 0]] = -1.0
    out, rows = [], np.arange(len(d))
    for _ in range(min(TOP, d.shape[1])):
        col = of.argmax(1)
        got = of[rows, col]
        out.append((rows[got > 0], col[got > 0], got[got > 0]))
        of[rows, col] = -1.0
    row, col, raw = (np.concatenate(x) for x in zip(*out, strict=True))
    return [row, col, raw, np.where(i["told"][row], raw, np.minimum(raw, CAP))]


def _top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_FOUND from rows sorted by place (item or service, and week), changes first: only a place's changes are held."""
    place, held, ready = None, [], None
    for b in batches:
        x = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
        found = []
        edges = np.flatnonzero((x["place"][1:] != x["place"][:-1]) | (x["side"][1:] != x["side"][:-1])) + 1
        for lo, hi in zip([0, *edges], [*edges, b.num_rows], strict=True):
            if lo == hi:
                continue
            if x["place"][lo] != place:
                place, held, ready = x["place"][lo], [], None
            if x["side"][lo] == 0:
                held.append({n: x[n][lo:hi] for n in ("id", "at", "start", "end", "boost")})
                continue
            if not held:
                continue
            if ready is None:
                ready = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                by_id = np.argsort(ready["id"].astype(str), kind="stable")
                ready = {n: v[by_id] for n, v in ready.items()}
                ready["place"] = {v: n for n, v in enumerate(ready["id"])}
            step = max(1, MOST_PAIRS // len(ready["id"]))
            for at in range(lo, hi, step):
                own = slice(at, min(hi, at + step))
                i = {n: x[n][own] for n in ("id", "at", "told", "named")} | {"w": x["w"][lo]}
                row, col, raw, score = _best(ready, i)
                found.append((i["id"][row], ready["id"][col], raw, score))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), t) for v, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=["incident_id", "change_id", "raw", "score"])


def link_candidates(m: Model) -> DataFrame:
    """incident_id, change_id, method, score: changes that may have caused an incident.

    Those its source names come first; others share its item or service and lie near in
    time.  A score falls with the time after the change, rises for bad outcomes and
    emergencies, and without the change's number in the incident's text stays under a cap.
    Incidents and changes are shuffled by (key, week), a change to each week in which its
    score can count, and the pairs stay in the task that finds the best of them: what is
    best by item or by service is the best of both, as the item's weight is the higher one.
    """
    kinds = lambda: F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key"), F.lit(w).alias("w"), F.lit(_reach(w)).alias("reach")) for k, c, w in (("ci", "ci_id", CI_WEIGHT), ("service", "service_id", SERVICE_WEIGHT))])).alias("k")
    inc = m.core("incident").filter("opened_at is not null").select(F.col("record_id").alias("incident_id"), "ci_id", "service_id", F.unix_timestamp("opened_at").alias("at"), "caused_by_change_id", F.coalesce(F.col("short_description").rlike("(?i)change|chg|deploy|release|[05]$"), F.lit(False)).alias("told"))
    c = m.core("change").withColumn("t", F.unix_timestamp(F.coalesce("actual_end", "actual_start", "planned_end"))).filter("t is not null")
    boost = F.when(F.col("outcome").isin("failed", "rolled_back"), 1.25).otherwise(1.0) * F.when(F.col("type") == "emergency", 1.1).otherwise(1.0)
    c = c.select(F.col("record_id").alias("id"), "t", F.unix_timestamp("actual_start").alias("start"), F.unix_timestamp("actual_end").alias("end"), boost.alias("boost"), kinds()).select("id", "t", "start", "end", "boost", "k.*").filter("key is not null")
    lo, hi = F.least(F.col("t") - AFTER_H * 3600, F.col("start")), F.greatest(F.col("t") + F.col("reach"), F.col("end"))
    c = c.withColumn("week", F.explode(F.sequence(F.floor(lo / WEEK), F.floor(hi / WEEK))))
    i = inc.withColumn("week", F.floor(F.col("at") / WEEK)).select("incident_id", "at", "told", "caused_by_change_id", "week", kinds()).select("*", "k.*").filter("key is not null")
    real = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(float("nan"))).alias(x)
    place = F.concat_ws("|", "kind", F.col("week").cast("string"), "key").alias("place")
    nan, none = F.lit(float("nan")), F.lit(None).cast("string")
    c = c.select(place, F.lit(0).alias("side"), "id", F.col("t").cast("double").alias("at"), real("start"), real("end"), "boost", F.lit(False).alias("told"), none.alias("named"), "w")
    i = i.select(place, F.lit(1).alias("side"), F.col("incident_id").alias("id"), F.col("at").cast("double").alias("at"), nan.alias("start"), nan.alias("end"), nan.alias("boost"), "told", F.col("caused_by_change_id").alias("named"), "w")
    both = c.unionByName(i).repartition("place").sortWithinPartitions("place", "side")
    s = both.mapInArrow(_top, _FOUND).repartition("incident_id").groupBy("incident_id", "change_id").agg(F.max("score").alias("score"), F.max("raw").alias("raw"))
    named = inc.filter("caused_by_change_id is not null").select("incident_id", F.col("caused_by_change_id").alias("change_id")).join(m.core("change").select(F.col("record_id").alias("change_id")), "change_id", "left_semi").distinct()
    win = J.top_n(s, ["incident_id"], TOP, F.desc("score"), F.desc("raw"), F.asc("change_id"))
    return named.select("incident_id", "change_id", F.lit("source_field").alias("method"), F.lit(1.0).alias("score")).unionByName(win.select("incident_id", "change_id", F.lit("time_ci_window").alias("method"), "score"))


def kept_links(found: DataFrame, decided: DataFrame, top: int = TOP) -> DataFrame:
    """Candidates with a decider's probability blended in (half and half), so many for each incident, named ones first."""
    x = found.join(decided.select("incident_id", "change_id", "p"), ["incident_id", "change_id"], "left")
    by = (F.col("method") == "time_ci_window") & F.col("p").isNotNull()
    x = x.withColumn("score", F.when(by, 0.5 * F.col("score") + 0.5 * F.col("p")).otherwise(F.col("score"))).withColumn("method", F.when(by, "decider").otherwise(F.col("method")))
    return J.top_n(x, ["incident_id"], top, F.desc(F.col("method") == "source_field"), F.desc("score"), F.asc("change_id")).drop("p")


_SCORE = f"least(1.0, w * exp(-greatest(0.0, (at - t) / 3600.0) / {TAU_H}) * boost)"
CTE["ln_inc"] = "SELECT record_id incident_id, ci_id, service_id, epoch(opened_at) \"at\", caused_by_change_id, coalesce(regexp_matches(short_description, '(?i)change|chg|deploy|release|[05]$'), false) told FROM core_incident WHERE opened_at IS NOT NULL"
CTE["ln_chg"] = """SELECT record_id change_id, ci_id, service_id, epoch(coalesce(actual_end, actual_start, planned_end)) t, epoch(actual_start) s, epoch(actual_end) e, CASE WHEN outcome IN ('failed', 'rolled_back') THEN 1.25 ELSE 1.0 END * CASE WHEN "type" = 'emergency' THEN 1.1 ELSE 1.0 END AS boost FROM core_change WHERE coalesce(actual_end, actual_start, planned_end) IS NOT NULL"""
CTE["ln_hits"] = f"""SELECT incident_id, change_id, max(CASE WHEN told THEN raw ELSE least(raw, {CAP}) END) score, max(raw) raw FROM (SELECT *, {_SCORE.replace('at -', '"at" -')} raw FROM (SELECT i.*, c.*, {CI_WEIGHT} w FROM ln_inc i JOIN ln_chg c ON c.ci_id = i.ci_id UNION ALL SELECT i.*, c.*, {SERVICE_WEIGHT} FROM ln_inc i JOIN ln_chg c ON c.service_id = i.service_id)
 WHERE "at" - t <= {BEFORE_H * 3600} AND ("at" - t BETWEEN {-AFTER_H * 3600} AND {BEFORE_H * 3600} OR "at" BETWEEN s AND e)) WHERE CASE WHEN told THEN raw ELSE least(raw, {CAP}) END >= {LEAST_SCORE} GROUP BY 1, 2"""
CTE["ln_named"] = "SELECT DISTINCT incident_id, caused_by_change_id AS change_id FROM ln_inc WHERE caused_by_change_id IN (SELECT record_id FROM core_change)"
CTE["ln_found"] = f"""SELECT incident_id, change_id, 'source_field' AS method, 1.0::DOUBLE AS score FROM ln_named UNION ALL SELECT incident_id, change_id, 'time_ci_window', score FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, raw DESC, change_id) n FROM ln_hits h WHERE NOT EXISTS (SELECT 1 FROM ln_named x WHERE x.incident_id = h.incident_id AND x.change_id = h.change_id)) WHERE n <= {TOP}"""
CTE["ln_decided"] = "SELECT incident_id, change_id, score AS p FROM change_link"


@query(model_sql.with_tables("SELECT incident_id, change_id, method, round(score, 9) AS score FROM ln_found"))
def incident_change_candidates(t: Tables) -> DataFrame:
    return link_candidates(Model.of(t)).withColumn("score", F.round("score", 9))


@query(model_sql.with_tables(f"""SELECT incident_id, change_id, method, round(score, 9) AS score, "rank" FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY method = 'source_field' DESC, score DESC, change_id) AS "rank" FROM (SELECT f.incident_id, f.change_id, CASE WHEN f.method = 'time_ci_window' AND d.p IS NOT NULL THEN 'decider' ELSE f.method END AS method, CASE WHEN f.method = 'time_ci_window' AND d.p IS NOT NULL THEN 0.5 * f.score + 0.5 * d.p ELSE f.score END AS score FROM ln_found f LEFT JOIN ln_decided d ON d.incident_id = f.incident_id AND d.change_id = f.change_id)) WHERE "rank" <= {TOP}"""))
def incident_change_links(t: Tables) -> DataFrame:
    m = Model.of(t)
    decided = m.raw("change_link").withColumnRenamed("score", "p")
    return kept_links(link_candidates(m), decided).withColumn("score", F.round("score", 9))


# -- clusters and mappings --------------------------------------------------------------------
@query(model_sql.with_tables("SELECT cluster_id, count(*) AS size, min(opened_at) AS first_at, max(opened_at) AS last_at, (SELECT string_agg(service_id, ',' ORDER BY n DESC, service_id) FROM (SELECT service_id, count(*) n, row_number() OVER (ORDER BY count(*) DESC, service_id) k FROM fact_incident g WHERE g.cluster_id = f.cluster_id AND service_id IS NOT NULL AND NOT excluded GROUP BY 1) WHERE k <= 5 AND n >= 0.05 * count(f.record_id)) AS services FROM fact_incident f WHERE cluster_id IS NOT NULL AND NOT excluded GROUP BY cluster_id"))
def cluster_profiles(t: Tables) -> DataFrame:
    """Size, first and last incident, and the services with a share of five hundredths or more, five at the most."""
    f = Model.of(t).fact("incident").filter("cluster_id is not null and not excluded")
    size = f.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("opened_at").alias("first_at"), F.max("opened_at").alias("last_at"))
    per = f.filter("service_id is not null").groupBy("cluster_id", "service_id").agg(F.count("*").alias("n"))
    top = J.top_n(per, ["cluster_id"], 5, F.desc("n"), F.asc("service_id")).join(size, "cluster_id").filter(F.col("n") >= 0.05 * F.col("size"))
    names = top.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "service_id"))), lambda x: x["service_id"]), ",").alias("services"))
    return size.join(names, "cluster_id", "left")


@query(model_sql.with_tables("SELECT cluster_id, answer AS root_cause, n FROM (SELECT l.cluster_id, d.answer, count(*) n, row_number() OVER (PARTITION BY l.cluster_id ORDER BY count(*) DESC, d.answer) k FROM likeliest l JOIN (SELECT DISTINCT ON (record_id) record_id, answer FROM (SELECT replace(record_id, 'jira:issue:iss', 'servicenow:incident:inc') record_id, answer, decided_at FROM decision WHERE question = 'root_cause') ORDER BY record_id, decided_at DESC, answer) d USING (record_id) GROUP BY 1, 2) WHERE k = 1"))
def cluster_root_causes(t: Tables) -> DataFrame:
    """The answer that most members of a cluster have."""
    from tarnlake.plans.facts import best_member

    m = Model.of(t)
    d = m.raw("decision").filter("question = 'root_cause'").withColumn("record_id", F.replace("record_id", F.lit("jira:issue:iss"), F.lit("servicenow:incident:inc")))
    d = J.best_by(d, ["record_id"], F.desc("decided_at"), F.asc("answer")).select("record_id", "answer")
    n = best_member(m).join(d, "record_id").groupBy("cluster_id", F.col("answer").alias("root_cause")).agg(F.count("*").alias("n"))
    return J.best_by(n, ["cluster_id"], F.desc("n"), F.asc("root_cause"))


@query(model_sql.with_tables("SELECT project, component, n, latest FROM (SELECT project, component, count(*) n, string_agg(summary, '|' ORDER BY created_at DESC, record_id) FILTER (WHERE k <= 3) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY project, component ORDER BY created_at DESC, record_id) k FROM (SELECT project, unnest(components) component, summary, created_at, record_id FROM core_work_item) u WHERE NOT EXISTS (SELECT 1 FROM core_service_map p WHERE p.jira_project = u.project AND (p.jira_component IS NULL OR p.jira_component = u.component))) GROUP BY 1, 2)"))
def unmapped_components(t: Tables) -> DataFrame:
    """Components that no row of the service map covers, with the newest texts of their items."""
    m = Model.of(t)
    w = m.core("work_item").select("project", F.explode("components").alias("component"), "summary", "created_at", "record_id")
    known = m.core("service_map").filter("jira_project is not null").select(F.col("jira_project").alias("project"), "jira_component").distinct()
    whole = known.filter("jira_component is null").select("project")
    w = w.join(whole, "project", "left_anti").join(known.filter("jira_component is not null").withColumnRenamed("jira_component", "component"), ["project", "component"], "left_anti")
    n = w.groupBy("project", "component").agg(F.count("*").alias("n"))
    top = J.top_n(w, ["project", "component"], 3, F.desc("created_at"), F.asc("record_id"))
    text = top.groupBy("project", "component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "summary"))), lambda x: x["summary"]), "|").alias("latest"))
    return n.join(text, ["project", "component"])


@query(model_sql.with_tables("SELECT entity, CASE WHEN b.record_id IS NULL THEN 'assign' WHEN b.content_hash <> c.content_hash THEN 'assign' ELSE 'keep' END AS step, count(*) n FROM cases c LEFT JOIN cases_before b USING (record_id) GROUP BY 1, 2"))
def incremental_clusters(t: Tables) -> DataFrame:
    """Members whose text is as before keep their cluster; new and changed ones are assigned."""
    before = raw(t, "cases_before").select("record_id", "content_hash")
    now = raw(t, "cases")
    kept = now.join(before, ["record_id", "content_hash"], "left_semi").withColumn("step", F.lit("keep"))
    rest = now.join(before, ["record_id", "content_hash"], "left_anti").withColumn("step", F.lit("assign"))
    return kept.unionByName(rest).groupBy("entity", "step").agg(F.count("*").alias("n"))


@query(model_sql.with_tables("SELECT record_id, count(*) OVER (PARTITION BY content_hash) AS same_content, dense_rank() OVER (PARTITION BY entity ORDER BY priority) AS level FROM cases"))
def content_groups(t: Tables) -> DataFrame:
    w = Window.partitionBy("entity").orderBy("priority")
    sizes = raw(t, "cases").groupBy("content_hash").agg(F.count("*").alias("same_content"))
    levels = raw(t, "cases").select("entity", "priority").distinct().withColumn("level", F.dense_rank().over(w))
    return raw(t, "cases").join(sizes, "content_hash").join(levels, ["entity", "priority"]).select("record_id", "same_content", "level")
