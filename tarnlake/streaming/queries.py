"""The stream operators run over the events table to its end, and what they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.plans.adapter import Tables
from tarnlake.plans.relational import query
from tarnlake.store import new_path
from tarnlake.sources import manifest, paged
from tarnlake.streaming import merge, stateful


def folder(t: Tables) -> str:
    """A new folder under the shared one."""
    return new_path(t.spark, "stream")


def events(t: Tables) -> DataFrame:
    df = t.spark.readStream.schema(t.raw("events").schema).parquet(f"{t.dir}/events.parquet*")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) k FROM events) SELECT user_id, event_id, event_type FROM r WHERE k = 1""")
def stream_latest(t: Tables) -> DataFrame:
    base = folder(t)
    merge.start_merge(events(t), f"{base}/table", f"{base}/mark", "user_id", ["ts", "event_id"]).awaitTermination()
    return merge.current(t.spark, f"{base}/table").select("user_id", "event_id", "event_type")


@query("""WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR w FROM events) SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) n FROM events GROUP BY 1, 2 HAVING date_trunc('hour', max(ts)) + INTERVAL 1 HOUR <= (SELECT w FROM m)""")
def stream_hourly_counts(t: Tables) -> DataFrame:
    """Hours that the watermark has closed; a bounded source ends with the last ones open."""
    base = folder(t)
    counts = merge.windowed_counts(events(t), "ts", "1 hour", "1 hour", ["event_type"])
    out = counts.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/mark").trigger(availableNow=True).start()
    out.awaitTermination()
    done = t.spark.read.schema(counts.schema).parquet(f"{base}/out")
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT CAST(event_id AS VARCHAR) AS source_key, CAST(ts AS TIMESTAMP) AS updated_at, event_type AS kind FROM events""")
def synced_events(t: Tables) -> DataFrame:
    """Events behind a paged API: a first fill up to the middle of their time, then a sync from the watermark to its end."""
    e = t.events().withColumn("ts", F.col("ts").cast("timestamp"))
    base = folder(t)
    paged.record(e.select(F.col("event_id").cast("string").alias("source_key"), F.col("ts").alias("updated_at"), F.lit(False).alias("deleted"), F.to_json(F.struct("event_type")).alias("payload")), f"{base}/api")
    first, last = e.agg(F.min("ts"), F.max("ts")).head()
    if first is None:
        return t.spark.createDataFrame([], "source_key string, updated_at timestamp_ntz, kind string")
    for now in (first + (last - first) / 2, last + (last - first)):
        paged.sync(t.spark, f"{base}/table", f"{base}/mark", kind="documents", path=f"{base}/api", start=first.isoformat(), now=now.isoformat(), settle_minutes=0, page=500, slice_days=2)
    out = manifest.rows(t.spark, f"{base}/table")
    return out.select("source_key", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), F.get_json_object("payload", "$.event_type").alias("kind"))


@query("""WITH r AS (SELECT user_id, date_trunc('millisecond', ts) AS since, event_type, row_number() OVER (PARTITION BY user_id, date_trunc('millisecond', ts) ORDER BY event_type DESC) k FROM events), w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events),
i AS (SELECT user_id, since, lead(since) OVER (PARTITION BY user_id ORDER BY since) AS until, event_type AS category FROM r WHERE k = 1) SELECT user_id, since, until, category FROM i WHERE until <= (SELECT mark FROM w)""")
def stream_timelines(t: Tables) -> DataFrame:
    """What each user did last, over time: the intervals that the watermark has closed."""
    base, name = folder(t), "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(name)
    t.spark.conf.set(name, stateful.stateful_conf[name])
    try:
        lines = stateful.timelines(events(t), "user_id", "ts", "event_type", "1 hour", keep_days=36_500)
        lines.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/mark").trigger(availableNow=True).start().awaitTermination()
    finally:
        t.spark.conf.set(name, before)
    done = t.spark.read.schema(lines.schema).parquet(f"{base}/out")
    return done.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("since", "until")], "category")
