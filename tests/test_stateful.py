"""Timelines as streams: late rows, eviction, restarts, against the batch form."""

import random
from datetime import datetime, timedelta

import pytest

from tarnlake.streaming import stateful as S

T0 = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for k, v in S.stateful_conf.items():
        spark.conf.set(k, v)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def put(spark, folder, number, rows):
    """A file of transitions (key, minutes, category), older than the next by name and time."""
    import os

    df = spark.createDataFrame([(k, T0 + timedelta(minutes=m), c) for k, m, c in rows], "item string, ts timestamp, cat string")
    tmp = f"{folder}-tmp{number}"
    df.coalesce(1).write.parquet(tmp)
    os.makedirs(folder, exist_ok=True)
    part = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
    target = f"{folder}/{number:04d}.parquet"
    os.rename(f"{tmp}/{part}", target)
    os.utime(target, (1_700_000_000 + number, 1_700_000_000 + number))


def run(spark, folder, out, mark, **opts):
    src = spark.readStream.schema("item string, ts timestamp, cat string").option("maxFilesPerTrigger", 1).parquet(folder)
    q = S.timelines(src, "item", "ts", "cat", **opts).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()


def rows_of(df):
    return sorted((r["item"], r["since"], r["until"] or datetime.max, r["category"]) for r in df.collect())


def end(spark, folder, number):
    """Two rows of another key far in the future move the watermark over everything."""
    put(spark, folder, number, [("~", 10**6, "x")])
    put(spark, folder, number + 1, [("~", 2 * 10**6, "x")])


def test_a_stream_of_late_rows_gives_the_batch_timeline(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    r, rows = random.Random(1), []
    for k in range(240):
        rows.append((f"i{r.randrange(12)}", 10 * (k // 2), r.choice(["todo", "in_progress", "done"])))
    rows += [("i3", 100, "todo"), ("i3", 100, "done"), ("i3", 100, "in_progress")]
    arrival = sorted(rows, key=lambda x: x[1] + r.randrange(0, 55))  # up to 55 minutes late
    for n in range(6):
        put(spark, folder, n, arrival[n * 41 : (n + 1) * 41])
    end(spark, folder, 6)
    run(spark, folder, out, mark, lateness="1 hour", keep_days=9999)
    batch = S.timelines(spark.read.parquet(folder), "item", "ts", "cat", keep_days=9999)
    got = rows_of(spark.read.parquet(out))
    assert got == [x for x in rows_of(batch) if x[2] != datetime.max and x[0] != "~"]


def test_what_is_too_late_changes_nothing(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put(spark, folder, 0, [("a", 0, "todo"), ("a", 100, "done")])
    put(spark, folder, 1, [("b", 500, "todo")])
    put(spark, folder, 2, [("b", 510, "done")])
    put(spark, folder, 3, [("a", 50, "in_progress"), ("b", 505, "in_progress")])  # 50 is behind the watermark, 505 isn't
    end(spark, folder, 4)
    run(spark, folder, out, mark, lateness="30 minutes", keep_days=9999)
    got = [(k, (s - T0).seconds // 60, (u - T0).seconds // 60, c) for k, s, u, c in rows_of(spark.read.parquet(out)) if k != "~"]
    assert got == [("a", 0, 100, "todo"), ("b", 500, 505, "todo"), ("b", 505, 510, "in_progress")]


def test_keys_without_news_leave_with_an_open_interval(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    day = 24 * 60
    rows = [("a", 0, "todo"), ("a", 60, "in_progress"), ("b", 30, "todo"), ("b", 5 * day, "done"), ("c", 5 * day, "todo"), ("a", 9 * day, "todo")]
    for n, own in enumerate([rows[:3], rows[3:5], rows[5:]]):
        put(spark, folder, n, own)
    end(spark, folder, 3)
    run(spark, folder, out, mark, lateness="1 minute", keep_days=3)
    batch = S.timelines(spark.read.parquet(folder).filter("item <> '~'"), "item", "ts", "cat", keep_days=3)
    assert [x for x in rows_of(spark.read.parquet(out)) if x[0] != "~"] == rows_of(batch)
    state = spark.read.format("statestore").option("stateVarName", "open").load(mark)
    assert {r["key"][0] for r in state.collect()} <= {"~"}


def test_a_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put(spark, folder, 0, [("a", 0, "todo"), ("a", 40, "in_progress")])
    run(spark, folder, out, mark, lateness="1 hour", keep_days=9999)
    put(spark, folder, 1, [("a", 20, "done"), ("a", 400, "done")])
    run(spark, folder, out, mark, lateness="1 hour", keep_days=9999)
    end(spark, folder, 2)
    run(spark, folder, out, mark, lateness="1 hour", keep_days=9999)
    got = [((s - T0).seconds // 60, (u - T0).seconds // 60, c) for k, s, u, c in rows_of(spark.read.parquet(out)) if k == "a"]
    assert got == [(0, 20, "todo"), (20, 40, "done"), (40, 400, "in_progress")]


def test_category_at_a_time(spark):
    t = spark.createDataFrame([("a", T0, "todo"), ("a", T0 + timedelta(hours=2), "in_progress"), ("a", T0 + timedelta(hours=2), "done")], "item string, ts timestamp, cat string")
    asked = spark.createDataFrame([("a", T0 - timedelta(1)), ("a", T0), ("a", T0 + timedelta(hours=1)), ("a", T0 + timedelta(hours=2)), ("z", T0)], "item string, at timestamp")
    got = S.category_at(S.timelines(t, "item", "ts", "cat"), asked, "item", "at").orderBy("item", "at").collect()
    assert [r["category"] for r in got] == [None, "todo", "todo", "done", None]
