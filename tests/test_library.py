"""Operators against small cases: lake rules, as-of ties, closures, scales, merges."""

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import columns as X
from tarnlake.operators import aggregates as A
from tarnlake.operators import joins as J
from tarnlake.plans import registry
from tarnlake.sources import files, lake
from tarnlake.streaming import merge


def one(spark, expr):
    return spark.range(1).select(expr).head()[0]


def test_leading_integers_and_durations(spark):
    assert [one(spark, X.lead_int(F.lit(t), 1, 5)) for t in ("1 - Critical", "5", "9 - x", "x1", "", None)] == [1, 5, None, None, None, None]
    assert one(spark, X.duration_seconds(F.lit("1970-01-02 00:00:01"))) == 86401
    assert one(spark, X.duration_seconds(F.lit("77"))) == 77


def test_times_flags_and_numbers(spark):
    assert str(one(spark, X.to_utc(F.lit("2024-03-01T10:00:00+02:00")))) == "2024-03-01 08:00:00"
    assert one(spark, X.to_utc(F.lit("no time"))) is None
    assert [one(spark, X.to_flag(F.lit(t))) for t in ("Yes", "0", "maybe")] == [True, False, None]
    assert [one(spark, X.to_finite(F.lit(t))) for t in ("1.5", "NaN", "Infinity", "x")] == [1.5, None, None, None]
    assert one(spark, X.json_names(F.lit('[{"name":"a"},{"name":null},{}]'))) == ["a"]


def test_latest_hides_versions_older_than_a_tombstone(spark):
    rows = [("a", 1, 1, False), ("a", 2, 1, True), ("b", 1, 1, False), ("b", 1, 2, False), ("c", 1, 1, False)]
    df = spark.createDataFrame(rows, "_record_id string, _source_updated_at int, _fetched_at int, _deleted boolean").withColumn("_file", F.lit("f"))
    gone = spark.createDataFrame([("c",)], "_record_id string")
    assert [(r["_record_id"], r["_fetched_at"]) for r in lake.latest(df, gone).collect()] == [("b", 2)]


def test_lake_contract_and_reconcile(spark, tmp_path):
    raw = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    rec = files.as_records(raw, "files", "costs", ["k"], "2024-01-02 00:00:00")
    assert lake.violations(rec) == {}
    path = str(tmp_path / "lake")
    lake.append(rec, path)
    back = lake.scan(spark, path, ["v", "missing"])
    assert back.count() == 2 and back.filter("missing is not null").count() == 0
    with pytest.raises(ValueError):
        lake.append(rec.withColumn("_source_key", F.lit(None).cast("string")), path)
    keys = spark.createDataFrame([("1",)], "_source_key string")
    assert [r["_record_id"] for r in lake.reconcile(back, keys, most_share=0.5).collect()] == ["files:costs:2"]
    with pytest.raises(ValueError):
        lake.reconcile(back, keys, most_share=0.1)
    assert files.slices(spark, "2024-01-01", "2024-01-10", 4).count() == 3


def test_as_of_takes_the_highest_rank_at_an_instant(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, at int")
    right = spark.createDataFrame([("a", 2, "todo", 0), ("a", 4, "open", 1), ("a", 4, "done", 3)], "k string, since int, cat string, r int")
    got = {(r["k"], r["at"]): r["cat"] for r in J.as_of(left, right, "k", "at", "since", ["cat"], rank="r").collect()}
    assert got == {("a", 5): "done", ("a", 1): None, ("b", 9): None}


def test_either_key_joins_whole_tables(spark, tmp_path):
    s, c = [(i, i % 4 if i % 7 else None) for i in range(1, 60)], [(i, i % 5) for i in range(1, 300)]
    spark.createDataFrame(s, "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame(c, "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    got = sorted(tuple(r) for r in registry.queries()["either_key_join"](spark, str(tmp_path)).collect())
    assert got == sorted((a, b, 0 if x == y else 1) for a, x in s for b, y in c if x == y or a == b)


def test_closure_ends_at_a_cycle(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "n string, p string")
    got = {(r["n"], r["ancestor"]): r["depth"] for r in J.closure(df, "n", "p", 4).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("b", "b"): 0, ("b", "a"): 1, ("c", "c"): 0}


def test_robust_scale_without_spread(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 1.0), ("g", 1.0), ("h", 0.0), ("h", 0.0), ("h", 0.0), ("h", 8.0)], "k string, v double")
    got = {(r["k"], r["v"]): r["z"] for r in A.robust_scale(df, ["k"], "v").collect()}
    assert got["g", 1.0] == 0.0 and got["h", 8.0] == pytest.approx(8 / (1.2533 * 2))


def test_row_set_hash_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    assert A.row_set_hash(df).head() == A.row_set_hash(df.orderBy(F.desc("id"))).head()
    assert A.row_set_hash(df).head() != A.row_set_hash(df.filter("id > 0")).head()


def test_stream_merge_keeps_the_newest_and_repeats_safely(spark, tmp_path):
    src, table, mark = (str(tmp_path / x) for x in ("src", "table", "mark"))
    schema = "k string, at int, v string"
    for rows in ([("a", 1, "x"), ("b", 5, "y")], [("a", 3, "z"), ("b", 2, "late")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        merge.start_merge(stream, table, mark, "k", ["at"]).awaitTermination()
    assert {(r["k"], r["v"]) for r in merge.current(spark, table).collect()} == {("a", "z"), ("b", "y")}


def test_category_states_ignore_late_steps(spark, tmp_path):
    src = str(tmp_path / "steps")
    schema = "item string, at timestamp, category string"
    rows = spark.createDataFrame([("a", "2024-01-02", "done"), ("a", "2024-01-01", "todo"), ("b", "2024-01-05", "open")], "item string, at string, category string")
    rows.select("item", F.col("at").cast("timestamp").alias("at"), "category").coalesce(1).write.parquet(src)
    states = merge.category_states(spark.readStream.schema(schema).parquet(src), "item", "at", "category")
    states.writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "mark")).start().awaitTermination()
    assert {(r["item"], r["category"]) for r in spark.table("states").collect()} == {("a", "done"), ("b", "open")}
