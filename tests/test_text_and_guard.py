import pytest
from pyspark.sql import functions as F

from tarnlake.operators import redact, text
from tarnlake.plans import guard
from tarnlake.plans import portfolio as P
from tarnlake.plans import recorded


def test_redaction_is_stable_and_repeatable(spark):
    r = redact.Redactor(b"k" * 32, ("Ada Lovelace",))
    raw = "ada lovelace (ada@x.org) card 4111 1111 1111 1111, 10.2.3.4, password: hunter2, E123456, +49 30 1234567"
    once, n = r.redact(raw)
    assert n == 7 and r.redact(once) == (once, 0)
    for secret in ("ada", "4111", "10.2.3.4", "hunter2", "E123456", "1234567"):
        assert secret not in once
    assert r.redact("ADA@x.org")[0] == r.redact("ada@X.org")[0]
    df = spark.createDataFrame([(1, raw), (2, None), (3, "clean")], "id int, t string")
    got = {x["id"]: (x["t"], x["n_redacted"]) for x in redact.redact(df, "t", b"k" * 32, ("Ada Lovelace",)).collect()}
    assert got == {1: (once, 7), 2: (None, 0), 3: ("clean", 0)}
    assert spark.range(1).select(redact.luhn_flag(F.lit("4111-1111-1111-1111"))).head()[0]


def test_bm25_prefers_rare_words_in_short_texts(spark):
    df = spark.createDataFrame([(1, "disk full disk"), (2, "disk " * 40), (3, "network down"), (4, "full moon")], "id int, t string")
    got = [r["id"] for r in text.bm25(df, "id", "t", ["disk", "full"], 3).orderBy("rank").collect()]
    assert got[0] == 1 and set(got) == {1, 2, 4}


def test_stratified_sample(spark):
    df = spark.range(100).withColumn("s", F.when(F.col("id") < 90, "big").otherwise("small"))
    got = text.stratified_sample(df, "id", "s", 20, 4, "x").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {"big": 15, "small": 5}


def test_guard(spark):
    t = {"items": spark.range(10).withColumnRenamed("id", "k")}
    rows, more = guard.run(spark, "WITH a AS (SELECT k FROM items WHERE k > :low) SELECT count(*) n FROM a", t, args={"low": 4})
    assert rows.head()["n"] == 5 and not more
    assert guard.run(spark, "SELECT k FROM items", t, cap=3)[1]
    ok = "SELECT k, row_number() OVER (ORDER BY k) r FROM items WHERE k IN (SELECT max(k) FROM items) AND coalesce(k, 0) BETWEEN 1 AND 20"
    assert guard.run(spark, ok, t)[0].count() == 1
    for bad in ("SELECT * FROM other", "SELECT * FROM other WHERE ', other as (' <> ''", "SELECT k FROM items WHERE k IN (SELECT k FROM other)", "WITH a AS (SELECT * FROM other) SELECT * FROM a", "SELECT input_file_name() FROM items", "SELECT java_method('a', 'b') FROM items", "DROP TABLE items", "SELECT 1; SELECT 2", "SELECT reflect('a', 'b')", "INSERT INTO items SELECT 1"):
        with pytest.raises(guard.Rejected):
            guard.run(spark, bad, t)


def test_portfolio_is_the_best_that_keeps_all_constraints():
    import itertools
    import math
    import random

    r = random.Random(4)
    for _ in range(40):
        ids = [f"k{i}" for i in range(9)]
        items = [P.Item(k, r.uniform(1, 50), r.choice([None, r.uniform(1, 20), r.uniform(1, 20)]), r.choice(["a", "b", None]), r.choice([None, 3.0, 5.5]), None, tuple(r.sample(ids[:j], 1)) if j and r.random() < 0.3 else (), tuple(r.sample(ids[j + 1 :], 1)) if j < 8 and r.random() < 0.3 else ()) for j, k in enumerate(ids)]
        limits = P.Limits(r.uniform(5, 70), r.choice([None, {"a": 8.0}]), 6.0, 1, frozenset(), frozenset(r.sample(ids, 1)))
        by = {i.id: i for i in items}

        def fits(own, by=by, limits=limits):
            if any(by[k].effort is None or k in limits.excluded for k in own) or sum(math.ceil(by[k].effort) for k in own) > math.floor(limits.budget):
                return False
            if any(b not in own for k in own for b in by[k].blockers) or any(d in own for k in own for d in by[k].descendants):
                return False
            if limits.capacity is not None:
                for t in ("a", "b"):
                    if sum(by[k].points or 0 for k in own if by[k].team == t) > limits.capacity.get(t, 6.0):
                        return False
            return True

        want = max(sum(math.floor(by[k].impact) for k in c) for n in range(10) for c in itertools.combinations(ids, n) if fits(set(c)))
        got = P.choose(items, limits)
        assert got.status == "optimal" and got.impact == want and fits(set(got.chosen))
        for k in got.chosen:
            assert all(got.order[b] < got.order[k] for b in by[k].blockers)


def test_work_order_breaks_cycles_and_binding_limits():
    items = [P.Item("a", 1, 1, blockers=("b",)), P.Item("b", 1, 1, blockers=("a",), priority=2.0), P.Item("c", 1, 1, blockers=("a",)), P.Item("d", 1, 9, priority=1.0)]
    order, cyclic = P.work_order(items)
    assert cyclic and order == {"d": 1, "b": 2, "a": 3, "c": 4}
    limits = P.Limits(3.0, mandatory=frozenset({"a"}))
    assert P.binding(items, ["a", "b", "c"], limits) == ["budget", "mandatory"]
    with pytest.raises(ValueError):
        P.choose(items, P.Limits(3.0, mandatory=frozenset({"x"})))


def test_recorded_queries_and_their_re_run(spark):
    t = {"items": spark.range(10).withColumnRenamed("id", "k")}
    e = recorded.run(spark, "SELECT k, k * 0.5 AS h -- half\n FROM items WHERE k > :low", t, {"low": 3}, sample=2)
    assert e["row_count"] == 6 and len(e["sample"]) == 2 and e["query_id"] == recorded.query_id("SELECT k,  k * 0.5 AS h FROM items WHERE k > :low", {"low": 3}, "current")
    assert recorded.verify(spark, e, t) and recorded.evidence(spark).filter(F.col("query_id") == e["query_id"]).count() == 1
    more = {"items": spark.range(11).withColumnRenamed("id", "k")}
    assert not recorded.verify(spark, e, more)
    with pytest.raises(ValueError):
        recorded.run(spark, "SELECT k, k * 0.5 AS h FROM items WHERE k > :low", more, {"low": 3})
    assert recorded.same_rows([(1, 2.0), (3, "x")], [(3, "x"), (1, 2.0000001)]) and not recorded.same_rows([(1,)], [(2,)])
    assert recorded.numbers("about 12.5% of 3k") == [(0.125, 0.0005), (3000.0, 500.0)] and recorded.supported(0.125, 0.0005, [0.1253])
    assert recorded.uncited("5 of [[n1]] 7 [[n2]]") == ["5"]
