"""Prefix tries, vector codes and mixes, against plain versions."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import mix, prefix_trie, vector_codes

SF = "/root/testdata/sf0.001"


# -- prefix trie ----------------------------------------------------------------
def trie_rows(df, **opts):
    return sorted(map(tuple, prefix_trie.prefix_trie(df, **opts).drop("families").collect()), key=repr)


def talk(seed, convs, alphabet, longest=6, step=1):
    r = random.Random(seed)
    texts = ["", None, "a", "two words", " \t", "é x\x1cy\nz"][:alphabet]
    rows = []
    for c in range(0, convs * step, step):
        for t in range(r.randrange(1, longest)):
            rows.append((c, t if r.random() < 0.9 else None, r.choice(["user", "assistant", None]), r.choice(texts)))
    r.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,convs,alphabet,step", [(1, 150, 2, 1), (2, 90, 5, 7), (3, 60, 1, 20), (4, 40, 3, 3)])
def test_trie_matches_plain_version(spark, seed, convs, alphabet, step):
    rows = talk(seed, convs, alphabet, step=step)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit(1)).withColumn("key", F.lit("x")).repartition(3)
    assert trie_rows(df) == sorted(brute.prefix_trie(rows), key=repr)


@pytest.mark.parametrize("most_turns", [0, 7, 30])
def test_streamed_families_give_the_same_trie(spark, most_turns):
    rows = talk(5, 120, 3)
    assert trie_rows(spark.createDataFrame(rows, SCHEMA), most_turns=most_turns) == sorted(brute.prefix_trie(rows), key=repr)


def test_deep_copies_across_families(spark):
    base = [(0, t, "user", f"turn {t}") for t in range(70)]
    rows = base + [(c, t, "user", f"turn {t}") for c in (19, 40, 41, 77) for t in range(70 - c % 3)] + [(5, 0, "user", "turn 0")]
    assert trie_rows(spark.createDataFrame(rows, SCHEMA)) == sorted(brute.prefix_trie(rows), key=repr)


def test_trie_of_one_common_conversation(spark):
    rows = [(c, t, "user", "same words here") for c in range(400) for t in range(3)]
    assert trie_rows(spark.createDataFrame(rows, SCHEMA)) == sorted(brute.prefix_trie(rows), key=repr)


def test_trie_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(empty).collect() == []
    # the base is missing, the one turn is cut off: only the root is left
    alone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [(alone, 0, "user", "x"), (None, 0, "user", "y")]
    got = trie_rows(spark.createDataFrame(rows, SCHEMA))
    assert got == brute.prefix_trie(rows) and len(got) == 1 and got[0][:2] == (alone, 0)
    rows = [(-25, 1, "a", "b c"), (-20, 0, "u", "w"), (-21, None, None, None), (3, 2, "x" * 50_000, "long " * 50_000), (3, 2, "x" * 50_000, "long " * 50_000)]
    got = trie_rows(spark.createDataFrame(rows, SCHEMA))
    assert {(g[0], g[3]) for g in got if g[1] == 0} == {(-25, 4)}
    assert max(g[1] for g in got) == max(1, *(n - min(n, zlib.crc32(str(c).encode()) % 4) + min(m, zlib.crc32(str(c).encode()) % 4) for c, n, m in ((-25, 1, 1), (-21, 1, 1), (3, 2, 0))))


# -- vector codes ---------------------------------------------------------------
def code_rows(df, **opts):
    return sorted(map(tuple, vector_codes.vector_codes(df, **opts).collect()), key=repr)


def test_tree_finds_the_nearest_entry_and_the_lower_index():
    r = np.random.default_rng(3)
    for entries, width, spread in [(16, 8, 3), (16, 8, 4000), (200, 4, 2), (1, 2, 9), (5, 1, 1 << 23), (64, 2, 6)]:
        book = r.integers(-spread, spread + 1, (entries, width))
        book[entries // 2 :] = book[: entries - entries // 2]  # repeated entries
        x = np.concatenate([r.integers(-spread, spread + 1, (500, width)), book])
        d = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        got = vector_codes.Tree(book, leaf=2).nearest(x)
        assert (got[0] == d.argmin(axis=1)).all() and (got[1] == d.min(axis=1)).all()


def test_tree_leaves_entries_out():
    r = np.random.default_rng(4)
    book = np.concatenate([r.integers(0, 50, (32, 4)) + 1000 * k for k in range(8)])
    tree, looks = vector_codes.Tree(book), []
    look = tree._look
    tree._look = lambda e, rows, *a: (looks.append(len(rows)), look(e, rows, *a))[1]
    tree.nearest(book)
    assert sum(looks) < len(book) ** 2 / 3


def test_codes_match_plain_version(spark):
    r = random.Random(6)
    vec = lambda: [r.choice([0.0, -0.25, 0.1, 1.0, 2.5, -3.0, 1e-7, -1e-7]) for _ in range(16)]
    rows = [(i, vec(), r.choice([None, 1, 2, 2, 2])) for i in range(120)]
    rows += [(200, None, 1), (201, [None] + [0.5] * 15, 1), (202, [float("nan")] + [0.5] * 15, 2), (203, [float("inf")] * 16, None), (None, vec(), 7), (50, rows[50][1], 2), (300, rows[3][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).withColumn("error", F.lit(0)).repartition(3)
    as_float = [(i, v and [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert code_rows(df) == sorted(brute.vector_codes(as_float), key=repr)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert code_rows(spark.createDataFrame([], schema)) == []
    assert code_rows(spark.createDataFrame([(1, None, "a"), (2, [], "a"), (3, [1.0] * 5, None)], schema)) == []
    few = [(i, [float(i)] * 8, None if i else "") for i in range(5)]  # the empty label is none of the nulls
    assert code_rows(spark.createDataFrame(few, schema)) == sorted(brute.vector_codes(few), key=repr)
    other = [(1, [0.5] * 8, "a"), (2, [0.25] * 8, "a"), (3, [0.5] * 16, "a")]
    assert [g[0] for g in code_rows(spark.createDataFrame(other, schema))] == [1, 2]
    with pytest.raises(Exception, match="beyond"):
        code_rows(spark.createDataFrame([(1, [1e30] * 8, "a")], schema))


def test_codes_decode_to_entries(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    codes, books = vector_codes.compress(df)
    got = vector_codes.decode(codes, books).join(df.select("vec_id", "embedding"), "vec_id").collect()
    for r in got:
        off = np.floor(np.array(r["embedding"], dtype=np.float64) * 4096) - np.array(r["vector"]) * 4096
        assert int((off**2).sum()) == r["error"]


# -- mix ------------------------------------------------------------------------
def mix_checked(rows, docs, **opts):
    got = mix.mixture(docs, **opts).collect()
    want: dict = {}
    for _, text, source in rows:
        want[source] = want.get(source, 0) + len(brute.words(text))
    goal = brute.mix_targets(want)
    of = {i: s for i, _, s in rows}
    taken: dict = {}
    assert len(got) == len(rows)
    largest = max([len(brute.words(t)) for _, t, _ in rows], default=0)
    for g in got:
        s = of[g["doc_id"]]
        assert g["source_size"] == want[s] and g["target"] == pytest.approx(goal[s])
        assert g["taken"] == g["copies"] * g["size"] <= 2 * g["size"]
        assert not want[s] or int(goal[s] / want[s]) <= g["copies"] <= -int(-goal[s] // want[s])
        taken[s] = taken.get(s, 0) + g["taken"]
    for s in want:
        assert abs(taken[s] - goal[s]) <= 1.5 * largest
    return got


def corpus(seed, n, sources):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 30, 30, 200])) if r.random() > 0.05 else None, r.choice(sources)) for i in range(n)]
    return rows


@pytest.mark.parametrize("sources", [["a"], [None], ["a", "b", "c", None], ["hot"] * 30 + [f"s{k}" for k in range(12)] + [None, "é", "漢", ""]])
def test_mix_matches_targets(spark, sources):
    rows = corpus(7, 600, sources)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("name", F.lit(1))
    a = mix_checked(rows, docs.repartition(5))
    b = mix_checked(rows, docs.repartition(2, "doc_id"))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_mix_of_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mix.mixture(spark.createDataFrame([], schema)).collect() == []
    got = mix.mixture(spark.createDataFrame([(1, None, None), (None, "", "a")], schema)).collect()
    assert sorted((g["size"], g["target"], g["taken"]) for g in got) == [(0, 0.0, 0)] * 2
    # repeated rows each expect 1.5 copies
    same = spark.createDataFrame([(7, "two words", "a")] * 1000, schema).repartition(4)
    got = mix.mixture(same).collect()
    assert {g["copies"] for g in got} == {1, 2} and abs(sum(g["taken"] for g in got) - 3000) <= 2


def test_mixed_rows_are_the_taken_ones(spark):
    rows = corpus(8, 300, ["a", "a", "b", None])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row_id", F.lit(5))
    want = {g["doc_id"]: g["copies"] for g in mix.mixture(docs).collect() if g["copies"]}
    out = mix.mixed(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == want


def test_mix_plan_has_no_python(spark):
    plan = mix.mixture(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
