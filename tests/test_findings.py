"""Duplicate findings and Kendall's tau against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.operators import concordance, findings

SCHEMA = "finding_id string, entity_type string, entity_id string, confidence double, created_at int, numbers array<struct<query_id:string,column:string,row_key:string>>, query_ids array<string>, vector array<double>"


def some(seed, n, entities):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        numbers = [(f"q{r.randrange(4)}", r.choice("ab"), str(r.randrange(6))) for _ in range(r.randrange(4))]
        v = np.array([r.gauss(0, 1), r.gauss(0, 1), 1.5])
        rows.append((f"f{k:04d}", "team", f"t{r.randrange(entities)}", r.choice([0.2, 0.5, 0.9]), r.randrange(50), numbers, [r.choice(["q1", "q2"])] * r.randrange(1, 3), [float(x) for x in v / np.linalg.norm(v)] if r.random() < 0.9 else None))
    return rows


def plain(rows, cosine, most):
    groups, out = {}, set()
    for r in rows:
        groups.setdefault(r[1:3], []).append(r)
    for key, own in groups.items():
        own = sorted(own, key=lambda r: (-r[3] * len(r[5]), r[4], r[0]))[:most]
        label = list(range(len(own)))
        for _ in own:
            for i, a in enumerate(own):
                for j, b in enumerate(own):
                    says = set(a[6]) == set(b[6]) if cosine is None else a[7] is not None and b[7] is not None and float(np.dot(a[7], b[7])) >= cosine
                    if set(a[5]) & set(b[5]) and says:
                        label[i] = label[j] = min(label[i], label[j])
        out |= {(*key, own[label[i]][0], own[i][0]) for i in range(len(own)) if label[i] != i}
    return out


@pytest.mark.parametrize("cosine,most,entities", [(None, 200, 4), (0.9, 200, 2), (None, 10, 3), (0.5, 200, 60)])
def test_duplicates_match_plain_version(spark, cosine, most, entities):
    rows = some(int(most + entities), 160, entities)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {tuple(r) for r in findings.duplicates(df, least_cosine=cosine, most=most).collect()}
    assert got == plain(rows, cosine, most) and got


def test_long_chains_and_no_findings(spark):
    edges = [("g", k, k + 1) for k in range(150)] + [("h", 5, 9), ("h", 9, 5), ("h", 7, 7)]
    got = {(r["g"], r["node"]): r["label"] for r in findings.least_labels(spark.createDataFrame(edges, "g string, a long, b long"), ["g"]).collect()}
    assert all(got["g", k] == 0 for k in range(151)) and got["h", 9] == 5 and got["h", 7] == 7
    assert findings.duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_tau(rows):
    own = [(x, y) for x, y in rows if x is not None and y is not None]
    s = tx = ty = n = 0
    for i in range(len(own)):
        for j in range(i):
            a, b = np.sign(own[i][0] - own[j][0]), np.sign(own[i][1] - own[j][1])
            s, tx, ty, n = s + a * b, tx + (a == 0), ty + (b == 0), n + 1
    return s / math.sqrt((n - tx) * (n - ty)) if (n - tx) * (n - ty) else None


@pytest.mark.parametrize("xs,ys,n,ranges", [(1000, 1000, 300, 7), (5, 9, 400, 3), (2, 1000, 200, 16), (1000, 2, 200, 4), (1, 5, 30, 4), (400, 400, 2, 4)])
def test_tau_matches_all_pairs(spark, xs, ys, n, ranges):
    r = random.Random(n + xs)
    rows = [(r.randrange(xs) if r.random() > 0.02 else None, r.randrange(ys)) for _ in range(n)]
    rows += [(3, 4)] * (n // 3)  # a third of all rows are one pair
    got = concordance.kendall_tau(spark.createDataFrame(rows, "x int, y int").repartition(5), "x", "y", ranges)
    want = plain_tau(rows)
    assert got == pytest.approx(want, abs=1e-12) if want is not None else got is None


def test_tau_ends_and_empty(spark):
    up = spark.range(500).select(F.col("id").alias("x"), (F.col("id") * 3).alias("y"), (-F.col("id")).alias("z"))
    assert concordance.kendall_tau(up, "x", "y") == 1.0 and concordance.kendall_tau(up, "x", "z") == -1.0
    assert concordance.kendall_tau(up.filter("x < 0"), "x", "y") is None


def test_inversions_are_exact():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 257):
        y, w = r.integers(0, 9, n), r.integers(1, 5, n)
        assert concordance.inversions(y, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if y[i] > y[j])
    assert concordance.inversions(np.array([2, 1]), np.array([1 << 40, 1 << 40])) == 1 << 80
