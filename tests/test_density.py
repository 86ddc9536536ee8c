"""Prototypes, HDBSCAN and members against plain versions."""

import numpy as np
import pytest

from tarnlake.operators import density


def plain_hdbscan(x, mcs, ms):
    """By the definition: Prim's tree, then splits from the heaviest edge down, by walking the tree's parts."""
    n = len(x)
    d = np.array([density.squared(x, p) for p in x])
    order = [sorted(range(n), key=lambda j, i=i: (j != i, d[i, j], j)) for i in range(n)]
    core = np.array([d[i, order[i][min(ms, n) - 1]] for i in range(n)])
    w = np.maximum(np.maximum(core[:, None], core[None]), d)
    key = lambda i, j: (w[i, j], min(i, j), max(i, j))
    inside, best, edges = {0}, {j: (key(0, j), 0) for j in range(1, n)}, []
    while best:
        j = min(best, key=lambda j: best[j][0])
        edges.append(best.pop(j)[0])
        inside.add(j)
        for k in best:
            if key(j, k) < best[k][0]:
                best[k] = (key(j, k), j)
    edges.sort()
    least = min((e[0] for e in edges if e[0] > 0), default=4.0) / 4
    lam = lambda e: 1 / np.sqrt(max(e[0], least))

    def parts(points, own):
        links = {p: [] for p in points}
        for _, a, b in own:
            links[a].append(b)
            links[b].append(a)
        seen, stack = set(), [next(iter(points))]
        while stack:
            p = stack.pop()
            if p not in seen:
                seen.add(p)
                stack += links[p]
        return seen, points - seen

    clusters = []  # points at birth, birth, mass, falls {point: density}, children, last

    def grow(points, own, born):
        c = {"points": points, "born": born, "mass": 0.0, "falls": {}, "kids": [], "last": 0.0}
        clusters.append(c)
        while own:
            e = own[-1]
            a, b = parts(points, own[:-1])
            at = lam(e)
            big = [s for s in (a, b) if len(s) >= mcs]
            for s in (a, b):
                if s not in big:
                    for p in s:
                        c["falls"][p] = at
                        c["mass"] += at - born
                        c["last"] = max(c["last"], at)
            if len(big) == 2:
                for s in big:
                    c["mass"] += (at - born) * len(s)
                    c["last"] = max(c["last"], at)
                c["kids"] = [grow(s, [f for f in own[:-1] if f[1] in s], at) for s in big]
                return c
            if not big:
                return c
            points, own = big[0], [f for f in own[:-1] if f[1] in big[0]]
        return c

    root = grow(set(range(n)), edges, 0.0)

    def choose(c):
        below = [choose(k) for k in c["kids"]]
        mass = sum(b[0] for b in below)
        if c is not root and mass <= c["mass"]:
            return c["mass"], [c]
        return mass, [x for b in below for x in b[1]]

    labels, prob = np.full(n, -1), np.zeros(n)
    for k, c in enumerate(sorted(choose(root)[1], key=lambda c: min(c["points"]))):
        falls, stack = {}, [c]
        while stack:
            s = stack.pop()
            falls |= s["falls"]
            stack += s["kids"]
        for p in c["points"]:
            labels[p], prob[p] = k, min(falls[p], c["last"]) / c["last"]
    return labels, prob


def blobs(seed, sizes, dims, noise):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(r.uniform(-8, 8, dims), r.uniform(0.2, 1.2), (n, dims)) for n in sizes] + [r.uniform(-10, 10, (noise, dims))])
    return x[r.permutation(len(x))]


@pytest.mark.parametrize("seed,sizes,dims,noise,mcs,ms", [(1, [60, 40, 25], 2, 30, 5, 3), (2, [30] * 6, 8, 40, 10, 1), (3, [80], 3, 20, 4, 5), (4, [5] * 12, 2, 0, 5, 3)])
def test_labels_match_plain_version(spark, seed, sizes, dims, noise, mcs, ms):
    x = blobs(seed, sizes, dims, noise)
    labels, prob = density.hdbscan(spark, x, mcs, ms)
    want = plain_hdbscan(x, mcs, ms)
    assert (labels == want[0]).all() and np.allclose(prob, want[1])


def test_two_thousand_points(spark):
    x = blobs(5, [300, 250, 200, 150, 100, 80, 60, 40, 20], 6, 800)
    labels, prob = density.hdbscan(spark, x, 15, 5)
    want = plain_hdbscan(x, 15, 5)
    assert labels.max() >= 5 and (labels == want[0]).all() and np.allclose(prob, want[1])


def test_grids_and_repeated_points(spark):
    grid = np.array([(i, j) for i in range(8) for j in range(8)], float)  # all distances tie
    x = np.concatenate([grid, grid[:20], grid + 100])
    labels, prob = density.hdbscan(spark, x, 5, 3)
    want = plain_hdbscan(x, 5, 3)
    assert (labels == want[0]).all() and np.allclose(prob, want[1])
    same = np.ones((12, 3))
    assert set(density.hdbscan(spark, same, 5, 3)[0]) == {-1}  # one lump is the whole, which is no cluster
    for n in (0, 1, 2):
        assert list(density.hdbscan(spark, np.ones((n, 2)), 5, 3)[0]) == [-1] * n


def test_boundaries(spark, monkeypatch):
    monkeypatch.setattr(density, "MOST_POINTS", 10)
    with pytest.raises(ValueError, match="prototypes"):
        density.hdbscan(spark, np.zeros((11, 2)))
    with pytest.raises(ValueError):
        density.hdbscan(spark, np.zeros((3, 2)), min_cluster_size=1)


@pytest.fixture(scope="module")
def directions(spark):
    r = np.random.default_rng(9)
    centres = density._unit(r.normal(size=(6, 12)))
    rows = [(i, [float(v) for v in centres[i % 6] + 0.05 * r.normal(size=12)], i % 6) for i in range(600)]
    rows += [(1000 + i, [float(v) for v in r.normal(size=12)], -1) for i in range(60)]
    return spark.createDataFrame(rows, "id long, v array<double>, truth int").repartition(5)


def test_prototypes_serve_all_vectors(spark, directions):
    protos, assigned = density.spherical_kmeans(directions, "id", "v", 24, iters=6)
    assert len(protos) == 24 and np.allclose(np.linalg.norm(protos, axis=1), 1)
    got = assigned.collect()
    x = {r["id"]: density._unit(np.array([r["v"]]))[0] for r in directions.collect()}
    assert len(got) == 660
    for g in got:
        s = protos @ x[g["id"]]
        assert g["proto"] == s.argmax() and g["similarity"] == pytest.approx(s.max())
    again, _ = density.spherical_kmeans(directions.repartition(2), "id", "v", 24, iters=6)
    assert np.allclose(protos, again)


def test_empty_prototypes_are_placed_on_the_worst_served(spark, monkeypatch):
    rows = [(i, [1.0, 0.001 * (i % 3)]) for i in range(30)] + [(90, [-1.0, 0.2]), (91, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    start = density._unit(np.array([[1.0, 0.0], [0.0, 1.0], [0.1, 1.0]]))
    monkeypatch.setattr(density, "seeds", lambda *a: start)
    protos, assigned = density.spherical_kmeans(df, "id", "v", 3, iters=8)
    own = {r["id"]: r["proto"] for r in assigned.collect()}
    assert len({own[0], own[90], own[91]}) == 3


def test_clusters_of_all_vectors(spark, directions):
    out = {r["id"]: (r["cluster_id"], r["probability"]) for r in density.density_clusters(directions, "id", "v", 60, min_cluster_size=3, min_samples=2, least=0.7, full=0.95, min_members=25).collect()}
    truth = {r["id"]: r["truth"] for r in directions.collect()}
    groups = {}
    for i, (c, p) in out.items():
        assert (p > 0) <= (c >= 0)
        if c >= 0 and truth[i] >= 0:
            groups.setdefault(c, set()).add(truth[i])
    assert len(out) == 660 and len(groups) == 6 and all(len(g) == 1 for g in groups.values())
    assert sorted({c for c, _ in out.values() if c >= 0}) == list(range(6))
    assert sum(c < 0 for i, (c, _) in out.items() if truth[i] < 0) > 30


def test_members_ramp_and_prune(spark):
    rows = [(1, 0, 0.9), (2, 0, 0.7), (3, 0, 0.5), (4, 1, 0.9), (5, 2, 0.9), (6, 2, 0.8), (7, 3, 0.99)]
    a = spark.createDataFrame(rows, "id long, proto int, similarity double")
    got = {r["id"]: (r["cluster_id"], round(r["probability"], 6)) for r in density.members(a, np.array([0, 1, 2, -1]), np.array([1.0, 0.5, 0.8, 0.0]), 0.6, 0.8, 2).collect()}
    assert got == {1: (0, 1.0), 2: (0, 0.5), 3: (-1, 0.0), 4: (-1, 0.0), 5: (1, 0.8), 6: (1, 0.8), 7: (-1, 0.0)}


def test_new_and_changed_vectors_join_kept_members(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], False), (2, [0.0, 1.0], True), (3, [0.7, 0.72], True), (4, [-1.0, 0.0], True), (6, None, True)], "id long, v array<double>, changed boolean")
    known = spark.createDataFrame([(1, "b", 0.4), (2, "a", 0.9), (5, "a", 1.0)], "id long, cluster_id string, probability double")
    got = {r["id"]: (r["cluster_id"], r["kept"]) for r in density.extended(df, "id", "v", np.array([[1.0, 0.0], [0.0, 2.0]]), ["a", "b"], known, "changed").collect()}
    assert got == {1: ("b", True), 2: ("b", False), 3: ("b", False), 4: (None, False)}
