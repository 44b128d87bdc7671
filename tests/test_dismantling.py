"""Removal sets against plain Python over small graphs."""

import random

import numpy as np
import pytest

from spreadframe.core import undirected
from spreadframe.operators import dismantling

from .test_graph_operators import graph

TREE = [(i, (i * 7 + 3) % i) for i in range(1, 24)]
PATH = [(30 + i, 31 + i) for i in range(9)]
STAR = [(50, 50 + i) for i in range(1, 6)] + [(60, 61)]


def near_of(arcs):
    near = {}
    for a, b in arcs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def parts_of(near, gone=()):
    left, out = set(near) - set(gone), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            v = todo.pop()
            part.add(v)
            for w in near[v] & left:
                left.discard(w)
                todo.append(w)
        out.append(part)
    return out


def both_ways(spark, arcs):
    return undirected(graph(spark, arcs, 1).edges)


def plain_breaking(near, k, gone=()):
    out, gone = [], set(gone)
    while len(out) < k:
        options = []
        for part in parts_of(near, gone):
            if len(part) >= 3:
                biggest = {v: max((len(p) for p in parts_of({u: near[u] & part for u in part}, {v})), default=0) for v in part}
                v = min(part, key=lambda u: (biggest[u], u))
                options.append((-len(part), v))
        if not options:
            break
        out.append(min(options)[1])
        gone.add(out[-1])
    return out


def plain_core(near, gone):
    core = {v: near[v] - set(gone) for v in near if v not in gone}
    while low := [v for v in core if len(core[v]) <= 1]:
        for v in low:
            for w in core.pop(v):
                if w in core:
                    core[w].discard(v)
    return core


def plain_decycled(near, k, gone=()):
    out = list(gone)
    while len(out) < k and (core := plain_core(near, out)):
        out.append(min(core, key=lambda v: (-len(core[v]), v)))
    return out


def test_tree_sizes_and_centroids(spark):
    arcs = TREE + PATH + STAR
    near, rows = near_of(arcs), {r["node"]: r for r in dismantling.tree_sizes(both_ways(spark, arcs)).collect()}
    assert set(rows) == set(near)
    for v, r in rows.items():
        below = [w for w in rows if rows[w]["parent"] == v]
        assert r["size"] == 1 + sum(rows[w]["size"] for w in below)
    assert sorted(r["size"] for r in rows.values() if r["parent"] is None) == [2, 6, 10, 24]
    got = {r["node"]: (r["n"], r["biggest"]) for r in dismantling.centroids(both_ways(spark, arcs)).collect()}
    want = {}
    for part in parts_of(near):
        if len(part) >= 3:
            biggest = {v: max(len(p) for p in parts_of({u: near[u] & part for u in part}, {v})) for v in part}
            v = min(part, key=lambda u: (biggest[u], u))
            want[v] = (len(part), biggest[v])
    assert got == want


def test_a_cycle_is_no_forest(spark):
    with pytest.raises(ValueError, match="cycle"):
        dismantling.tree_sizes(both_ways(spark, [(0, 1), (1, 2), (2, 0), (2, 3)]))


@pytest.mark.parametrize("k", [4, 50])
def test_broken_trees_are_the_picks_one_by_one(spark, k):
    arcs = TREE + PATH + STAR
    rows = dismantling.broken_trees(both_ways(spark, arcs), k).collect()
    got = [r["node"] for r in sorted(rows, key=lambda r: (-r["n"], r["node"]))]
    assert got == plain_breaking(near_of(arcs), k)


def mixed(seed=4):
    rng = random.Random(seed)
    arcs = {tuple(sorted(rng.sample(range(26), 2))) for _ in range(31)}
    return sorted(arcs | {(26, 27), (27, 28), (28, 29), (29, 0)})


def test_decycling_then_trees(spark):
    arcs = mixed()
    near, k = near_of(arcs), 12
    want = plain_decycled(near, k)
    assert len(want) < k  # so that trees are broken too
    want += plain_breaking(near, k - len(want), want)
    g = graph(spark, arcs, 30)
    got = [r["node"] for r in dismantling.decycling(g, k).orderBy("rank").collect()]
    assert got[: len(want)] == want and len(got) == k
    assert [r["node"] for r in dismantling.decycling(g, 2).orderBy("rank").collect()] == plain_decycled(near, 2)


def test_reinsertion(spark):
    arcs = mixed(9)
    near, g = near_of(arcs), graph(spark, arcs, 30)
    removed = plain_decycled(near, 6)
    for threshold in (0.4,):
        kept, size = set(removed), lambda s: max(map(len, parts_of(near, s)), default=0)
        bar = max(threshold * 30, size(kept))
        for v in sorted(removed, key=lambda u: len(near[u])):
            if size(kept - {v}) <= bar:
                kept -= {v}
        assert dismantling.reinserted(g, removed, threshold) == [v for v in removed if v in kept]
    rows = dismantling.decycling_reinserted(g, 3).collect()
    assert len({r["node"] for r in rows}) == 3


def barbell(n=7):
    one = [(a, b) for a in range(n) for b in range(a)]
    return one + [(100 + a, 100 + b) for a, b in one] + [(0, 50), (50, 100)]


def test_second_vector_is_the_eigenvector(spark):
    arcs = barbell()
    near = near_of(arcs)
    ids = sorted(near)
    a = np.array([[float(v in near[u]) for v in ids] for u in ids])
    d = 1 / np.sqrt(a.sum(1))
    want = np.linalg.eigh(d[:, None] * a * d)[1][:, -2]
    want = -want if want[0] > 0 else want
    from pyspark.sql import functions as F

    rows = dismantling.second_vectors(both_ways(spark, arcs).withColumn("arm", F.lit(0)), 40).orderBy("node").collect()
    x = np.array([r["x"] for r in rows])
    assert [r["node"] for r in rows] == ids and abs(x @ want) / np.linalg.norm(x) > 0.9999


def test_spectral_ensemble_cuts_the_barbell(spark):
    g = graph(spark, barbell(), 1)
    g = type(g)(both_ways(spark, barbell()).select("src").distinct().withColumnRenamed("src", "node"), g.edges)
    rows = dismantling.spectral_ensemble(g, 1, members=3, rounds=24).collect()
    assert rows[0]["node"] in (0, 50, 100)


def test_fiedler_removal_of_a_large_component_equals_the_dense_one(spark):
    from spreadframe.operators import kernels

    rng = random.Random(5)
    # two loose halves and a small component of its own
    arcs = sorted({(h * 120 + rng.randrange(120), h * 120 + rng.randrange(120)) for h in (0, 1) for _ in range(500)} | {(rng.randrange(120), 120 + rng.randrange(120)) for _ in range(40)} | {(900, 901), (901, 902)})
    edges = spark.createDataFrame([(a, b) for a, b in arcs if a != b], "src long, dst long")
    rows = lambda df: sorted((r["rank"], r["node"]) for r in df.collect())
    want = rows(kernels.fiedler_removal(edges, 12))
    assert len(want) == 12 and rows(kernels.fiedler_removal(edges, 12, dense=100)) == want


def test_second_vector_of_blocks_is_the_dense_one(spark):
    from spreadframe.operators import spectra

    rng = random.Random(7)
    arcs = {(i, (i + 1) % 300) for i in range(300)} | {(rng.randrange(300), rng.randrange(300)) for _ in range(1200)}
    near = sorted({p for a, b in arcs if a != b for p in ((a, b), (b, a))})
    a = np.zeros((300, 300))
    a[tuple(np.array(near).T)] = 1
    d = 1 / np.sqrt(a.sum(1))
    want = np.linalg.eigh(d[:, None] * a * d)[1][:, -2]
    got = np.array([r["x"] for r in spectra.second_vector(spark.createDataFrame(near, "src long, dst long")).orderBy("node").collect()])
    assert got[0] <= 0 and abs(np.abs(want @ got) - 1) < 1e-9 and min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6


def test_quantiles_that_removed_the_same_share_one_vector(spark, monkeypatch):
    g = graph(spark, barbell(), 1)
    g = type(g)(both_ways(spark, barbell()).select("src").distinct().withColumnRenamed("src", "node"), g.edges)
    arms, plain = [], dismantling.second_vectors
    monkeypatch.setattr(dismantling, "second_vectors", lambda e, *a: (arms.append(e.select("arm").distinct().count()), plain(e, *a))[1])
    found = dismantling.spectral_removals(g, 1, [0.5, 0.45], rounds=8)
    assert arms == [1] and all(len(c) == 1 for c in found)
