"""Searches in tiles against plain ones, with many small buckets and several blocks."""

from collections import deque

import numpy as np
import pytest

from spreadframe.core import Graph
from spreadframe.operators import structure, tiles


@pytest.fixture(scope="module")
def arcs():
    r = np.random.default_rng(5)
    made = {(int(a) * 3 - 60, int(b) * 3 - 60) for a, b in r.integers(0, 90, (230, 2)) if a != b}
    # a tail makes paths of many hops
    return sorted(made | {(300 + 3 * i, 303 + 3 * i) for i in range(9)})


def hops(arcs, s):
    near, seen, queue = {}, {s: 0}, deque([s])
    for a, b in arcs:
        near.setdefault(a, []).append(b)
    while queue:
        u = queue.popleft()
        for v in near.get(u, []):
            if v not in seen:
                seen[v] = seen[u] + 1
                queue.append(v)
    return seen


def test_reached_sets_equal_plain_searches(spark, arcs):
    e = spark.createDataFrame(arcs, "src long, dst long")
    nodes = sorted({v for a in arcs for v in a})
    sources = spark.createDataFrame([(v,) for v in nodes], "node long")
    t, levels = tiles.reached(e, sources, side=16, width=64)
    assert t.buckets > 4 and t.blocks > 1
    got = {(r.key, r.node): r.hop for r in tiles.hop_rows(t, levels).collect()}
    want = {(s, v): h for s in nodes for v, h in hops(arcs, s).items()}
    assert got == want
    members = {v for v in nodes if v % 2 == 0}
    counts = {(r.key, r.hop): r.n for r in tiles.hop_counts(t, levels, spark.createDataFrame([(v,) for v in members], "node long")).collect()}
    plain = {}
    for (s, v), h in want.items():
        if v in members:
            plain[s, h] = plain.get((s, h), 0) + 1
    assert counts == plain
    # one row a tile and level, not one a pair
    assert sum(level.count() for level in levels) < len(want) / 5


def test_a_hop_limit_holds(spark, arcs):
    g = Graph.from_edges(spark.createDataFrame(arcs, "src long, dst long"))
    got = {(r.key, r.node): r.hop for r in structure.distances(g, g.nodes, 3, keyed=True).collect()}
    nodes = {v for a in arcs for v in a}
    assert got == {(s, v): h for s in nodes for v, h in hops(arcs, s).items() if h <= 3}


def test_dependencies_equal_counted_paths(spark, arcs):
    nodes = sorted({v for a in arcs for v in a})
    d = {s: hops(arcs, s) for s in nodes}
    paths = {}
    for s in nodes:
        n = {s: 1}
        for v in sorted(d[s], key=d[s].get):
            for a, b in arcs:
                if a == v and d[s][b] == d[s][v] + 1:
                    n[b] = n.get(b, 0) + n[v]
        paths[s] = n
    want = {v: sum(paths[s][v] * paths[v][t] / paths[s][t] for s in nodes if s != v and v in d[s] for t in d[v] if t != v and d[s].get(t) == d[s][v] + d[v][t]) for v in nodes}
    e = spark.createDataFrame(arcs, "src long, dst long")
    got = {r.node: r.score for r in tiles.dependencies(e, spark.createDataFrame([(v,) for v in nodes], "node long"), side=16, width=64).collect()}
    assert {v: got.get(v, 0) for v in nodes} == pytest.approx(want)


def test_costs_products_and_fields_equal_plain_rounds(spark, arcs):
    r = np.random.default_rng(8)
    weighted = [(a, b, float(w)) for (a, b), w in zip(arcs, r.choice([0.1, 0.3, 0.7, 1.0], len(arcs)))]
    nodes = sorted({v for a in arcs for v in a})
    e, of = spark.createDataFrame(weighted, "src long, dst long, w double"), spark.createDataFrame([(v,) for v in nodes], "node long")
    value = of.selectExpr("node", "cast(1 as double) as v")
    total = lambda t, tiles_: {x.key: x.s for x in tiles.column_sums(t, tiles_, value, lambda x, v: (np.where(np.isinf(x), 0, x).sum(0),), "s").groupBy("key").agg({"s": "sum"}).withColumnRenamed("sum(s)", "s").collect()}
    cost, best, field = {}, {}, {}
    for s in nodes:
        d, old = {s: 0.0}, None
        while d != old:
            old, d = d, dict(d)
            for a, b, w in weighted:
                if a in old:
                    d[b] = min(d.get(b, np.inf), old[a] + w)
        cost[s] = sum(d.values())
        top, front = {}, {s: 1.0}
        for _ in range(3):
            new = {}
            for a, b, w in weighted:
                if a in front and b != s:
                    new[b] = max(new.get(b, 0), front[a] * w)
            top, front = {v: max(top.get(v, 0), new.get(v, 0)) for v in {*top, *new}}, new
        best[s] = sum(top.values())
        p, front = {s: 0.5, nodes[0]: 1.0}, {s: 0.5, nodes[0]: 1.0}
        for _ in range(3):
            miss = {}
            for a, b, w in weighted:
                if a in front:
                    miss[b] = miss.get(b, 1) * (1 - front[a] * w)
            front = {v: (1 - p.get(v, 0)) * (1 - m) for v, m in miss.items()}
            p = {v: p.get(v, 0) + front.get(v, 0) for v in {*p, *front}}
        field[s] = sum(p.values())
    sizes = {"side": 16, "width": 64}
    assert total(*tiles.least_costs(e, of, 64, **sizes)) == pytest.approx(cost)
    assert total(*tiles.best_products(e, of, 3, **sizes)) == pytest.approx(best)
    assert total(*tiles.mean_fields(e, of, 3, 0.5, of.orderBy("node").limit(1), **sizes)) == pytest.approx(field)


def test_costs_that_do_not_settle_are_an_error(spark, arcs):
    e = spark.createDataFrame([(*a, 1.0) for a in arcs], "src long, dst long, w double")
    with pytest.raises(RuntimeError):
        tiles.least_costs(e, spark.createDataFrame([(300,)], "node long"), 3, side=16)


def test_levels_keep_no_seen_sets(spark, arcs):
    nodes = spark.createDataFrame([(v,) for v in sorted({v for a in arcs for v in a})], "node long")
    levels = tiles.reached(spark.createDataFrame(arcs, "src long, dst long"), nodes, side=16, width=64)[1]
    assert len(levels) > 5 and all(level.columns == ["block", "bucket", "front"] for level in levels)
    # what a hop does not reach has no row
    assert levels[-1].where("front is null").isEmpty()


def test_tree_logs_over_several_tiles_equal_trees_root_by_root(spark):
    import math
    import random

    rng = random.Random(3)
    near = {p for _ in range(150) for a, b in [(rng.randrange(0, 90, 1), rng.randrange(0, 90, 1))] if a != b for p in ((a, b), (b, a))} | {(200, 201), (201, 200)}
    out: dict[int, list[int]] = {}
    for a, b in sorted(near):
        out.setdefault(a, []).append(b)
    want = {}
    for root in [*out, 300]:
        hop, order = {root: 0}, [root]
        for u in order:
            for v in out.get(u, []):
                if v not in hop:
                    hop[v] = hop[u] + 1
                    order.append(v)
        size = dict.fromkeys(hop, 1)
        for v in reversed(order[1:]):
            size[min(u for u in out[v] if hop.get(u) == hop[v] - 1)] += size[v]
        want[root] = (len(hop), sum(map(math.log, size.values())))
    edges, sources = spark.createDataFrame(sorted(near), "src long, dst long"), spark.createDataFrame([(v,) for v in want], "node long")
    got = {r["key"]: (r["n"], r["logs"]) for r in tiles.tree_logs(edges, sources, side=16, width=64).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in want.items()}
    assert all(abs(got[k][1] - x) < 1e-9 for k, (_, x) in want.items())
