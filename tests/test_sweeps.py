"""Searches in which a task holds all arcs, against those in tiles and against plain ones."""

import numpy as np
import pytest

from spreadframe.core import Graph
from spreadframe.operators import structure, sweeps, tiles


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(5)
    pairs = {(int(a) * 3 - 60, int(b) * 3 - 60) for a, b in r.integers(0, 90, (230, 2)) if a != b}
    arcs = sorted(pairs | {(300 + 3 * i, 303 + 3 * i) for i in range(9)})
    e = spark.createDataFrame([(a, b, float(w)) for (a, b), w in zip(arcs, r.choice([0.1, 0.3, 0.7, 1.0], len(arcs)))], "src long, dst long, w double").coalesce(1)
    nodes = spark.createDataFrame([(v,) for v in sorted({v for a in arcs for v in a})], "node long")
    return e.cache(), nodes.unionByName(spark.createDataFrame([(999,)], "node long"))


SMALL = {"side": 16, "tasks": 2}


def rows(df):
    return {tuple(x[:2]): x[2] for x in df.collect()}


@pytest.mark.parametrize("most", [1 << 28, 0])
def test_hops_equal_those_in_tiles(spark, made, monkeypatch, most):
    monkeypatch.setattr(sweeps, "MOST", most)
    e, nodes = made
    t, levels = tiles.reached(e, nodes, side=16, width=64)
    even = nodes.where("node % 2 = 0")
    assert rows(sweeps.hop_rows(e, nodes, side=16, tasks=1)) == rows(tiles.hop_rows(t, levels))
    assert rows(sweeps.hop_counts(e, nodes, 3, even, **SMALL)) == {k: n for k, n in rows(tiles.hop_counts(t, levels, even)).items() if k[1] <= 3}


def test_no_level_and_no_pair_is_written(spark, made, monkeypatch):
    kept = []
    monkeypatch.setattr(sweeps, "written", lambda df, name="table": kept.append(name) or df)
    e, nodes = made
    sweeps.dependencies(e, nodes).collect()
    sweeps.hop_counts(e, nodes).collect()
    assert set(kept) <= {"places", "sources", "arcs", "packed", "shares"}


def test_dependencies_and_trees_equal_those_in_tiles(spark, made):
    e, nodes = made
    want = {k: v for k, v in tiles.dependencies(e, nodes, side=16, width=64).collect() if v}
    assert dict(map(tuple, sweeps.dependencies(e, nodes, **SMALL).collect())) == pytest.approx(want)
    plain = {r["key"]: (r["n"], r["logs"]) for r in tiles.tree_logs(e, nodes, side=16, width=64).collect()}
    got = {r["key"]: (r["n"], r["logs"]) for r in sweeps.tree_logs(e, nodes, **SMALL).collect()}
    assert {k: n for k, (n, _) in got.items()} == {k: n for k, (n, _) in plain.items()}
    assert all(abs(got[k][1] - x) < 1e-9 for k, (_, x) in plain.items())


def test_costs_products_and_fields_equal_those_in_tiles(spark, made):
    e, nodes = made
    value, seed = nodes.selectExpr("node", "cast(1 as double) as v"), nodes.orderBy("node").limit(1)
    s = lambda x, v: (np.where(np.isinf(x), 0, x).sum(0),)
    summed = lambda df: {x.key: x.s for x in df.groupBy("key").agg({"s": "sum"}).withColumnRenamed("sum(s)", "s").collect()}
    sizes = {"side": 16, "width": 64}
    for one, many in (
        (sweeps.least_costs(e, nodes, 64, value, s, "s", **SMALL), tiles.least_costs(e, nodes, 64, **sizes)),
        (sweeps.best_products(e, nodes, 3, value, s, "s", **SMALL), tiles.best_products(e, nodes, 3, **sizes)),
        (sweeps.mean_fields(e, nodes, 3, value, s, "s", 0.5, seed, **SMALL), tiles.mean_fields(e, nodes, 3, 0.5, seed, **sizes)),
    ):
        assert summed(one) == pytest.approx(summed(tiles.column_sums(*many, value, s, "s")))


def test_radii_fall_for_every_node(spark):
    r = np.random.default_rng(7)
    arcs = sorted({p for a, b in r.integers(0, 20, (40, 2)) if a != b for p in ((int(a), int(b)), (int(b), int(a)))})
    g = Graph.from_edges(spark.createDataFrame([(a, b, 1.0) for a, b in arcs], "src long, dst long, ic_p double")).materialized()
    gone = sorted({a for a, _ in arcs})
    radii = structure.spectral_radii(g, [None, *gone], rounds=8)
    got = {x.node: x.score for x in sweeps.radius_falls(g.edges.select("src", "dst"), g.nodes, rounds=8, **SMALL).collect()}
    assert got == pytest.approx({v: radii[0] - x for v, x in zip(gone, radii[1:])}, abs=1e-12)


def test_pieces_hold_every_arc_once(monkeypatch):
    import zlib

    monkeypatch.setattr(sweeps, "PIECE", 7)
    r = np.random.default_rng(2)
    counts = r.integers(0, 12, 40) * (r.random(40) < 0.7)
    far = r.integers(0, 40, counts.sum()).astype(np.uint32)
    body = np.ascontiguousarray(np.diff(far, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T).tobytes()
    a = sweeps.Arcs([(0, zlib.compress(body), zlib.compress(counts.astype(np.int32).tobytes()), None)], 45, False, 64)
    assert a.far.tolist() == far.tolist()
    for some in (None, np.arange(3, 45, 2), np.zeros(0, int)):
        got = [(int(h), a.far[at][b:e].tolist()) for p, begin, at in a.pieces(some) for h, b, e in zip(p, begin, [*begin[1:], None])]
        want = [(h, far[counts[:h].sum() : counts[: h + 1].sum()].tolist()) for h in (range(40) if some is None else some.tolist()) if h < 40 and counts[h]]
        assert got == want
