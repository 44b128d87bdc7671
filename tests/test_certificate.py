"""Graphs of more arcs than a sequential routine takes: the arcs that decide what is left after some removals."""

from itertools import combinations

import numpy as np

from spreadframe.operators import kernels, sweeps
from spreadframe.operators.kernels import _neighbours, _pieces


def arcs_of(seed, n, m):
    r = np.random.default_rng(seed)
    return sorted({p for a, b in r.integers(0, n, (m, 2)).tolist() if a != b for p in ((a, b), (b, a))})


def test_removals_leave_the_same_pieces():
    import pandas as pd

    for seed in range(12):
        n = 14
        near = _neighbours(pd.DataFrame(arcs := arcs_of(seed, n, 20 + 4 * seed), columns=["src", "dst"]))
        net = sweeps.Net.__new__(sweeps.Net)
        net.n, net.into = n, sweeps.Arcs([], n, False)
        net.into.counts = np.bincount([b for _, b in arcs], minlength=n)
        net.into.begin, net.into.held = np.concatenate([[0], np.cumsum(net.into.counts)]), np.flatnonzero(net.into.counts)
        net.into.far = np.array([a for a, _ in sorted(arcs, key=lambda p: (p[1], p[0]))], np.int32)
        few = _neighbours(pd.DataFrame(sweeps.search_forests(net, 3), columns=["src", "dst"]))
        assert set(few) == set(near) and sum(map(len, few.values())) <= 6 * (n - 1)
        same = lambda x, gone: {frozenset(p) for p in _pieces(x, gone)}
        assert all(same(few, set(gone)) == same(near, set(gone)) for k in range(3) for gone in combinations(near, k))


def test_larger_graphs_are_not_refused(spark, monkeypatch):
    e = spark.createDataFrame(arcs_of(3, 60, 70), "src long, dst long")
    want = [tuple(r) for r in kernels.articulation_removal(e, 3).collect()]
    few = sweeps.certificate(e, 3)
    assert sorted(map(tuple, kernels.articulation_removal(few, 3).collect())) == sorted(want)
    kept = []
    make = sweeps.certificate
    monkeypatch.setattr(kernels, "MOST", 20)
    monkeypatch.setattr(kernels, "certificate", lambda *a: kept.append(1) or make(*a))
    kernels.articulation_removal(e, 3)
    assert kept
