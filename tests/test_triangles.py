"""Triangles among groups of nodes against plain counts, with several groups."""

import numpy as np

from spreadframe.core import Graph
from spreadframe.operators import structure


def test_triangles_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(structure, "PART", 30)
    r = np.random.default_rng(9)
    arcs = sorted({(int(a), int(b)) for a, b in r.integers(0, 30, (150, 2)) if a != b})
    near = {}
    for a, b in arcs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {v: sum(len(near[v] & near[u]) for u in near[v]) // 2 for v in near}
    g = Graph.from_edges(spark.createDataFrame([(a, b, 1.0) for a, b in arcs], "src long, dst long, ic_p double"))
    assert {x.node: x.triangles for x in structure.triangles(g).collect()} == want
    assert max(want.values()) > 3
