"""Cascades as bits of a node against plain sets."""

import numpy as np

from spreadframe.core import Graph
from spreadframe.operators import cascades


def test_reachable_size_over_many_cascades(spark):
    r = np.random.default_rng(6)
    arcs = sorted({(int(a), int(b)) for a, b in r.integers(0, 50, (90, 2)) if a != b})
    seen = sorted({(f"c{c}", int(v)) for c in range(130) for v in r.integers(0, 55, 2)})
    g = Graph.from_edges(spark.createDataFrame([(a, b, 1.0) for a, b in arcs], "src long, dst long, ic_p double"))
    got = {r.cascade_id: r.predicted for r in cascades.reachable_size(g, spark.createDataFrame([(c, v, 0) for c, v in seen], "cascade_id string, node long, t int"), 12, 2).collect()}
    want = {}
    for c, v in seen:
        want.setdefault(c, set()).add(v)
    for c in want:
        for _ in range(2):
            want[c] |= {b for a, b in arcs if a in want[c]}
    assert got == {c: float(len(s)) for c, s in want.items()}
