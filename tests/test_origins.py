"""Sources by greedy cover of reports, counted in tiles, against plain sets; no row a pair is laid out."""

import math

import numpy as np

from spreadframe.core import Graph
from spreadframe.operators import inference, tiles


def test_greedy_origins_without_rows_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(tiles, "hop_rows", None)
    r = np.random.default_rng(8)
    arcs = sorted({(int(a), int(b)) for a, b in r.integers(0, 40, (60, 2)) if a != b})
    g = Graph.from_edges(spark.createDataFrame([(a, b, 1.0) for a, b in arcs], "src long, dst long, ic_p double"))
    nodes = sorted({v for a in arcs for v in a})
    reports = nodes[::3]
    reach = {v: {v} for v in nodes}
    for _ in range(3):
        reach = {v: s | {b for a, b in arcs if a in s} for v, s in reach.items()}
    left, want = set(reports), []
    for _ in range(3):
        want.append(min((v for v in nodes if reach[v] & left), key=lambda v: (-len(reach[v] & left) / (1 + math.log1p(len(reach[v]))), v)))
        left -= reach[want[-1]]
    chosen, times = inference.greedy_origin_times(g, spark.createDataFrame([(v, None) for v in reports], "node long, time int"), 3, 3)
    assert chosen == want
    assert {x.node for x in times.collect()} == set().union(*(reach[v] for v in want))
