"""Reverse sets are the same whether ended ones are laid aside early or never, and are rewritten less."""

import numpy as np

from spreadframe.core import Graph
from spreadframe.operators import selectors


def test_ended_sets_are_laid_aside(spark, monkeypatch):
    r = np.random.default_rng(10)
    arcs = sorted({(int(a), int(b)) for a, b in r.integers(0, 40, (90, 2)) if a != b})
    g = Graph.from_edges(spark.createDataFrame([(a, b, 0.5) for a, b in arcs], "src long, dst long, ic_p double"))
    names = []
    plain = selectors.written
    monkeypatch.setattr(selectors, "written", lambda df, name="table": names.append(name) or plain(df, name))
    sets = lambda: sorted(map(tuple, selectors.reverse_sets(g, 60).collect()))
    monkeypatch.setattr(selectors, "ASIDE", 1000)
    want = sets()
    monkeypatch.setattr(selectors, "ASIDE", 1)
    assert sets() == want and len(set(want)) == len(want)
    assert "ended" in names and "seen" not in names
