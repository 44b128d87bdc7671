"""Spectral radii of several removals at once against one by one."""

import numpy as np
import pytest

from spreadframe.core import Graph
from spreadframe.operators import structure


def test_radii_of_several_removals_at_once(spark):
    r = np.random.default_rng(7)
    arcs = sorted({(int(a), int(b)) for a, b in r.integers(0, 20, (60, 2)) if a != b})
    g = Graph.from_edges(spark.createDataFrame([(a, b, 1.0) for a, b in arcs], "src long, dst long, ic_p double")).materialized()
    gone = lambda v: spark.createDataFrame([(v,)], "node long")
    want = [structure.spectral_radius(g, rounds=8), *(structure.spectral_radius(g, gone(v), rounds=8) for v in (3, 5))]
    assert structure.spectral_radii(g, [None, 3, 5], rounds=8) == pytest.approx(want, rel=1e-12)
