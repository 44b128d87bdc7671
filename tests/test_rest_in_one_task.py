"""What is left of a peeled graph is finished in one task with the same result as round by round."""

import numpy as np
import pytest

from spreadframe.core import Graph
from spreadframe.operators import dismantling, structure


def both_ways(spark, arcs):
    return spark.createDataFrame(sorted({(a, b) for a, b in arcs} | {(b, a) for a, b in arcs}), "src long, dst long")


@pytest.fixture
def rounds(monkeypatch):
    def run(f):
        with monkeypatch.context() as m:
            m.setattr(structure, "SMALL", 0)
            return f()

    return run


def test_two_core_and_hubs(spark, rounds):
    r = np.random.default_rng(3)
    arcs = {(int(a), int(b)) for a, b in r.integers(0, 60, (70, 2)) if a != b} | {(100 + i, 101 + i) for i in range(12)}
    e = both_ways(spark, arcs)
    core = lambda: sorted(map(tuple, structure.peeled(e).collect()))
    assert core() == rounds(core) != []
    nodes = {r.node for r in structure.core_numbers(Graph.from_edges(e)).where("core >= 2").collect()}
    assert {r.node for r in structure.two_core(Graph.from_edges(e)).collect()} == nodes
    assert dismantling.decycled(e, 5) == rounds(lambda: dismantling.decycled(e, 5))


def test_tree_sizes(spark, rounds):
    r = np.random.default_rng(4)
    arcs = [(i, int(r.integers(max(0, i - 4), i))) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(9)] + [(200, 201)]
    sizes = lambda: sorted(map(str, dismantling.tree_sizes(both_ways(spark, arcs)).collect()))
    assert sizes() == rounds(sizes)


def test_a_long_tail_takes_few_jobs(spark):
    e = both_ways(spark, [(i, i + 1) for i in range(60)])
    sc = spark.sparkContext
    sc.setJobGroup("tail", "tail")
    assert structure.peeled(e).isEmpty()
    assert dismantling.tree_sizes(e).count() == 61
    jobs = sc.statusTracker().getJobIdsForGroup("tail")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 30
