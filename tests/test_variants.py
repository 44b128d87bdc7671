from pyspark.sql import functions as F

from spreadframe.core import Graph
from spreadframe.operators import dynamics, variants

from .test_graph_operators import graph, ids, pairs


def test_credit_of_a_seed_that_adds_nothing(spark):
    g = graph(spark, [(0, 1), (1, 2)], 4)
    got = {r["node"]: (r["credit"], r["solo"]) for r in variants.leave_one_out(g, [0, 1, 3], 3, 5).collect()}
    assert got == {0: (1.0, 3.0), 1: (0.0, 2.0), 3: (1.0, 1.0)}


def test_consistent_times_wait_for_reported_steps(spark):
    g = graph(spark, [(0, 1), (1, 2)], 3)
    said = spark.createDataFrame([(1, 2)], "node long, time int")
    assert pairs(variants.consistent_times(g, ids(spark, 0), said, 5), "node", "time") == {0: 0, 1: 2, 2: 3}
    assert pairs(variants.consistent_times(g, ids(spark, 0), said, 5, exactly=False), "node", "time") == {0: 0, 1: 1, 2: 2}


def test_gradient_of_a_chain(spark):
    g = graph(spark, [(0, 1), (1, 2)], 3, p=0.5)
    got = pairs(variants.spread_gradient(g, ids(spark, 2), g.nodes, 2), "node", "gradient")
    assert abs(got[0] - 1.5) < 1e-3 and abs(got[1] - 1.0) < 1e-3


def test_lost_nodes_come_from_losing_samples(spark):
    rows = lambda *xs: spark.createDataFrame(xs, "sample int, node long")
    got = variants.lost_nodes(rows((0, 1), (1, 1), (1, 2)), rows((0, 1), (0, 5), (1, 9)), 3)
    assert pairs(got) == {5: 1.0}


def test_dominating_blockers_cut_the_chain(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3), (0, 4)], 5)
    assert variants.dominating_blockers(g, 1, ids(spark, 0), 2) == [1]
    assert variants.dominator_doses(g, 2, ids(spark, 0)) == [1, 4]
    left = g.without(ids(spark, 1))
    assert dynamics.ic_samples(left, ids(spark, 0), 1, 5).count() == 2


def test_regions_cover_all_nodes(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)], 6, both=True)
    assert variants.structural_regions(g).count() == 6 and isinstance(g, Graph)
    assert variants.bridge_nodes(g).where(F.col("outside") == 0).count() == 0
