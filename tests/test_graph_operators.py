import math

import pytest
from pyspark.sql import functions as F

from spreadframe.core import Graph
from spreadframe.functions.coins import coin, coin_sql
from spreadframe.operators import build, dynamics, inference, kernels, selectors, structure
from spreadframe.operators.components import connected_components


def graph(spark, arcs, n, both=False, p=1.0):
    arcs = [*arcs, *((b, a) for a, b in arcs)] if both else arcs
    edges = spark.createDataFrame([(a, b, p) for a, b in arcs], "src long, dst long, ic_p double")
    return Graph(spark.range(n).withColumnRenamed("id", "node"), edges)


def ids(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node long")


def pairs(df, a="node", b="score"):
    return {r[a]: r[b] for r in df.collect()}


PATH5 = [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_coin_is_the_same_in_sql_and_spreads(spark):
    import duckdb

    got = [r[0] for r in spark.range(300).select(coin(F.col("id"), F.col("id") * 7, 3, "arc").alias("c")).collect()]
    assert got == [r[0] for r in duckdb.sql(f"SELECT {coin_sql('i', 'i * 7', '3', 'arc')} FROM range(300) t(i) ORDER BY i").fetchall()]
    big = spark.range(20000).select((coin(3, 5, F.col("id")) < 0.3).cast("int").alias("a"), (coin(4, 9, F.col("id")) < 0.3).cast("int").alias("b")).agg(F.avg("a"), F.avg(F.col("a") * F.col("b"))).first()
    assert abs(big[0] - 0.3) < 0.015 and abs(big[1] - 0.09) < 0.02


def test_components_label_with_the_smallest_node(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 60)] + [(5, 5), (100, 90), (90, 95), (None, 3), (95, 100)], "src long, dst long")
    got = pairs(connected_components(edges), "node", "component")
    assert got == {**{i: 10 for i in range(10, 61)}, 5: 5, 100: 90, 90: 90, 95: 90}
    assert connected_components(edges.limit(0)).count() == 0
    star = spark.range(1, 3000).select(F.lit(7000).cast("long").alias("src"), F.col("id").alias("dst"))
    assert connected_components(star).select("component").distinct().collect()[0][0] == 1


def test_connectivity_of_a_cut_path(spark):
    g = graph(spark, PATH5, 5, both=True)
    assert tuple(structure.connectivity(g).first()) == (10, 5, 1.0, 1)
    assert tuple(structure.connectivity(g, ids(spark, 2)).first()) == (2, 2, 0.4, 2)
    order = lambda *xs: spark.createDataFrame([(x, i + 1) for i, x in enumerate(xs)], "node long, rank int")
    assert [pairs(structure.dismantling_curve(g, order(2, 1)), "q", "share")[q] for q in range(3)] == [1.0, 0.4, 0.4]
    assert [pairs(structure.dismantling_curve(g, order(1, 2)), "q", "share")[q] for q in range(3)] == [1.0, 0.6, 0.4]


def test_core_triangles_and_betweenness(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3)], 5, both=True)
    assert pairs(structure.core_numbers(g), "node", "core") == {0: 2, 1: 2, 2: 2, 3: 1, 4: 0}
    assert pairs(structure.triangles(g), "node", "triangles") == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0}
    assert pairs(structure.betweenness(graph(spark, PATH5, 5, both=True), both_ways=True)) == {0: 0.0, 1: 3.0, 2: 4.0, 3: 3.0, 4: 0.0}
    assert pairs(structure.distances(g, ids(spark, 3)), "node", "hop") == {3: 0, 2: 1, 0: 2, 1: 2}
    assert abs(structure.spectral_radius(graph(spark, [(0, 1), (0, 2), (0, 3), (0, 4)], 5)) - 2) < 1e-3


def test_pagerank_sums_to_one_and_spreads_lost_mass(spark):
    got = pairs(structure.pagerank(graph(spark, [(0, 1), (1, 2)], 3), rounds=30))
    assert abs(sum(got.values()) - 1) < 1e-9 and got[0] < got[1] < got[2]


def test_dense_ids_follow_id_order(spark):
    edges, names = build.dense_ids(spark.createDataFrame([(50, 7), (7, 900)], "src long, dst long"))
    assert pairs(names, "raw", "node") == {7: 0, 50: 1, 900: 2}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == {(1, 0), (0, 2)}


@pytest.mark.parametrize("family", ["ba", "ws", "plc"])
def test_grown_graphs_are_simple_and_mirrored(spark, family):
    arcs = {(r["src"], r["dst"]) for r in build.grown_graph(spark, family, 60).collect()}
    assert arcs and all(a != b and (b, a) in arcs for a, b in arcs)


def test_cascade_on_a_path_with_removals(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3)], 4)
    seeds = ids(spark, 0)
    assert pairs(dynamics.ic_samples(g, seeds, 2, 9).where("sample = 0"), "node", "t") == {0: 0, 1: 1, 2: 2, 3: 3}
    assert dynamics.ic_samples(g, seeds, 1, 9, blocked=ids(spark, 2)).count() == 2
    assert dynamics.ic_samples(g.without(ids(spark, 1)), seeds, 1, 9).count() == 1
    assert {(r["op"], r["target"], r["destination"]) for r in dynamics.delete_node_actions(graph(spark, [(0, 1)], 2, both=True), ids(spark, 1)).collect()} == {("remove_node", 1, None), ("remove_edge", 0, 1), ("remove_edge", 1, 0)}
    assert dynamics.ic_samples(g, seeds.limit(0), 2, 5).count() == 0


def test_epidemic_with_certain_recovery_is_the_cascade(spark):
    g = graph(spark, PATH5 + [(0, 3)], 5, p=0.6)
    runs = 40
    sir = dynamics.epidemic_samples(g, ids(spark, 0), runs, 1, "sir", dynamics.EpidemicConfig(gamma=1.0))
    reached = sir.where("t = 1").groupBy("node").agg((F.count("*") / runs).alias("p"))
    exact = pairs(dynamics.ic_step_marginals(g, ids(spark, 0), ids(spark, 0)), "node", "p")
    assert all(abs(p - exact[n]) < 0.25 for n, p in pairs(reached, "node", "p").items())
    assert set(pairs(sir.where("t = 1 and node = 0"), "node", "state").values()) == {"R"}
    sis = dynamics.epidemic_samples(g, ids(spark, 0), 1, 3, "sis", dynamics.EpidemicConfig(gamma=1.0))
    assert "R" not in {r["state"] for r in sis.collect()}


def test_marginals_agree_with_sampling(spark):
    g = graph(spark, [(0, 2), (1, 2), (2, 3)], 4, p=0.4)
    seeds = ids(spark, 0, 1)
    exact = pairs(dynamics.ic_step_marginals(g, seeds, seeds), "node", "p")
    assert abs(exact[2] - 0.64) < 1e-12 and exact[3] == 0.0 and exact[0] == 1.0
    sampled = pairs(dynamics.marginals(dynamics.ic_samples(g, seeds, 2000, 1), 2000), "node", "p")
    assert abs(sampled[2] - 0.64) < 0.04
    field = pairs(dynamics.mean_field(g, seeds, 2).where("t = 2"), "node", "infected")
    assert abs(field[3] - 0.4 * 0.64) < 1e-12


def test_tie_breaks_of_two_cascades(spark):
    g = graph(spark, [(0, 2), (1, 2)], 3)
    side = lambda **kw: pairs(dynamics.competitive_samples(g, ids(spark, 0), ids(spark, 1), 1, 2, **kw), "node", "side")[2]
    assert side(model="ic") == "positive" and side(model="lt", tie_break="negative") in ("negative", "positive")
    assert side(model="ic", tie_break="negative") == "negative"
    m = dynamics.competitive_ic_marginals(graph(spark, [(0, 2), (1, 2)], 3, p=0.5), ids(spark, 0), ids(spark, 1), ids(spark, 0, 1)).first()
    assert (m["p_negative"], m["p_positive"]) == (0.25, 0.5)


def test_edges_as_of_follow_the_last_edit(spark):
    e = graph(spark, [(0, 1), (1, 2)], 3).edges
    log = spark.createDataFrame([(1, 0, "delete", 0, 1, None), (2, 0, "insert", 0, 1, 0.5), (2, 1, "insert", 2, 0, 0.3)], "t int, seq int, op string, src long, dst long, ic_p double")
    at = lambda t: {(r["src"], r["dst"], r["ic_p"]) for r in dynamics.edges_as_of(e, log, t).collect()}
    assert at(0) == {(0, 1, 1.0), (1, 2, 1.0)} and at(1) == {(1, 2, 1.0)} and at(2) == {(0, 1, 0.5), (1, 2, 1.0), (2, 0, 0.3)}


def test_dominators_of_path_and_diamond(spark):
    live = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 2, 3)], "sample int, src long, dst long")
    got = {(r["sample"], r["node"]): r["size"] for r in kernels.dominated(live, ids(spark, 0)).collect()}
    assert got[(0, 1)] == 3 and got[(0, 3)] == 1 and [got[(1, n)] for n in (1, 2, 3)] == [1, 1, 1]


def test_dismantlers_return_distinct_nodes(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)], 6, both=True)
    cut = [r["node"] for r in kernels.articulation_removal(g.edges, 1).collect()]
    assert cut[0] in (2, 3)
    for df in (kernels.explosive_immunization(g.edges, 2), kernels.belief_decycling(g.edges, 2), selectors.kshell(g, 3)):
        got = [r["node"] for r in df.collect()]
        assert got and len(got) == len(set(got))
    assert selectors.adaptive(g, 2, structure.neighbour_degree)[0] in (2, 3)


def test_max_coverage_and_rounds(spark):
    sets = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (1, 6), (4, 7)], "rr_id long, node long")
    assert selectors.max_coverage(sets, 3) == [5, 6, 7]
    assert selectors.round_batches(10, 3) == [4, 3, 3] and selectors.round_batches(5, per_round=2) == [2, 2, 1]


def test_localisation_on_a_star(spark):
    g = graph(spark, [(0, i) for i in range(1, 6)], 6, both=True)
    y = g.nodes.withColumn("y", F.lit(1.0))
    assert [r["node"] for r in inference.label_propagation_sources(g, y, 1).collect()] == [0]
    assert [r["node"] for r in inference.jordan_centers(g, y, 1).collect()] == [0]
    rc = pairs(inference.rumor_centrality(g, y))
    assert max(rc, key=rc.get) == 0 and abs(rc[0] - math.log(math.factorial(5))) < 1e-9


def test_reconstruction_names_parents(spark):
    g = graph(spark, [(0, 1), (1, 2), (0, 2)], 3, p=0.5)
    times = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "node long, time int")
    assert pairs(inference.with_parents(g, times), "node", "parent") == {0: None, 1: 0, 2: 1}
    log = inference.history_likelihood(g, times, 3).first()[0]
    assert abs(log - (math.log(0.5) + math.log(0.5) + math.log(0.5))) < 1e-9
    filled = pairs(inference.backfilled(g, spark.createDataFrame([(2, 1)], "node long, time int"), 3), "node", "time")
    assert filled[2] == 1 and 0 in filled.values()


def test_batches_of_many_plans(spark):
    df = spark.createDataFrame([("a", 10), ("b", 2), ("c", 0), ("d", None), ("e", 3)], "plan string, budget long")
    got = {}
    for r in selectors.batch_plans(df, 3).orderBy("round").collect():
        got.setdefault(r["plan"], []).append(r["seeds"])
    assert got == {p: selectors.round_batches(n, 3) for p, n in (("a", 10), ("b", 2), ("e", 3))}


def test_limits_are_not_silent(spark):
    line = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "src long, dst long, cost double")
    with pytest.raises(RuntimeError):
        structure.shortest_costs(line, ids(spark, 0), max_rounds=4)
    assert pairs(structure.shortest_costs(line, ids(spark, 0)), b="cost")[6] == 6.0
    assert selectors.sample_size(10**6, 50, 0.5) > 20_000 and selectors.sample_size(10**6, 50, 0.5, most=20_000) == 20_000
