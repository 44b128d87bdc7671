"""Where a spread began and how it ran: source localisation and history reconstruction.

Observations are long tables: ``node, y`` (infected from 0.5 on) for localisation, and
``node, time`` (null: infected at an unknown time) for reconstruction.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import Graph, iterate, product_of, top_k, undirected
from ..functions.coins import coin
from ..shared import written
from . import dynamics, structure, sweeps
from .components import connected_components

INFECTED = 0.5


def infected_set(observation: DataFrame) -> DataFrame:
    return observation.where(F.col("y") >= INFECTED).select("node")


def infected_graph(graph: Graph, observation: DataFrame) -> Graph:
    """The undirected graph among infected nodes."""
    i = infected_set(observation)
    e = undirected(graph.edges).join(i.withColumnRenamed("node", "src"), "src", "left_semi").join(i.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return Graph(i, e.withColumn("ic_p", F.lit(1.0)))


def normalized_adjacency(graph: Graph) -> DataFrame:
    """``src, dst, w`` of the undirected view scaled by both ends' root degrees."""
    e = undirected(graph.edges)
    d = e.groupBy("src").agg(F.sqrt(F.count("*")).alias("d"))
    return e.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst").select("src", "dst", (1.0 / (F.col("d") * F.col("e"))).alias("w"))


def label_propagation_scores(graph: Graph, observation: DataFrame, alpha: float = 0.5, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """F <- alpha S F + (1 - alpha) Y with Y +1 for infected nodes and -1 for others."""
    s = written(normalized_adjacency(graph), "arcs")
    y = graph.nodes.join(observation, "node", "left").select("node", F.when(F.coalesce("y", F.lit(0.0)) >= INFECTED, 1.0).otherwise(-1.0).alias("y"))

    def step(now: DataFrame, _: int) -> DataFrame:
        got = s.join(now, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("w") * F.col("score")).alias("g"))
        return now.join(got, F.col("node") == F.col("dst"), "left").select("node", "y", (F.lit(alpha) * F.coalesce("g", F.lit(0.0)) + F.lit(1 - alpha) * F.col("y")).alias("score"))

    def settled(old: DataFrame, new: DataFrame) -> bool:
        d = old.select("node", F.col("score").alias("was")).join(new, "node").agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0]
        return d is None or d < tolerance

    return iterate(y.withColumn("score", F.col("y")), step, rounds, settled, "labels").select("node", "score")


def label_propagation_sources(graph: Graph, observation: DataFrame, k: int, **kw) -> DataFrame:
    """Infected local maxima of the propagated labels, then the best others."""
    f = written(label_propagation_scores(graph, observation, **kw), "scores")
    best = undirected(graph.edges).join(f, F.col("dst") == F.col("node")).groupBy("src").agg(F.max("score").alias("near"))
    inf = infected_set(observation)
    peak = f.join(inf, "node", "left_semi").join(best, F.col("node") == F.col("src"), "left").withColumn("peak", F.coalesce(F.col("score") >= F.col("near"), F.lit(True)))
    r = peak.orderBy(F.desc("peak"), F.desc("score"), "node").limit(k)
    return r.select("node", F.row_number().over(Window.orderBy(F.desc("peak"), F.desc("score"), "node")).alias("rank"))


def infected_scores(graph: Graph, observation: DataFrame, kind: str) -> DataFrame:
    """``node, score`` inside the infected graph: degree, closeness, betweenness or eigenvector."""
    g = infected_graph(graph, observation)
    return {"degree": structure.neighbour_degree, "closeness": lambda x: structure.closeness(x, both_ways=True), "betweenness": lambda x: structure.betweenness(x, both_ways=True), "eigenvector": lambda x: structure.eigenvector(x, 60, both_ways=True)}[kind](g)


def jordan_scores(graph: Graph, observation: DataFrame, whole_graph: bool = False) -> DataFrame:
    """``node, score``: minus the eccentricity, inside the infected graph or to the infected set in the whole graph."""
    i = infected_set(observation)
    ecc = structure.eccentricity(graph, i, i) if whole_graph else structure.eccentricity(infected_graph(graph, observation))
    return ecc.select("node", (-F.col("score")).alias("score"))


def jordan_centers(graph: Graph, observation: DataFrame, k: int) -> DataFrame:
    """Largest infected components first, the node of least eccentricity from each."""
    g = infected_graph(graph, observation)
    s = jordan_scores(graph, observation)
    parts = g.nodes.join(connected_components(g.edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    j = s.join(parts, "node").withColumn("size", F.count("*").over(Window.partitionBy("component")))
    j = j.withColumn("turn", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("score"), "node")))
    order = ["turn", F.desc("size"), "component"]
    return j.orderBy(*order).limit(k).select("node", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def rumor_centrality(graph: Graph, observation: DataFrame) -> DataFrame:
    """``node, score``: log n! minus the logs of subtree sizes in the breadth-first tree rooted at the node.

    Smallest parent a hop nearer, sizes from the leaves up, and no row a pair.
    """
    g = infected_graph(graph, observation)
    logs = sweeps.tree_logs(written(g.edges.select("src", "dst"), "arcs"), g.nodes)

    def scores(n: pd.Series, logs: pd.Series) -> pd.Series:
        return pd.Series([math.lgamma(m + 1) for m in n], dtype=float) - logs

    return logs.select(F.col("key").alias("node"), F.pandas_udf(scores, "double")("n", "logs").alias("score"))


def effective_distance_scores(graph: Graph, observation: DataFrame, max_rounds: int = 32) -> DataFrame:
    """``node, score``: minus the spread (population deviation) of shortest effective distances to the infected set.

    An arc is 1 - log(its share of the tail's flux) long and walked both ways; unreachable
    infected nodes put a candidate last.
    """
    flux = graph.edges.groupBy("src").agg(F.sum("ic_p").alias("f"))
    one = graph.edges.join(flux, "src").select("src", "dst", (1 - F.log(F.col("ic_p") / F.col("f"))).alias("cost"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")).groupBy("src", "dst").agg(F.min("cost").alias("cost"))
    i = written(infected_set(observation), "infected")
    n = i.count()
    def parts(x, _):
        on = np.isfinite(x)
        k = on.sum(0)
        mean = np.where(on, x, 0).sum(0) / np.maximum(1, k)
        return k.astype(float), mean, np.where(on, np.square(np.where(on, x, 0) - mean), 0).sum(0)

    # means and squared deviations by bucket of nodes where they are in buckets, then between buckets
    d = written(sweeps.least_costs(written(both.withColumnRenamed("cost", "w"), "arcs"), i, max_rounds, i.withColumn("v", F.lit(1.0)), parts, "k mean dev"), "parts")
    over = d.groupBy("key").agg(F.sum("k").cast("long").alias("n"), (F.sum(F.col("k") * F.col("mean")) / F.sum("k")).alias("all"))
    per = d.join(over, "key").groupBy("key", "n").agg(F.sqrt(F.sum(F.col("dev") + F.col("k") * F.pow(F.col("mean") - F.col("all"), F.lit(2.0))) / F.first("n")).alias("s"))
    return per.select(F.col("key").alias("node"), F.when(F.col("n") == n, -F.col("s")).otherwise(-1e9).alias("score"))


def spectral_drop_scores(graph: Graph, observation: DataFrame) -> DataFrame:
    """``node, score``: fall of the infected graph's leading eigenvalue when the node goes, for every infected node."""
    g = infected_graph(graph, observation).materialized()
    return sweeps.radius_falls(g.edges.select("src", "dst"), g.nodes)


def mean_field_likelihood(graph: Graph, observation: DataFrame, candidates: DataFrame, steps: int = 10) -> DataFrame:
    """``node, score``: log-likelihood of the observation when each candidate is the only source, by the mean-field rollout."""
    e = written(graph.edges.select("src", "dst", F.col("ic_p").alias("w")), "arcs")
    y = graph.nodes.join(observation, "node", "left").select("node", (F.coalesce("y", F.lit(0.0)) >= INFECTED).alias("on"))
    # nodes that no rollout reaches share one term, so only reached ones are joined
    unreached = y.agg(F.sum(F.when(F.col("on"), F.log(F.lit(1e-6))).otherwise(F.log1p(F.lit(-1e-6)))).alias("base"))

    def likelier(x, on):
        p = np.clip(x, 1e-6, 1 - 1e-6)
        return (np.where(on > 0, np.log(p) - np.log(1e-6), np.log1p(-p) - np.log1p(-1e-6)).sum(0),)

    gain = sweeps.mean_fields(e, candidates, steps, y.select("node", F.col("on").cast("double").alias("v")), likelier, "gain", least=1e-12).groupBy("key").agg(F.sum("gain").alias("gain"))
    return gain.join(F.broadcast(unreached)).select(F.col("key").alias("node"), (F.col("base") + F.col("gain")).alias("score"))


def resimulation_scores(graph: Graph, observation: DataFrame, candidates: DataFrame, runs: int = 10, horizon: int = 10) -> DataFrame:
    """``node, score``: minus the mean squared gap of simulated marginals from the observation, each candidate alone."""
    h = dynamics.ic_samples(graph, candidates.select(F.col("node").alias("plan"), "node"), runs, horizon)
    m = dynamics.marginals(h, runs, ["plan"])
    y = graph.nodes.join(observation, "node", "left").select("node", F.coalesce("y", F.lit(0.0)).alias("y"))
    base = y.agg(F.sum(F.col("y") * F.col("y")).alias("base"), F.count("*").alias("n"))
    change = m.join(y, "node").groupBy("plan").agg(F.sum(F.pow(F.col("p") - F.col("y"), F.lit(2.0)) - F.col("y") * F.col("y")).alias("c"))
    return change.join(F.broadcast(base)).select(F.col("plan").alias("node"), (-(F.col("base") + F.col("c")) / F.col("n")).alias("score"))


def greedy_cover_sources(graph: Graph, observation: DataFrame, k: int) -> list[int]:
    """Greedy cover of the infected set by closed infected neighbourhoods, then the least eccentricity."""
    from .selectors import max_coverage

    g = infected_graph(graph, observation)
    sets = g.edges.select(F.col("dst").alias("rr_id"), F.col("src").alias("node")).unionByName(g.nodes.select(F.col("node").alias("rr_id"), "node"))
    return max_coverage(sets, k)


def random_sources(observation: DataFrame, k: int, seed: int = 0) -> DataFrame:
    return top_k(infected_set(observation).select("node", (-coin(F.col("node"), 7, seed, "pick")).alias("score")), k).select("node", "rank")


def residuals(simulated: DataFrame, observation: DataFrame, k: int) -> DataFrame:
    """``node, residual, side``: the nodes most over- and under-explained by the simulated marginals ``node, p``."""
    j = simulated.join(observation, "node", "full_outer").select("node", (F.coalesce("p", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))).alias("residual"))
    over = j.where("residual > 0").orderBy(F.desc("residual"), "node").limit(k).withColumn("side", F.lit("over"))
    under = j.where("residual < 0").orderBy("residual", "node").limit(k).withColumn("side", F.lit("under"))
    return over.unionByName(under)


# --- reconstruction


def mask(history: DataFrame, setting: str, rate: float = 0.5, seed: int = 0) -> DataFrame:
    """What is reported of ``node, time``: partial_nodes, partial_times, final_snapshot or hidden_nodes."""
    shown = coin(F.col("node"), 11, seed, "mask") < rate
    if setting == "partial_nodes":
        return history.where(shown).select("node", "time")
    if setting == "partial_times":
        return history.select("node", F.when(shown, F.col("time")).alias("time"))
    if setting == "final_snapshot":
        return history.select("node", F.lit(None).cast("int").alias("time"))
    if setting == "hidden_nodes":
        return history.where(~shown).select("node", F.lit(None).cast("int").alias("time"))
    raise ValueError(f"unknown setting {setting!r}")


def bfs_times(graph: Graph, roots: DataFrame, members: DataFrame | None, horizon: int) -> DataFrame:
    """``node, time``: hops from the roots inside ``members``, at most the horizon."""
    g = graph if members is None else Graph(members, graph.edges.join(members.withColumnRenamed("node", "dst"), "dst", "left_semi"))
    return structure.distances(g, roots, horizon).select("node", F.col("hop").alias("time"))


def with_parents(graph: Graph, times: DataFrame) -> DataFrame:
    """``node, time, parent``: among earlier in-neighbours the one a step before with the likeliest arc, else any earlier."""
    a, b = times.alias("a"), times.alias("b")
    arcs = graph.edges.join(a, F.col("src") == F.col("a.node")).join(b, F.col("dst") == F.col("b.node")).where(F.col("a.time") < F.col("b.time"))
    best = arcs.groupBy("dst").agg(F.max(F.struct((F.col("a.time") == F.col("b.time") - 1).alias("next"), F.col("ic_p").alias("p"), (-F.col("src")).alias("s"))).alias("m"))
    return times.join(best, F.col("node") == F.col("dst"), "left").select("node", "time", F.when(F.col("time") > 0, -F.col("m.s")).alias("parent"))


def backfilled(graph: Graph, times: DataFrame, rounds: int = 50) -> DataFrame:
    """Until every node after step 0 has an earlier in-neighbour, add the likeliest one at the step before."""
    def step(now: DataFrame, _: int) -> DataFrame:
        a, b = now.alias("a"), now.alias("b")
        ok = graph.edges.join(a, F.col("src") == F.col("a.node")).join(b, F.col("dst") == F.col("b.node")).where(F.col("a.time") < F.col("b.time")).select(F.col("dst").alias("node")).distinct()
        open_ = now.where("time > 0").join(ok, "node", "left_anti")
        pick = open_.join(graph.edges, F.col("node") == F.col("dst")).join(now.select(F.col("node").alias("src")), "src", "left_anti").groupBy("node", "time").agg(F.max(F.struct("ic_p", (-F.col("src")).alias("s"))).alias("m"))
        new = pick.groupBy((-F.col("m.s")).alias("node")).agg(F.min(F.col("time") - 1).alias("time"))
        return now.unionByName(new)

    return iterate(times.select("node", F.col("time").cast("int").alias("time")), step, rounds, lambda a, b: a.count() == b.count(), "times")


def center_times(graph: Graph, reports: DataFrame, horizon: int) -> DataFrame:
    """``node, time``: hops from each reported component's centre inside the reports; unreached ones at the horizon."""
    members = reports.select("node")
    g = infected_graph(graph, members.withColumn("y", F.lit(1.0))).materialized()
    parts = g.nodes.join(connected_components(g.edges), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    best = structure.eccentricity(g).join(parts, "node").groupBy("component").agg(F.min(F.struct("score", "node")).alias("m"))
    t = bfs_times(g, written(best.select("m.node"), "roots"), None, horizon)
    return members.join(t, "node", "left").select("node", F.coalesce("time", F.lit(horizon)).alias("time"))


def closure(graph: Graph, reports: DataFrame, least: int = 2, rounds: int = 50) -> DataFrame:
    """``node``: reports and every node with at least ``least`` member neighbours, to a fixpoint."""
    e = written(undirected(graph.edges), "arcs")

    def step(now: DataFrame, _: int) -> DataFrame:
        new = e.join(now, F.col("src") == F.col("node")).groupBy("dst").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("dst").alias("node"))
        return now.unionByName(new.join(now, "node", "left_anti"))

    return iterate(reports.select("node").distinct(), step, rounds, lambda a, b: a.count() == b.count(), "members")


def restart_members(graph: Graph, reports: DataFrame, size: int, rounds: int = 60) -> DataFrame:
    """``node``: reports and the best others by PageRank that restarts at the reports."""
    n = reports.select("node").distinct().count()
    restart = reports.select("node").distinct().withColumn("weight", F.lit(1.0 / max(1, n)))
    rank = structure.pagerank(graph, rounds=rounds, tolerance=None, restart=restart)
    more = top_k(rank.join(reports, "node", "left_anti"), max(0, size - n)).select("node")
    return reports.select("node").distinct().unionByName(more)


def greedy_origin_times(graph: Graph, reports: DataFrame, k: int, horizon: int) -> tuple[list[int], DataFrame]:
    """Sources by greedy cover of reports per log size of what they reach, and hop times from them.

    A pick searches again from every node and counts the open reports that it reaches, without a row a pair.
    """
    spark = graph.nodes.sparkSession
    e = written(graph.edges.select("src", "dst").distinct(), "arcs")
    reach = written(sweeps.hop_counts(e, graph.nodes, horizon).groupBy("key").agg(F.sum("n").alias("r")), "reach")
    left = written(reports.select("node").distinct(), "open")
    chosen: list[int] = []
    for _ in range(k):
        hit = sweeps.hop_counts(e, graph.nodes, horizon, left).groupBy("key").agg(F.sum("n").alias("n"))
        best = hit.join(reach, "key").select("key", (F.col("n") / (1 + F.log1p("r"))).alias("score")).orderBy(F.desc("score"), "key").first()
        if best is None:
            break
        chosen.append(best["key"])
        met = structure.distances(graph, spark.createDataFrame([(int(best["key"]),)], "node long"), horizon)
        left = written(left.join(met, "node", "left_anti"), "open")
    roots = graph.nodes.sparkSession.createDataFrame([(int(c),) for c in chosen], "node long")
    return chosen, bfs_times(graph, roots, None, horizon)


def cheapest_tree(graph: Graph, reports: DataFrame, horizon: int) -> DataFrame:
    """``node, time, parent``: reports joined in time order by their cheapest -log p paths from the earliest ones.

    Costs are relaxed over all arcs; a node's step counts the arcs of its path.
    """
    first = reports.agg(F.min("time")).first()[0] or 0
    roots = reports.where(F.coalesce("time", F.lit(1 << 30)) <= first).select("node")
    e = written(graph.edges.select("src", "dst", (-F.log(F.greatest("ic_p", F.lit(1e-12)))).alias("cost")), "costs")
    start = roots.select("node", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("parent"))

    def step(now: DataFrame, _: int) -> DataFrame:
        more = now.select("node", F.col("cost").alias("c"), F.col("hops").alias("h")).join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("c") + F.col("cost")).alias("cost"), (F.col("h") + 1).alias("hops"), F.col("src").alias("parent"))
        best = now.unionByName(more).groupBy("node").agg(F.min(F.struct("cost", "hops", "parent")).alias("m"))
        return best.select("node", "m.cost", "m.hops", "m.parent")

    same = lambda a, b: a.agg(F.count("*"), F.sum("cost")).first() == b.agg(F.count("*"), F.sum("cost")).first()
    paths = iterate(start, step, horizon, same, "paths")
    # walk back from the reports along parents
    keep = iterate(reports.select("node").join(paths, "node", "left_semi").distinct(), lambda now, _: now.unionByName(paths.join(now, "node", "left_semi").where("parent is not null").select(F.col("parent").alias("node"))).distinct(), horizon, lambda a, b: a.count() == b.count(), "kept")
    tree = paths.join(keep, "node", "left_semi")
    return tree.select("node", F.least(F.col("hops"), F.lit(horizon)).alias("time"), "parent")


def contradictions(decoded: DataFrame, reports: DataFrame) -> DataFrame:
    """Reported nodes that are missing or placed at another step than reported."""
    j = reports.select("node", F.col("time").alias("said")).join(decoded.select("node", "time"), "node", "left")
    return j.agg(F.sum(F.col("time").isNull().cast("int")).alias("missing"), F.coalesce(F.sum((F.col("said").isNotNull() & (F.col("said") != F.col("time"))).cast("int")), F.lit(0)).alias("moved"))


def history_steps(decoded: DataFrame, horizon: int) -> DataFrame:
    """``t, infected, frontier``: counts at each step that the decoded times imply."""
    steps = decoded.sparkSession.range(horizon + 1).select(F.col("id").cast("int").alias("t"))
    d = decoded.groupBy("time").agg(F.count("*").alias("n"))
    return steps.join(d, F.col("time") <= F.col("t"), "left").groupBy("t").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("infected"), F.coalesce(F.sum(F.when(F.col("time") == F.col("t"), F.col("n"))), F.lit(0)).alias("frontier"))


def history_likelihood(graph: Graph, decoded: DataFrame, horizon: int) -> DataFrame:
    """One value: log-probability of the decoded history, step by step under independent cascade."""
    a = decoded.select(F.col("node").alias("src"), F.col("time").alias("ts"))
    tries = graph.edges.join(a, "src").where(F.col("ts") < horizon).groupBy(F.col("dst").alias("node"), (F.col("ts") + 1).alias("t")).agg(product_of(F.col("ic_p")).alias("p"))
    j = tries.join(decoded.select("node", "time"), "node", "left").where("time is null or time >= t")
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("p")))
    hit = F.coalesce(F.col("time") == F.col("t"), F.lit(False))
    return j.agg(F.coalesce(F.sum(F.when(hit, F.log(p)).otherwise(F.log1p(-p))), F.lit(0.0)).alias("logprob"))
