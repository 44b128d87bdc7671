"""Structural measures of graphs as message passing over edge tables."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import Graph, iterate, undirected
from ..shared import drop_table, written
from . import sweeps
from .components import connected_components

#: Rounds of peeling that one job does, and arcs that one task may hold to peel the rest of a graph.
STEPS, SMALL = 3, 1 << 20
#: Arcs between two groups of nodes, about, and wedges looked at together, when triangles are counted.
PART = 1 << 20


def degree(graph: Graph) -> DataFrame:
    """``node, score``: arcs in and out."""
    ends = graph.edges.select(F.col("src").alias("node")).unionByName(graph.edges.select(F.col("dst").alias("node")))
    return _scored(graph, ends.groupBy("node").agg(F.count("*").cast("double").alias("score")))


def out_degree(graph: Graph) -> DataFrame:
    return _scored(graph, graph.edges.groupBy(F.col("src").alias("node")).agg(F.count("*").cast("double").alias("score")))


def weighted_degree(graph: Graph) -> DataFrame:
    """Sum of outgoing probabilities."""
    return _scored(graph, graph.edges.groupBy(F.col("src").alias("node")).agg(F.sum("ic_p").alias("score")))


def neighbour_degree(graph: Graph) -> DataFrame:
    """Distinct neighbours in the undirected view."""
    return _scored(graph, undirected(graph.edges).groupBy(F.col("src").alias("node")).agg(F.count("*").cast("double").alias("score")))


def _scored(graph: Graph, scores: DataFrame) -> DataFrame:
    return graph.nodes.join(scores, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def log_degree(graph: Graph) -> DataFrame:
    return degree(graph).select("node", F.log1p("score").alias("score"))


def pagerank(graph: Graph, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-9, restart: DataFrame | None = None) -> DataFrame:
    """``node, score``; mass of nodes without outgoing arcs is spread like the restart (evenly by default).

    ``restart(node, weight)`` with weights that sum to 1 personalises it. Stops when the
    scores' absolute changes sum to less than ``tolerance``; None runs all rounds.
    """
    n = graph.nodes.count()
    out = graph.edges.groupBy("src").agg(F.count("*").alias("out"))
    arcs = written(graph.edges.join(out, "src").select("src", "dst", (F.lit(1.0) / F.col("out")).alias("share")), "shares")
    sinks = graph.nodes.join(out, graph.nodes["node"] == out["src"], "left_anti").select("node")
    base = graph.nodes.withColumn("weight", F.lit(1.0 / max(1, n))) if restart is None else graph.nodes.join(restart, "node", "left").select("node", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    base = written(base.join(sinks.withColumn("sink", F.lit(True)), "node", "left").select("node", "weight", F.coalesce("sink", F.lit(False)).alias("sink")), "base")

    def step(now: DataFrame, _: int) -> DataFrame:
        lost = now.where("sink").agg(F.sum("score")).first()[0] or 0.0
        got = arcs.join(now, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        new = base.join(got, F.col("node") == F.col("dst"), "left")
        return new.select("node", "weight", "sink", (F.lit(1 - damping) * F.col("weight") + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost) * F.col("weight"))).alias("score"))

    def settled(old: DataFrame, new: DataFrame) -> bool:
        change = old.select("node", F.col("score").alias("was")).join(new, "node").agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0]
        return change is None or change < tolerance

    start = base.select("*", F.col("weight").alias("score"))
    return iterate(start, step, rounds, settled if tolerance is not None else None, "rank").select("node", "score")


def eigenvector(graph: Graph, rounds: int = 100, both_ways: bool = False, weight: str | None = None) -> DataFrame:
    """``node, score``: power iteration along incoming arcs, scaled to length 1 each round."""
    edges = undirected(graph.edges).withColumn("w", F.lit(1.0)) if both_ways else graph.edges.select("src", "dst", (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    edges = written(edges, "arcs")

    def step(now: DataFrame, _: int) -> DataFrame:
        got = edges.join(now, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("score") * F.col("w")).alias("got"))
        new = written(graph.nodes.join(got, F.col("node") == F.col("dst"), "left").select("node", F.coalesce("got", F.lit(0.0)).alias("score")), "raw")
        length = (new.agg(F.sum(F.col("score") * F.col("score"))).first()[0] or 0.0) ** 0.5
        return new.select("node", (F.col("score") / F.lit(max(length, 1e-12))).alias("score"))

    n = max(1, graph.nodes.count())
    return iterate(graph.nodes.select("node", F.lit(n**-0.5).alias("score")), step, rounds, None, "vector")


def spectral_radius(graph: Graph, removed: DataFrame | None = None, rounds: int = 60) -> float:
    """Leading eigenvalue of the undirected view after removals; 0 without edges."""
    g = graph if removed is None else graph.without(removed)
    e = written(undirected(g.edges), "arcs")
    if e.isEmpty():
        return 0.0
    # a shift by 1 keeps bipartite graphs from swinging between two vectors
    x = written(g.nodes.select("node", F.lit(1.0).alias("score")), "vector")
    top = 0.0
    for _ in range(rounds):
        got = e.join(x, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum("score").alias("got"))
        new = written(x.join(got, F.col("node") == F.col("dst"), "left").select("node", (F.col("score") + F.coalesce("got", F.lit(0.0))).alias("score")), "vector")
        size = new.agg(F.max("score")).first()[0]
        drop_table(x)
        x = written(new.select("node", (F.col("score") / F.lit(size)).alias("score")), "vector")
        drop_table(new)
        if abs(size - 1 - top) < 1e-9:
            break
        top = size - 1
    return float(size - 1)


def spectral_radii(graph: Graph, without: list[int | None], rounds: int = 60) -> list[float]:
    """:func:`spectral_radius` of the graph without each of some nodes (None: whole), all of them columns of the same vector.

    An arc is joined once a round for all of them; each stops where it would alone.
    """
    e = written(undirected(graph.edges), "arcs")
    k = len(without)
    # entries of a node that is out stay 0
    first = F.array(*(F.lit(1.0) if v is None else F.when(F.col("node") == v, 0.0).otherwise(1.0) for v in without))
    x = written(graph.nodes.select("node", first.alias("x")), "vector")
    scale, top, out = [1.0] * k, [0.0] * k, [None] * k
    for turn in range(rounds):
        scaled = [F.col("x")[i] / F.lit(scale[i]) for i in range(k)]
        now = x.select("node", *(c.alias(f"x{i}") for i, c in enumerate(scaled)))
        got = e.join(now.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(*(F.sum(f"x{i}").alias(f"g{i}") for i in range(k)))
        kept = [F.when(F.col(f"x{i}") == 0, 0.0).otherwise(F.col(f"x{i}") + F.coalesce(f"g{i}", F.lit(0.0))) for i in range(k)]
        new = written(now.join(got, F.col("node") == F.col("dst"), "left").select("node", F.array(*kept).alias("x")), "vector")
        drop_table(x)
        x = new
        size = x.agg(*(F.max(F.col("x")[i]) for i in range(k))).first()
        for i in range(k):
            # nothing left has no eigenvalue, and neither have nodes without arcs
            scale[i] = size[i] or 1.0
            if out[i] is None and (abs(scale[i] - 1 - top[i]) < 1e-9 or turn == rounds - 1):
                out[i] = float(scale[i] - 1)
            top[i] = scale[i] - 1
        if None not in out:
            break
    return out


def core_numbers(graph: Graph) -> DataFrame:
    """``node, core``: the largest k such that the node is in the k-core of the undirected view (h-index iteration)."""
    e = written(undirected(graph.edges), "arcs")
    start = graph.nodes.join(e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("core")), "node", "left").select("node", F.coalesce("core", F.lit(0)).cast("long").alias("core"))

    def step(now: DataFrame, _: int) -> DataFrame:
        # a neighbour list is summed by value first, so a hub is a few counts and not its neighbours
        per = e.join(now, F.col("dst") == F.col("node")).groupBy("src", "core").agg(F.count("*").alias("n"))
        above = F.sum("n").over(Window.partitionBy("src").orderBy(F.desc("core")).rowsBetween(Window.unboundedPreceding, 0))
        h = per.withColumn("above", above).groupBy("src").agg(F.max(F.least("core", "above")).alias("h"))
        return now.join(h, F.col("node") == F.col("src"), "left").select("node", F.least("core", F.coalesce("h", F.lit(0))).alias("core"))

    same = lambda old, new: old.agg(F.sum("core")).first()[0] == new.agg(F.sum("core")).first()[0]
    return iterate(start, step, 1000, same, "cores")


def two_core(graph: Graph) -> DataFrame:
    """``node`` of the 2-core."""
    return peeled(undirected(graph.edges)).select(F.col("src").alias("node")).distinct()


def peeled(edges: DataFrame) -> DataFrame:
    """Arcs (both ways) of the 2-core: ends with one neighbour go until none is left.

    A round takes all such ends, so there are as many rounds as the longest dangling path has nodes; what is
    left after some rounds is a bounded table as a rule, and those are peeled in one task.
    """
    now = written(edges.select("src", "dst"), "core")
    while True:
        size = now.groupBy("src").agg(F.count("*").alias("d")).agg(F.sum("d"), F.min("d")).first()
        if size[0] is None or size[1] >= 2:
            return now
        step = now
        if size[0] <= SMALL:
            step = now.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_peeled_rows, "src long, dst long")
        else:
            for _ in range(STEPS):
                inner = step.groupBy("src").agg(F.count("*").alias("d")).where("d >= 2").select(F.col("src").alias("node"))
                step = step.join(inner, F.col("src") == F.col("node"), "left_semi").join(inner, F.col("dst") == F.col("node"), "left_semi")
        new = written(step, "core")
        drop_table(now)
        now = new


def _peeled_rows(arcs: pd.DataFrame) -> pd.DataFrame:
    ids, both = np.unique(arcs[["src", "dst"]].to_numpy(np.int64), return_inverse=True)
    both = both.reshape(-1, 2)
    while True:
        on = np.bincount(both[:, 0], minlength=len(ids)) >= 2
        keep = on[both[:, 0]] & on[both[:, 1]]
        if keep.all():
            return pd.DataFrame(ids[both], columns=["src", "dst"])
        both = both[keep]


def communities(graph: Graph, rounds: int = 20) -> DataFrame:
    """``node, label``: each round a node takes its neighbours' commonest label, the smallest of several."""
    e = written(undirected(graph.edges), "arcs")

    def step(now: DataFrame, _: int) -> DataFrame:
        votes = e.join(now, F.col("dst") == F.col("node")).groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.max(F.struct("n", (-F.col("label")).alias("label"))).alias("best"))
        return now.join(best, F.col("node") == F.col("src"), "left").select("node", F.coalesce(-F.col("best.label"), F.col("label")).alias("label"))

    same = lambda old, new: old.exceptAll(new).isEmpty()
    return iterate(graph.nodes.select("node", F.col("node").alias("label")), step, rounds, same, "labels")


def distances(graph: Graph, sources: DataFrame, max_hops: int = 1 << 20, both_ways: bool = False, keyed: bool = False) -> DataFrame:
    """``(key,) node, hop`` of every node within ``max_hops`` of ``sources(node)``; with ``keyed``, for each source on its own."""
    if keyed:
        return sweeps.hop_rows(_simple(graph, both_ways), sources, max_hops)
    e = written(undirected(graph.edges) if both_ways else graph.edges.select("src", "dst").distinct(), "arcs")
    frontier = written(sources.select("node").distinct().withColumn("hop", F.lit(0)), "frontier")
    seen, hop = frontier, 0
    while hop < max_hops:
        hop += 1
        new = frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))
        frontier = written(new, "frontier")
        if frontier.isEmpty():
            break
        seen = written(seen.unionByName(frontier), "seen")
    return seen


def _simple(graph: Graph, both_ways: bool) -> DataFrame:
    return written(undirected(graph.edges) if both_ways else graph.edges.select("src", "dst").distinct(), "arcs")


def closeness(graph: Graph, sources: DataFrame | None = None, both_ways: bool = False) -> DataFrame:
    """``node, score``: reached / total distance, scaled by the share of nodes reached (outgoing paths)."""
    n = graph.nodes.count()
    d = sweeps.hop_counts(_simple(graph, both_ways), graph.nodes if sources is None else sources)
    per = d.where("hop > 0").groupBy(F.col("key").alias("node")).agg(F.sum("n").alias("r"), F.sum(F.col("hop") * F.col("n")).alias("t"))
    scored = per.select("node", (F.col("r") / F.col("t") * F.col("r") / F.lit(max(1, n - 1))).alias("score"))
    return _scored(graph, scored)


def eccentricity(graph: Graph, sources: DataFrame | None = None, within: DataFrame | None = None, both_ways: bool = True) -> DataFrame:
    """``node, score``: the largest distance to a reachable node (of ``within``)."""
    d = sweeps.hop_counts(_simple(graph, both_ways), graph.nodes if sources is None else sources, within=within)
    return d.groupBy(F.col("key").alias("node")).agg(F.max("hop").cast("double").alias("score"))


def betweenness(graph: Graph, pivots: DataFrame | None = None, both_ways: bool = False) -> DataFrame:
    """``node, score``: Brandes dependencies summed over ``pivots`` (all nodes by default)."""
    half = 0.5 if both_ways else 1.0
    dep = sweeps.dependencies(_simple(graph, both_ways), graph.nodes if pivots is None else pivots)
    return _scored(graph, dep.select("node", (F.col("score") * half).alias("score")))


def path_influence(graph: Graph, max_hops: int = 3) -> DataFrame:
    """``node, score``: over all other nodes, the best product of probabilities on a path of up to ``max_hops`` arcs."""
    e = written(graph.edges.select("src", "dst", F.col("ic_p").alias("w")), "arcs")
    nodes = e.select(F.col("dst").alias("node")).distinct().withColumn("v", F.lit(1.0))
    total = sweeps.best_products(e, graph.nodes, max_hops, nodes, lambda x, v: (np.where(np.isinf(x), 0, x).sum(0),), "score")
    return _scored(graph, total.groupBy(F.col("key").alias("node")).agg(F.sum("score").alias("score")))


def max_probability_paths(graph: Graph, sources: DataFrame, threshold: float = 1 / 320, max_hops: int = 64) -> DataFrame:
    """``key, node, p, hops``: best path product of at least ``threshold`` from each source, and its arcs."""
    e = written(graph.edges.select("src", "dst", "ic_p"), "arcs")
    start = written(sources.select(F.col("node").alias("key"), "node", F.lit(1.0).alias("p"), F.lit(0).alias("hops")), "paths")

    def step(now: DataFrame, _: int) -> DataFrame:
        more = now.join(e, F.col("node") == F.col("src")).select("key", F.col("dst").alias("node"), (F.col("p") * F.col("ic_p")).alias("p"), (F.col("hops") + 1).alias("hops")).where(F.col("p") >= threshold)
        best = now.unionByName(more).groupBy("key", "node").agg(F.max(F.struct("p", (-F.col("hops")).alias("h"))).alias("b"))
        return best.select("key", "node", F.col("b.p").alias("p"), (-F.col("b.h")).alias("hops"))

    same = lambda old, new: old.agg(F.count("*"), F.sum("p")).first() == new.agg(F.count("*"), F.sum("p")).first()
    return iterate(start, step, max_hops, same, "paths")


def shortest_costs(edges: DataFrame, sources: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``key, node, cost``: least sum of ``cost`` over paths from each source; every round relaxes all arcs.

    Costs that still fall in the last round are an error: a path has more arcs than rounds.
    """
    e = written(edges.select("src", "dst", "cost"), "arcs")
    start = sources.select(F.col("node").alias("key"), "node", F.lit(0.0).alias("cost"))

    def step(now: DataFrame, _: int) -> DataFrame:
        more = now.select("key", "node", F.col("cost").alias("c")).join(e, F.col("node") == F.col("src")).select("key", F.col("dst").alias("node"), (F.col("c") + F.col("cost")).alias("cost"))
        return now.unionByName(more).groupBy("key", "node").agg(F.min("cost").alias("cost"))

    same = lambda old, new: old.agg(F.count("*"), F.sum("cost")).first() == new.agg(F.count("*"), F.sum("cost")).first()
    return iterate(start, step, max_rounds, same, "costs", settle=True)


def triangles(graph: Graph) -> DataFrame:
    """``node, triangles, degree, clustering``; arcs run from lower to higher degree, so hubs close no pairs."""
    e = undirected(graph.edges)
    d = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    ranked = e.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = written(ranked.where("ds < dd or (ds = dd and src < dst)").select("src", "dst"), "arcs")
    per = _closed(up).groupBy("node").agg(F.sum("n").alias("triangles"))
    out = graph.nodes.join(d, "node", "left").join(per, "node", "left").select("node", F.coalesce("triangles", F.lit(0)).alias("triangles"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return out.withColumn("clustering", F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def _closed(up: DataFrame) -> DataFrame:
    """``node, n``: triangles of an acyclic ``up(src, dst)`` at each node, in parts.

    Nodes are dealt to groups. A triangle's arcs lie between its nodes' groups, so each task gets the arcs among
    three of them, which are bounded as there are more groups for more arcs; wedges are closed there and never shuffled.
    """
    groups = max(1, math.ceil((up.count() / PART) ** 0.5))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    # of a triangle x -> y -> z, x -> z the arc x, y is wanted with any group as the third, and so on
    any_ = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    at = up.select("src", "dst", of("src").alias("s"), of("dst").alias("d"))
    roles = [at.select("src", "dst", F.lit(r).alias("role"), *(F.col(c).alias(n) if c else any_.alias(n) for c, n in zip(cols, "ijk"))) for r, cols in enumerate((("s", "d", None), ("s", None, "d"), (None, "s", "d")))]
    return reduce(DataFrame.unionByName, roles).groupBy("i", "j", "k").applyInPandas(_closed_rows, "node long, n long")


def _closed_rows(arcs: pd.DataFrame) -> pd.DataFrame:
    ids, both = np.unique(arcs[["src", "dst"]].to_numpy(np.int64), return_inverse=True)
    both, role, m = both.reshape(-1, 2), arcs["role"].to_numpy(), len(ids)
    xy, xz, yz = (both[role == r] for r in range(3))
    xz = xz[np.argsort(xz[:, 0], kind="stable")]
    pairs = np.sort(yz[:, 0] * m + yz[:, 1])
    total = np.zeros(m, np.int64)
    if not (len(xy) and len(xz) and len(pairs)):
        return pd.DataFrame({"node": ids[:0], "n": total[:0]})
    lo, hi = (np.searchsorted(xz[:, 0], xy[:, 0], side) for side in ("left", "right"))
    ends = np.cumsum(hi - lo)
    at = 0
    while at < len(xy):
        # wedges of some arcs at a time
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
        n = (hi - lo)[at:stop]
        arc = np.repeat(np.arange(at, stop), n)
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:stop], n)
        x, y, z = xy[arc, 0], xy[arc, 1], xz[other, 1]
        code = y * m + z
        found = np.searchsorted(pairs, code)
        on = pairs[np.minimum(found, len(pairs) - 1)] == code
        for nodes in (x, y, z):
            total += np.bincount(nodes[on], minlength=m)
        at = stop
    on = total > 0
    return pd.DataFrame({"node": ids[on], "n": total[on]})


def profile(graph: Graph) -> DataFrame:
    """One row: nodes, arcs, density, degree and probability statistics, components, mean clustering."""
    n = graph.nodes.agg(F.count("*").alias("nodes"))
    a = graph.edges.agg(F.count("*").alias("arcs"), F.avg("ic_p").alias("mean_p"), F.max("ic_p").alias("max_p"), F.expr("percentile(ic_p, 0.5)").alias("median_p"))
    d = degree(graph).agg(F.avg("score").alias("mean_degree"), F.max("score").alias("max_degree"), F.expr("percentile(score, 0.5)").alias("median_degree"))
    c = residual_components(graph).agg(F.count("*").alias("components"), F.max("size").alias("largest"))
    t = triangles(graph).agg(F.avg("clustering").alias("mean_clustering"), (F.sum("triangles") / 3).cast("long").alias("triangles"))
    out = n.join(a).join(d).join(c).join(t)
    return out.withColumn("density", F.when(F.col("nodes") > 1, F.col("arcs") / (F.col("nodes") * (F.col("nodes") - 1.0))).otherwise(0.0))


def residual_components(graph: Graph, removed: DataFrame | None = None) -> DataFrame:
    """``component, size`` of what is left; isolated nodes are components of their own."""
    g = graph if removed is None else graph.without(removed)
    parts = connected_components(g.edges)
    labelled = g.nodes.join(parts, "node", "left").select(F.coalesce("component", "node").alias("component"))
    return labelled.groupBy("component").agg(F.count("*").alias("size"))


def connectivity(graph: Graph, removed: DataFrame | None = None) -> DataFrame:
    """One row: pairwise connectivity, largest component and its share of all nodes, number of components."""
    n = max(1, graph.nodes.count())
    size = F.col("size")
    return residual_components(graph, removed).agg(F.coalesce(F.sum(size * (size - 1) / 2), F.lit(0.0)).cast("long").alias("pairwise"), F.coalesce(F.max(size), F.lit(0)).alias("largest"), (F.coalesce(F.max(size), F.lit(0)) / F.lit(float(n))).alias("largest_share"), F.count("*").alias("components"))


def dismantling_curve(graph: Graph, order: DataFrame) -> DataFrame:
    """``q, share``: the largest component's share after the first q nodes of ``order(node, rank)`` go, q from 0.

    All prefixes run at once: a copy of the graph for each, with ids set apart by q.
    """
    n = graph.nodes.count()
    k = order.count()
    steps = graph.nodes.sparkSession.range(k + 1).withColumnRenamed("id", "q")
    ranked = order.select("node", "rank")
    label = lambda side: ranked.select(F.col("node").alias(side), F.col("rank").alias(f"{side}_rank"))
    e = undirected(graph.edges).join(label("src"), "src", "left").join(label("dst"), "dst", "left")
    # an arc is there until the earlier of its ends goes
    last = F.least(F.coalesce("src_rank", F.lit(k + 1)), F.coalesce("dst_rank", F.lit(k + 1))) - 1
    wide = F.lit(1 << 40)
    kept = e.where("src < dst").withColumn("q", F.explode(F.sequence(F.lit(0), F.least(last, F.lit(k)).cast("int"))))
    parts = connected_components(kept.select((F.col("src") + F.col("q") * wide).alias("src"), (F.col("dst") + F.col("q") * wide).alias("dst")))
    sizes = parts.groupBy("component").agg(F.count("*").alias("size")).groupBy(F.floor(F.col("component") / wide).alias("q")).agg(F.max("size").alias("size"))
    alone = F.when(F.col("q") < n, 1).otherwise(0)
    return steps.join(sizes, "q", "left").select("q", (F.coalesce("size", alone) / F.lit(float(n))).alias("share"))
