"""Removal sets that break a graph into small parts: decycling, tree breaking, spectral cuts, reinsertion.

Trees of a forest are handled all at once, spectral cuts of several quantiles in one keyed job;
what is sequential (the next hub of the 2-core, the next node of a cover) costs the driver one row a pick.
"""

from __future__ import annotations

from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Graph, undirected
from ..functions.coins import coin
from ..shared import drop_table, written
from . import selectors, structure
from .components import connected_components
from .structure import peeled


def _without(edges: DataFrame, nodes: list[int]) -> DataFrame:
    return edges.where(~F.col("src").isin(nodes) & ~F.col("dst").isin(nodes)) if nodes else edges


def decycled(edges: DataFrame, k: int) -> list[int]:
    """Up to ``k`` nodes: the best-connected node of the 2-core (ties to the smallest id), until no cycle is left."""
    chosen: list[int] = []
    core = peeled(edges)
    while len(chosen) < k:
        if core.count() <= structure.SMALL:
            left = k - len(chosen)
            picks = core.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda arcs: _hubs(arcs, left), "turn long, src long")
            return [*chosen, *(r["src"] for r in picks.orderBy("turn").collect())]
        best = core.groupBy("src").agg(F.count("*").alias("d")).orderBy(F.desc("d"), "src").first()
        if best is None:
            break
        chosen.append(best["src"])
        core = peeled(_without(core, [best["src"]]))
    return chosen


def _hubs(arcs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The picks of :func:`decycled` within a 2-core that one task holds."""
    near: dict[int, set[int]] = {}
    for a, b in arcs[["src", "dst"]].itertuples(index=False):
        near.setdefault(a, set()).add(b)
    heap = [(-len(n), v) for v, n in near.items()]
    heapify(heap)
    out: list[int] = []
    while heap and len(out) < k:
        d, v = heappop(heap)
        if -d != len(near.get(v, ())) or not d:
            continue  # an older degree
        out.append(v)
        gone = [v]
        while gone:
            u = gone.pop()
            for w in near.pop(u, ()):
                near[w].discard(u)
                if len(near[w]) < 2:
                    gone.append(w)
                heappush(heap, (-len(near[w]), w))
    return pd.DataFrame({"turn": np.arange(len(out)), "src": np.array(out, np.int64)})


def _rest_sizes(_, arcs: pd.DataFrame, sizes: pd.DataFrame) -> pd.DataFrame:
    """:func:`tree_sizes` of a forest that one task holds; nodes beside a cycle are left out."""
    sizes = sizes.sort_values("node")
    ids, size = sizes["node"].to_numpy(np.int64), sizes["size"].tolist()
    a, b = np.searchsorted(ids, arcs["src"]), np.searchsorted(ids, arcs["dst"])
    d = np.bincount(a, minlength=len(ids)).tolist()
    # the sum of a node's neighbours is the last of them once it is a leaf
    last = np.zeros(len(ids), np.int64)
    np.add.at(last, a, b)
    last, out = last.tolist(), []
    out += [(v, -1) for v, n in enumerate(d) if n == 0]
    leaves = [v for v, n in enumerate(d) if n == 1]
    while leaves:
        level = set(leaves)
        cut = [v for v in leaves if not (last[v] in level and v < last[v])]
        roots = [v for v in leaves if last[v] in level and v < last[v]]
        touched = []
        for v in cut:
            p = last[v]
            out.append((v, p))
            size[p] += size[v]
            d[p] -= 1
            last[p] -= v
            touched.append(p)
        out += [(v, -1) for v in roots]
        done = set(roots)
        # a node whose last neighbours all went in this round is a root
        out += [(p, -1) for p in set(touched) if d[p] == 0 and p not in done]
        leaves = [p for p in set(touched) if d[p] == 1]
    node, parent = (np.array([r[i] for r in out], np.int64) for i in (0, 1))
    return pd.DataFrame({"node": ids[node], "parent": pd.array(np.where(parent < 0, 0, ids[parent]), "Int64").copy(), "size": np.array(size, np.int64)[node]}).assign(parent=lambda x: x["parent"].mask(parent < 0))


def tree_sizes(forest: DataFrame) -> DataFrame:
    """``node, parent, size``: every tree of a forest rooted by peeling leaves, with the nodes below each one.

    ``forest`` has arcs both ways. All trees are peeled at once; a round hands the sizes of all leaves
    to their neighbours, so rounds grow with the radius of the widest tree, until one task may hold what is
    left. Of two nodes left the smaller id is the root (parent null). Raises on a cycle.
    """
    arcs = written(forest.select("src", "dst").distinct(), "arcs")
    sizes = written(arcs.select(F.col("src").alias("node")).distinct().withColumn("size", F.lit(1).cast("long")), "sizes")
    out: list[DataFrame] = []
    while True:
        if arcs.count() <= structure.SMALL:
            rest = written(arcs.withColumn("one", F.lit(0)).groupBy("one").cogroup(sizes.withColumn("one", F.lit(0)).groupBy("one")).applyInPandas(_rest_sizes, "node long, parent long, size long"), "rest")
            if rest.count() < sizes.count():
                raise ValueError("a cycle is left: not a forest")
            return reduce(DataFrame.unionByName, out, rest)
        ends = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d"), F.min("dst").alias("parent")).where("d = 1").select("node", "parent")
        twin = ends.select(F.col("node").alias("parent"), F.col("parent").alias("node"))
        # both ends of a last arc are leaves: the smaller one stays
        kept = ends.join(twin.where("node < parent"), ["node", "parent"], "left_anti")
        leaves = written(kept.join(sizes, "node").select("node", "parent", "size"), "leaves")
        if leaves.isEmpty():
            raise ValueError("a cycle is left: not a forest")
        out.append(leaves)
        add = leaves.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("more"))
        sizes = written(sizes.join(leaves, "node", "left_anti").join(add, "node", "left").select("node", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
        gone = leaves.select(F.col("node").alias("x"))
        new = written(arcs.join(gone, F.col("src") == F.col("x"), "left_anti").join(gone, F.col("dst") == F.col("x"), "left_anti"), "arcs")
        drop_table(arcs)
        arcs = new


def centroids(forest: DataFrame) -> DataFrame:
    """``component, node, n, biggest``: for each tree of three nodes or more the node that leaves the smallest largest part."""
    below = written(tree_sizes(forest), "below")
    parts = written(connected_components(forest), "parts")
    n = parts.groupBy("component").agg(F.count("*").alias("n"))
    child = below.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.max("size").alias("child"))
    each = below.join(child, "node", "left").join(parts, "node").join(n, "component").select("component", "node", "n", F.greatest(F.coalesce("child", F.lit(0)), F.col("n") - F.col("size")).alias("biggest"))
    return each.where("n >= 3").groupBy("component", "n").agg(F.min(F.struct("biggest", "node")).alias("m")).select("component", "m.node", "n", "m.biggest")


def broken_trees(forest: DataFrame, k: int) -> DataFrame:
    """``node, n, level``: up to ``k`` nodes that break a forest, always the centroid of its largest tree.

    A level finds the centroids of all trees and cuts there, which halves them, so levels are
    logarithmic. A part is smaller than what it was cut from: the largest trees in order, ties to the
    smallest centroid, are the picks one by one. Stops once no further cut can be among them.
    """
    found, left, level = None, written(forest.select("src", "dst"), "forest"), 0
    while True:
        cuts = written(centroids(left).select("node", "n", F.lit(level).alias("level")), "cuts")
        top = cuts.agg(F.max("n")).first()[0]
        if top is None:
            break
        if found is not None:
            kth = found.orderBy(F.desc("n"), "node").limit(k).agg(F.count("*"), F.min("n")).first()
            if kth[0] == k and kth[1] > top:
                break
        found = cuts if found is None else written(found.unionByName(cuts), "found")
        gone = cuts.select(F.col("node").alias("x"))
        left = written(left.join(gone, F.col("src") == F.col("x"), "left_anti").join(gone, F.col("dst") == F.col("x"), "left_anti"), "forest")
        level += 1
    if found is None:
        return forest.sparkSession.createDataFrame([], "node long, n long, level int")
    return found.orderBy(F.desc("n"), "node").limit(k)


def _cut_down(edges: DataFrame, chosen: list[int], k: int) -> list[int]:
    """``chosen`` and further nodes up to ``k``: hubs of the 2-core first, then centroids."""
    chosen = [*chosen, *decycled(_without(edges, chosen), k - len(chosen))]
    if len(chosen) < k and peeled(_without(edges, chosen)).isEmpty():
        rows = broken_trees(_without(edges, chosen), k - len(chosen)).orderBy(F.desc("n"), "node").collect()
        chosen += [r["node"] for r in rows]
    return chosen


def _filled(graph: Graph, chosen: list[int], k: int) -> DataFrame:
    return selectors.padded(graph, selectors.ranked(graph, chosen), k)


def decycling(graph: Graph, k: int) -> DataFrame:
    """``node, rank``: hubs of the 2-core until the rest is a forest, then its trees at their centroids, then hubs."""
    return _filled(graph, _cut_down(written(undirected(graph.edges), "arcs"), [], k), k)


def reinserted(graph: Graph, removed: list[int], threshold: float = 0.01) -> list[int]:
    """What is left of ``removed`` when nodes come back, those with fewest neighbours first, where the largest part stays in bounds.

    The bound is ``threshold`` of all nodes, or the largest part that the removal leaves if that is
    larger. Parts are found once; then only the removed nodes' neighbouring parts are kept up to date.
    """
    spark = graph.nodes.sparkSession
    edges = written(undirected(graph.edges), "arcs")
    out = spark.createDataFrame([(int(v), i) for i, v in enumerate(removed)], "node long, turn int")
    rest = _without(edges, removed)
    parts = graph.nodes.select("node").join(out, "node", "left_anti").join(connected_components(rest), "node", "left").select("node", F.coalesce("component", "node").alias("part"))
    parts = written(parts, "parts")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    giant = sizes.agg(F.max("n")).first()[0] or 0
    bar = max(threshold * graph.nodes.count(), giant)
    beside = edges.join(out.select(F.col("node").alias("src")), "src", "left_semi")
    order = [r["node"] for r in out.join(beside.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d")), "node", "left").orderBy(F.coalesce("d", F.lit(0)), "turn").select("node").collect()]
    near = written(beside.join(parts, F.col("dst") == F.col("node")).select(F.col("src").alias("at"), "part").distinct().join(sizes, "part").select("at", F.col("part").cast("string").alias("part"), "n"), "near")
    among = written(beside.join(out.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), "among")
    back: set[int] = set()
    for v in order:
        merged = 1 + (near.where(F.col("at") == v).agg(F.sum("n")).first()[0] or 0)
        if merged > bar:
            continue
        back.add(v)
        joined = near.where(F.col("at") == v).select("part", F.lit(1).alias("same"))
        name, size = F.lit(f"with {v}"), F.lit(merged).cast("long")
        moved = near.join(joined, "part", "left").select("at", F.when(F.col("same") == 1, name).otherwise(F.col("part")).alias("part"), F.when(F.col("same") == 1, size).otherwise(F.col("n")).alias("n"))
        more = among.where(F.col("dst") == v).select(F.col("src").alias("at"), name.alias("part"), size.alias("n"))
        near = written(moved.unionByName(more).distinct(), "near")
    return [v for v in removed if v not in back]


def decycling_reinserted(graph: Graph, k: int, threshold: float = 0.01) -> DataFrame:
    """``node, rank``: decycling, reinsertion, and the freed picks spent on the parts that are left in the same way."""
    edges = written(undirected(graph.edges), "arcs")
    kept = reinserted(graph, _cut_down(edges, [], k), threshold)
    return _filled(graph, _cut_down(edges, kept, k), k)


# --- spectral cuts


def second_vectors(edges: DataFrame, rounds: int = 60, unrolled: int = 4) -> DataFrame:
    """``arm, node, x``: second eigenvector of the normalised adjacency, for each graph of ``arm, src, dst`` (both ways).

    Power iteration of half the identity and half the matrix, whose first eigenvector (the roots of
    the degrees) is known and taken out; a few steps are one job. The smallest node's entry is not positive.
    """
    degrees = edges.groupBy("arm", F.col("src").alias("node")).agg(F.sqrt(F.count("*").cast("double")).alias("r"))
    x = written(degrees.withColumn("x", coin(F.col("node"), 13, 0, "weight") - 0.5), "vector")
    a = written(edges.select("arm", "src", "dst"), "arcs")
    for _ in range(0, rounds, unrolled):
        sums = x.groupBy("arm").agg((F.sum(F.col("x") * F.col("r")) / F.sum(F.col("r") * F.col("r"))).alias("dot"))
        clean = x.join(sums, "arm").select("arm", "node", "r", (F.col("x") - F.col("dot") * F.col("r")).alias("x"))
        norms = clean.groupBy("arm").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        now = clean.join(norms, "arm").select("arm", "node", "r", F.when(F.col("norm") > 0, F.col("x") / F.col("norm")).otherwise(0.0).alias("x"))
        for _ in range(unrolled):
            y = now.join(a, (now["arm"] == a["arm"]) & (now["node"] == a["src"])).groupBy(now["arm"].alias("arm"), F.col("dst").alias("node")).agg(F.sum(F.col("x") / F.col("r")).alias("y"))
            now = now.join(y, ["arm", "node"]).select("arm", "node", "r", ((F.col("x") + F.col("y") / F.col("r")) / 2).alias("x"))
        new = written(now, "vector")
        drop_table(x)
        x = new
    sign = x.groupBy("arm").agg(F.min_by("x", "node").alias("first"))
    return x.join(sign, "arm").select("arm", "node", F.when(F.col("first") > 0, -F.col("x")).otherwise(F.col("x")).alias("x"))


def spectral_removals(graph: Graph, k: int, quantiles: list[float], cost: str = "unit", least: int = 8, rounds: int = 60) -> list[list[int]]:
    """Up to ``k`` nodes for each quantile: the largest part is cut at that quantile of its second vector, over and over.

    The arcs across are covered by the nodes that cover most for their cost (1, or the degree). All quantiles run in the same
    jobs, and those that have removed the same nodes share a graph and its vector; the driver sees one row a quantile and pick.
    """
    spark, base = graph.nodes.sparkSession, written(undirected(graph.edges), "arcs")
    price = base.groupBy(F.col("src").alias("node")).agg((F.lit(1.0) if cost == "unit" else F.count("*").cast("double")).alias("price"))
    chosen: list[list[int]] = [[] for _ in quantiles]
    # quantiles that have removed the same nodes cut one graph between them, so all start with the whole one
    alike, edges = [list(range(len(quantiles)))], written(base.select(F.lit(0).alias("arm"), "src", "dst"), "edges")
    while alike and not edges.isEmpty():
        many = len(alike)
        # one run over all graphs: their nodes are numbered apart
        numbered = edges.select((F.col("src") * many + F.col("arm")).alias("src"), (F.col("dst") * many + F.col("arm")).alias("dst"))
        parts = connected_components(numbered).select(F.pmod("node", F.lit(many)).cast("int").alias("arm"), F.floor(F.col("node") / many).alias("node"), "component")
        parts = written(parts, "parts")
        largest = parts.groupBy("arm", "component").agg(F.count("*").alias("n")).groupBy("arm").agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("m")).where(F.col("m.n") > least).select("arm", (-F.col("m.c")).alias("component"))
        members = parts.join(largest, ["arm", "component"], "left_semi").select("arm", F.col("node").alias("src"))
        inner = written(edges.join(members, ["arm", "src"], "left_semi"), "inner")
        if inner.isEmpty():
            break
        x = written(second_vectors(inner, rounds), "second")
        at = x.groupBy("arm").agg(F.percentile_approx("x", F.array(*map(F.lit, quantiles)), F.lit(100_000)).alias("at"))
        # from here on each quantile is an arm of its own
        named = spark.createDataFrame([(g, i) for g, same in enumerate(alike) for i in same], "arm int, own int")
        at = at.join(named, "arm").select("arm", "own", F.element_at("at", F.col("own") + 1).alias("at"))
        side = written(x.join(F.broadcast(at), "arm").select("arm", "own", "node", (F.col("x") <= F.col("at")).alias("low")), "side")
        low, high = side.where("low").select("arm", "own", F.col("node").alias("src")), side.where("not low").select("own", F.col("node").alias("dst"))
        cut = written(inner.join(low, ["arm", "src"]).join(high, ["own", "dst"], "left_semi").select(F.col("own").alias("arm"), "src", "dst"), "cut")
        picked: list[list[int]] = [[] for _ in quantiles]
        while True:
            left = _apart(cut, spark.createDataFrame([(i, v) for i, p in enumerate(picked) for v in p], "arm int, x long")) if any(picked) else cut
            ends = left.select("arm", F.col("src").alias("node")).unionByName(left.select("arm", F.col("dst").alias("node"))).groupBy("arm", "node").agg(F.count("*").alias("n"))
            best = ends.join(price, "node").groupBy("arm").agg(F.max(F.struct((F.col("n") / F.col("price")).alias("r"), (-F.col("node")).alias("v"))).alias("m")).collect()
            new = [(r["arm"], -r["m"]["v"]) for r in best if len(chosen[r["arm"]]) < k]
            if not new:
                break
            for arm, v in new:
                chosen[arm].append(v)
                picked[arm].append(v)
            if all(len(c) >= k for c in chosen):
                break
        for used in (parts, inner, x, side, cut):
            drop_table(used)
        # of the quantiles that go on, those that picked alike stay together
        groups: dict[tuple, list[int]] = {}
        for g, same in enumerate(alike):
            for i in same:
                if picked[i] and len(chosen[i]) < k:
                    groups.setdefault((g, *sorted(picked[i])), []).append(i)
        alike = list(groups.values())
        if not alike:
            break
        turned = edges.join(F.broadcast(spark.createDataFrame([(key[0], g) for g, key in enumerate(groups)], "arm int, next int")), "arm").select(F.col("next").alias("arm"), "src", "dst")
        left = written(_apart(turned, spark.createDataFrame([(g, v) for g, key in enumerate(groups) for v in key[1:]], "arm int, x long")), "edges")
        drop_table(edges)
        edges = left
    return chosen


def _apart(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Arcs of ``arm, src, dst`` without an end in ``gone(arm, x)``."""
    return edges.join(gone.withColumnRenamed("x", "src"), ["arm", "src"], "left_anti").join(gone.withColumnRenamed("x", "dst"), ["arm", "dst"], "left_anti").select("arm", "src", "dst")


def spectral_ensemble(graph: Graph, k: int, members: int = 5, spread: float = 0.2, rounds: int = 60, least: int = 8) -> DataFrame:
    """``node, rank``: of the removals by cuts at quantiles around the median the one that leaves the smallest largest part."""
    offsets = [spread * i / max(1, members - 1) for i in range(members)]
    quantiles = [min(0.95, max(0.05, 0.5 + (o if i % 2 else -o))) for i, o in enumerate(offsets)]
    found = spectral_removals(graph, k, quantiles, rounds=rounds, least=least)
    spark, base = graph.nodes.sparkSession, written(undirected(graph.edges), "arcs")
    full = [c if len(c) >= k else [r["node"] for r in _filled(graph, c, k).orderBy("rank").collect()] for c in found]
    # plans of the same nodes leave the same parts
    plans = list(dict.fromkeys(tuple(sorted(c)) for c in full))
    many = len(plans)
    gone = spark.createDataFrame([(i, int(v)) for i, c in enumerate(plans) for v in c], "arm int, x long")
    left = _apart(base.crossJoin(F.broadcast(spark.createDataFrame([(i,) for i in range(many)], "arm int"))), gone)
    parts = connected_components(left.select((F.col("src") * many + F.col("arm")).alias("src"), (F.col("dst") * many + F.col("arm")).alias("dst")))
    sizes = {r["arm"]: r["n"] for r in parts.groupBy("component").agg(F.count("*").alias("n")).groupBy(F.pmod("component", F.lit(many)).cast("int").alias("arm")).agg(F.max("n").alias("n")).collect()}
    giant = {i: sizes[plans.index(tuple(sorted(c)))] for i, c in enumerate(full) if plans.index(tuple(sorted(c))) in sizes}
    best = min(range(members), key=lambda i: (giant.get(i, 1), i))
    return selectors.ranked(graph, full[best])
