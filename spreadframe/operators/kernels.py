"""Routines that are sequential within one small graph: one group for each sample, instance or graph.

Dominator trees, reinsertion and the like depend on all earlier steps of
the same graph. Groups run side by side; a group is one graph of bounded size, and callers with
larger graphs cut them into components first. Above ``MOST`` arcs a group is refused. Fiedler cuts of larger
graphs run as jobs over all arcs.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import numbered, undirected
from ..shared import drop_table, written
from .components import connected_components
from .spectra import second_vector
from .sweeps import certificate

MOST = 2_000_000


def _checked(g: pd.DataFrame) -> pd.DataFrame:
    if len(g) > MOST:
        raise ValueError(f"a group of {len(g)} arcs is too large for a sequential routine; cut it into components")
    return g


def _neighbours(g: pd.DataFrame) -> dict[int, set[int]]:
    near: dict[int, set[int]] = defaultdict(set)
    for u, v in zip(g["src"].tolist(), g["dst"].tolist()):
        if u != v:
            near[u].add(v)
            near[v].add(u)
    return near


def _pieces(near: dict[int, set[int]], gone: set[int]) -> list[list[int]]:
    seen, out = set(gone), []
    for s in sorted(near):
        if s in seen:
            continue
        seen.add(s)
        part, at = [s], 0
        while at < len(part):
            for w in near[part[at]]:
                if w not in seen:
                    seen.add(w)
                    part.append(w)
            at += 1
        out.append(part)
    return out


def dominated(live: DataFrame, sources: DataFrame) -> DataFrame:
    """``sample, node, idom, size`` in each live graph (``sample, src, dst``): immediate dominator from the merged sources and subtree size."""
    starts = [r["node"] for r in sources.select("node").distinct().orderBy("node").collect()]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        _checked(g)
        out: dict[int, list[int]] = defaultdict(list)
        for u, v in zip(g["src"].tolist(), g["dst"].tolist()):
            out[u].append(v)
        root, order, seen, pred = -1, [], {-1}, defaultdict(list)
        out[root] = starts
        # postorder without recursion
        stack = [(root, iter(out[root]))]
        while stack:
            u, it = stack[-1]
            for v in it:
                pred[v].append(u)
                if v not in seen:
                    seen.add(v)
                    stack.append((v, iter(out[v])))
                    break
            else:
                order.append(u)
                stack.pop()
        place = {u: i for i, u in enumerate(order)}
        idom = {root: root}
        changed = True
        while changed:
            changed = False
            for u in reversed(order[:-1]):
                new = None
                for p in pred[u]:
                    if p in idom:
                        if new is None:
                            new = p
                        else:
                            a, b = p, new
                            while a != b:
                                while place[a] < place[b]:
                                    a = idom[a]
                                while place[b] < place[a]:
                                    b = idom[b]
                            new = a
                if idom.get(u) != new:
                    idom[u] = new
                    changed = True
        size = {u: 1 for u in order}
        for u in order[:-1]:
            size[idom[u]] += size[u]
        rows = [(int(g["sample"].iloc[0]), u, idom[u], size[u]) for u in order[:-1]]
        return pd.DataFrame(rows, columns=["sample", "node", "idom", "size"])

    return live.groupBy("sample").applyInPandas(one, "sample long, node long, idom long, size long")


def dominator_scores(live: DataFrame, sources: DataFrame, runs: int) -> DataFrame:
    """``node, score``: mean size of what a node dominates over the samples."""
    return dominated(live, sources).join(sources, "node", "left_anti").groupBy("node").agg((F.sum("size") / runs).alias("score"))


def dominator_arcs(live: DataFrame, sources: DataFrame, runs: int) -> DataFrame:
    """``src, dst, score``: the arc from a node's dominator to it carries what the node dominates."""
    return dominated(live, sources).where("idom >= 0").groupBy(F.col("idom").alias("src"), F.col("node").alias("dst")).agg((F.sum("size") / runs).alias("score"))


def _keyed(edges: DataFrame) -> DataFrame:
    return edges if "graph_id" in edges.columns else edges.withColumn("graph_id", F.lit("g"))


def _largest_rest(near: dict[int, set[int]], big: list[int]) -> dict[int, int]:
    """For each node of a component the largest piece that its removal leaves, by one depth-first search."""
    inside, root = set(big), big[0]
    at, low, size, rest, most, up = {root: 0}, {root: 0}, {root: 1}, {root: len(big) - 1}, {root: 0}, {}
    stack = [(root, iter(near[root]))]
    while stack:
        u, others = stack[-1]
        for v in others:
            if v not in inside:
                continue
            if v not in at:
                at[v] = low[v] = len(at)
                size[v], rest[v], most[v], up[v] = 1, len(big) - 1, 0, u
                stack.append((v, iter(near[v])))
                break
            if v != up.get(u):
                low[u] = min(low[u], at[v])
        else:
            stack.pop()
            if stack:
                w = up[u]
                size[w] += size[u]
                low[w] = min(low[w], low[u])
                # nothing below u reaches past w, so u's subtree falls off with w
                if low[u] >= at[w]:
                    rest[w] -= size[u]
                    most[w] = max(most[w], size[u])
    return {v: max(most[v], rest[v]) for v in big}


def articulation_removal(edges: DataFrame, k: int) -> DataFrame:
    """``graph_id, node, rank``: in the largest component remove the node that leaves the smallest biggest piece, again and again.

    Of a single graph with more arcs only those are kept that decide which pieces ``k`` removals leave.
    """
    def one(g: pd.DataFrame) -> pd.DataFrame:
        near, gone, out = _neighbours(_checked(g)), set(), []
        for r in range(min(k, len(near))):
            big = max(_pieces(near, gone), key=lambda p: (len(p), -min(p)), default=[])
            if not big:
                break
            left = _largest_rest(near, big)
            best = min(big, key=lambda v: (left[v], v))
            gone.add(best)
            out.append((g["graph_id"].iloc[0], best, r + 1))
        return pd.DataFrame(out, columns=["graph_id", "node", "rank"])

    if "graph_id" not in edges.columns and edges.count() > MOST:
        edges = written(certificate(written(undirected(edges), "arcs"), k), "certificate")
    return _keyed(edges).groupBy("graph_id").applyInPandas(one, "graph_id string, node long, rank int")


def reinserted(edges: DataFrame, removed: DataFrame, threshold: float) -> DataFrame:
    """``graph_id, node`` still removed after putting back, lowest degree first, those that keep the giant component small."""
    order = [r["node"] for r in removed.orderBy("rank").collect()]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        near = _neighbours(_checked(g))
        gone = set(order) & set(near)
        most = max(threshold * len(near), max(map(len, _pieces(near, gone)), default=0))
        for v in sorted(gone, key=lambda v: (len(near[v]), v)):
            if max(map(len, _pieces(near, gone - {v})), default=0) <= most:
                gone.discard(v)
        return pd.DataFrame({"graph_id": g["graph_id"].iloc[0], "node": sorted(gone)})

    return _keyed(edges).groupBy("graph_id").applyInPandas(one, "graph_id string, node long")


def fiedler_removal(edges: DataFrame, k: int, quantile: float = 0.5, least: int = 8, dense: int = 4000) -> DataFrame:
    """``graph_id, node, rank``: cut the largest component by its second eigenvector, cover the cut edges greedily.

    A graph of up to ``dense`` nodes is cut in one group; larger ones, one by one, in jobs over all their arcs.
    """
    def one(g: pd.DataFrame) -> pd.DataFrame:
        near, gone, out = _neighbours(g), set(), []
        while len(out) < k:
            big = sorted(max(_pieces(near, gone), key=len, default=[]))
            if len(big) <= least:
                break
            x = _second(big, near)
            at = dict(zip(big, x <= np.quantile(x, quantile)))
            cut = {(u, v) for u in big for v in near[u] if v in at and at[u] and not at[v]}
            if not cut:
                break
            while cut and len(out) < k:
                load: dict[int, int] = defaultdict(int)
                for u, v in cut:
                    load[u] += 1
                    load[v] += 1
                best = min(load, key=lambda v: (-load[v], v))
                gone.add(best)
                out.append((g["graph_id"].iloc[0], best, len(out) + 1))
                cut = {e for e in cut if best not in e}
        return pd.DataFrame(out, columns=["graph_id", "node", "rank"])

    keyed, spark = _keyed(edges).select("graph_id", "src", "dst").distinct(), edges.sparkSession
    ends = keyed.select("graph_id", F.col("src").alias("node")).unionByName(keyed.select("graph_id", F.col("dst").alias("node"))).distinct()
    large = [r["graph_id"] for r in ends.groupBy("graph_id").count().where(F.col("count") > dense).orderBy("graph_id").collect()]
    small = keyed.where(~F.col("graph_id").isin(large)) if large else keyed
    out = small.groupBy("graph_id").applyInPandas(one, "graph_id string, node long, rank int")
    for name in large:
        picks = _large_cuts(keyed.where(F.col("graph_id") == name), k, quantile, least, dense)
        out = out.unionByName(spark.createDataFrame([(name, v, i + 1) for i, v in enumerate(picks)], "graph_id string, node long, rank int"))
    return out


def _second(ids: list[int], near: dict[int, set[int]]) -> np.ndarray:
    """Second eigenvector of a component's normalised Laplacian, by its dense matrix."""
    at = {u: i for i, u in enumerate(ids)}
    a = np.zeros((len(ids), len(ids)))
    for u in ids:
        for v in near[u]:
            if v in at:
                a[at[u], at[v]] = 1
    d = 1 / np.sqrt(np.maximum(a.sum(1), 1))
    return np.linalg.eigh(np.eye(len(ids)) - d[:, None] * a * d)[1][:, 1]


def _large_cuts(edges: DataFrame, k: int, quantile: float, least: int, dense: int) -> list[int]:
    """The picks of :func:`fiedler_removal` in one graph; the driver sees one row a pick."""
    def densely(g: pd.DataFrame) -> pd.DataFrame:
        near = _neighbours(g)
        return pd.DataFrame({"node": sorted(near), "x": _second(sorted(near), near)})

    chosen: list[int] = []
    arcs = written(undirected(edges), "arcs")
    while len(chosen) < k:
        parts = written(connected_components(arcs), "parts")
        big = parts.groupBy("component").count().orderBy(F.desc("count"), "component").first()
        if big is None or big["count"] <= least:
            break
        n, members = big["count"], parts.where(F.col("component") == big["component"]).select(F.col("node").alias("src"))
        inner = written(arcs.join(members, "src", "left_semi"), "inner")
        x = written(inner.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(densely, "node long, x double") if n <= dense else second_vector(inner), "second")
        # np.quantile: between the two entries around the place
        place = (n - 1) * quantile
        low, high = int(np.floor(place)), int(np.ceil(place))
        two = {r["place"]: r["x"] for r in numbered(x, [F.asc("x"), F.asc("node")]).where(F.col("place").isin([low, high])).collect()}
        side = written(x.select("node", (F.col("x") <= two[low] + (two[high] - two[low]) * (place - low)).alias("low")), "side")
        at = lambda c: side.select(F.col("node").alias(c), F.col("low").alias(f"low_{c}"))
        cut = written(inner.join(at("src"), "src").where("low_src").join(at("dst"), "dst").where("not low_dst").select("src", "dst"), "cut")
        if cut.isEmpty():
            break
        picked: list[int] = []
        while len(chosen) < k:
            left = cut.where(~F.col("src").isin(picked) & ~F.col("dst").isin(picked)) if picked else cut
            ends = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node")))
            best = ends.groupBy("node").count().orderBy(F.desc("count"), "node").first()
            if best is None:
                break
            picked.append(best["node"])
            chosen.append(best["node"])
        rest = written(arcs.where(~F.col("src").isin(picked) & ~F.col("dst").isin(picked)), "arcs") if len(chosen) < k else arcs
        for used in (parts, inner, x, side, cut):
            drop_table(used)
        arcs = rest
    return chosen


def explosive_immunization(edges: DataFrame, k: int, candidates: int = 200, seed: int = 0) -> DataFrame:
    """``graph_id, node``: start with all removed, bring back whichever of some random nodes joins the smallest clusters; the last ``k`` stay out."""
    def one(g: pd.DataFrame) -> pd.DataFrame:
        near = _neighbours(_checked(g))
        rng, out = np.random.default_rng(seed), sorted(near)
        root = {u: u for u in near}
        size = dict.fromkeys(near, 1)

        def find(u: int) -> int:
            while root[u] != u:
                root[u] = root[root[u]]
                u = root[u]
            return u

        inside: set[int] = set()
        while len(out) > k:
            pick = rng.choice(len(out), min(candidates, len(out)), replace=False)
            best = min((out[i] for i in pick), key=lambda v: (1 + sum(size[r] for r in {find(w) for w in near[v] if w in inside}), v))
            out.remove(best)
            inside.add(best)
            for w in near[best]:
                if w in inside and find(w) != find(best):
                    a, b = find(w), find(best)
                    root[a] = b
                    size[b] += size[a]
        return pd.DataFrame({"graph_id": g["graph_id"].iloc[0], "node": out})

    return _keyed(edges).groupBy("graph_id").applyInPandas(one, "graph_id string, node long")


def belief_decycling(edges: DataFrame, k: int, x: float = 12.0, sweeps: int = 40) -> DataFrame:
    """``graph_id, node, rank``: highest marginal of belonging to a decycling set by message passing, recomputed after each pick.

    A message q0(i, j) is the chance that i is removed, and qr(i, j) that it is a root, without j.
    """
    def one(g: pd.DataFrame) -> pd.DataFrame:
        near, out = {u: set(v) for u, v in _neighbours(_checked(g)).items()}, []
        weight = np.exp(x)
        while len(out) < k:
            low = [u for u in near if len(near[u]) <= 1]
            while low:
                for u in low:
                    for v in near.pop(u, ()):
                        near[v].discard(u)
                low = [u for u in near if len(near[u]) <= 1]
            if not near:
                break
            arcs = [(i, j) for i in near for j in near[i]]
            q0, qr = dict.fromkeys(arcs, 0.5), dict.fromkeys(arcs, 0.25)

            def belief(i: int, skip: int | None) -> tuple[float, float]:
                s = [(q0[(m, i)], qr[(m, i)]) for m in near[i] if m != skip]
                full = np.prod([max(1e-12, a + b) for a, b in s]) if s else 1.0
                one_more = sum((1 - a) / max(1e-12, a + b) for a, b in s)
                z = 1 + weight * full * (1 + one_more)
                return 1 / z, weight * full / z

            for _ in range(sweeps):
                worst = 0.0
                for i, j in arcs:
                    a, b = belief(i, j)
                    worst = max(worst, abs(a - q0[(i, j)]))
                    q0[(i, j)], qr[(i, j)] = a, b
                if worst < 1e-4:
                    break
            best = min(near, key=lambda i: (-belief(i, None)[0], i))
            out.append((g["graph_id"].iloc[0], best, len(out) + 1))
            for v in near.pop(best):
                near[v].discard(best)
        return pd.DataFrame(out, columns=["graph_id", "node", "rank"])

    return _keyed(edges).groupBy("graph_id").applyInPandas(one, "graph_id string, node long, rank int")
