"""Searches from many sources where a task holds all arcs, compressed as they are sent, and takes a share of the sources.

Nothing is laid out by pair of nodes and no level is written: a task keeps a few vectors over the nodes (for hops, rows of
bits) and returns what is asked of each source. A graph whose arcs take more than ``MOST`` bytes goes in tiles instead.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import numbered
from ..shared import written
from . import tiles

SIDE = 8192  # nodes a packed row
MOST = 1 << 28  # bytes of arcs in a task
ROWS = 1 << 25  # bytes of one table of bits over all nodes
WIDTH = 1024  # most sources of such a table
PIECE = 1 << 15  # arcs that are combined at once
SENT = "kind int, at int, a binary, b binary, c binary"


def fits(edges: DataFrame, each: int) -> bool:
    """Whether all arcs of ``each`` bytes fit a task."""
    return edges.count() * each <= MOST


class Arcs:
    """Arcs sorted by one end: where each node's begin, their other ends and weights."""

    def __init__(self, rows: list, n: int, weighted: bool, side: int = SIDE):
        rows = sorted(rows, key=lambda r: r[0])
        counts = np.zeros(n, np.int64)
        far, w = [np.zeros(0, np.int32)], [np.zeros(0)]
        for at, a, b, c in rows:
            k = np.frombuffer(zlib.decompress(b), np.int32)
            counts[at * side : at * side + len(k)] = k
            raw = np.frombuffer(zlib.decompress(a), np.uint8).reshape(4, -1).T
            far.append(np.cumsum(np.ascontiguousarray(raw).view(np.uint32)[:, 0], dtype=np.uint32).view(np.int32))
            if weighted:
                w.append(np.frombuffer(zlib.decompress(c)))
        self.counts, self.begin = counts, np.concatenate([[0], np.cumsum(counts)])
        self.far = np.concatenate(far)
        self.w = np.concatenate(w) if weighted else None
        self.held = np.flatnonzero(counts)

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all arcs of some nodes, and how many each has."""
        k = self.counts[nodes]
        first = np.cumsum(k) - k
        return np.repeat(self.begin[nodes] - first, k) + np.arange(k.sum()), k

    def pieces(self, nodes: np.ndarray | None = None) -> Iterator[tuple]:
        """Nodes with arcs (of ``nodes``), where each one's begin in the piece, and the piece's arcs."""
        h = self.held if nodes is None else nodes[self.counts[nodes] > 0]
        until = np.cumsum(self.counts[h])
        cuts = np.unique(np.concatenate([[0], np.searchsorted(until, np.arange(PIECE, (until[-1] if len(h) else 0) + PIECE, PIECE), "right"), [len(h)]]))
        cuts = cuts[cuts <= len(h)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            p = h[a:b]
            k = self.counts[p]
            at = slice(self.begin[p[0]], self.begin[p[-1] + 1]) if nodes is None else self.of(p)[0]
            yield p, np.cumsum(k) - k, at


def _packed(edges: DataFrame, near: str, far: str, kind: int, weighted: bool, side: int) -> DataFrame:
    """Arcs of ``edges(i, j, w)`` in rows of ``side`` nodes of ``near``, each node's in the order of ``far``."""

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        at = int(g["at"].iloc[0])
        a, b = g[near].to_numpy(np.int64) - at * side, g[far].to_numpy(np.uint32)
        order = np.lexsort((b, a))
        gaps = np.diff(b[order], prepend=np.uint32(0)).astype(np.uint32)
        body = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 4).T).tobytes()
        counts = np.bincount(a).astype(np.int32).tobytes()
        w = zlib.compress(g["w"].to_numpy(float)[order].tobytes(), 1) if weighted else None
        return pd.DataFrame([(kind, at, zlib.compress(body, 1), zlib.compress(counts, 1), w)], columns=["kind", "at", "a", "b", "c"])

    cut = edges.select("i", "j", *(["w"] if weighted else []), F.floor(F.col(near) / side).cast("int").alias("at"))
    return cut.groupBy("at").applyInPandas(pack, SENT)


class Net:
    """What a task knows: ``n`` nodes with their ``ids``, ``v`` (nan: none) and whether they are ``fixed``; arcs ``out`` of and ``into`` them."""

    def __init__(self, rows: dict[int, list], weighted: bool, side: int):
        nodes = sorted(rows.get(2, []), key=lambda r: r[0])
        join = lambda k, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(r[k], t) for r in nodes)])
        self.ids, self.v, self.fixed = join(1, np.int64), join(2, np.float64), join(3, np.int8).astype(bool)
        self.n = len(self.ids)
        self.out = Arcs(rows.pop(0), self.n, weighted, side) if 0 in rows else None
        self.into = Arcs(rows.pop(1), self.n, weighted, side) if 1 in rows else None


def swept(edges: DataFrame, sources: DataFrame, orders: str, run: Callable[[Net, np.ndarray, np.ndarray], Iterator[pd.DataFrame]], schema: str, weighted: bool = False, values: DataFrame | None = None, fixed: DataFrame | None = None, tasks: int | None = None, side: int = SIDE) -> DataFrame:
    """What ``run(net, keys, places)`` yields for the sources of each task; ``orders`` names the arcs it needs, ``out`` or ``into`` or both.

    ``values(node, v)`` and ``fixed(node)`` are told of the nodes; places follow the order of the nodes.
    """
    spark = edges.sparkSession
    named = lambda c: edges.select(F.col(c).alias("node"))
    nodes = named("src").unionByName(named("dst")).unionByName(sources.select("node"))
    nodes = (nodes if fixed is None else nodes.unionByName(fixed.select("node"))).distinct()
    at = written(numbered(nodes, [F.col("node")]), "places")
    starts = written(numbered(sources.select("node").distinct(), [F.col("node")], "q").join(at, "node"), "sources")
    m = starts.count()
    tasks = tasks or max(1, min(m, 4 * spark.sparkContext.defaultParallelism))
    e = edges.select("src", "dst", F.col("w").cast("double").alias("w")) if weighted else edges.select("src", "dst")
    e = e.join(at.select(F.col("node").alias("src"), F.col("place").alias("i")), "src").join(at.select(F.col("node").alias("dst"), F.col("place").alias("j")), "dst")
    e = written(e.drop("src", "dst"), "arcs")
    told = at.join(values.select("node", F.col("v").cast("double").alias("v")), "node", "left") if values is not None else at.withColumn("v", F.lit(None).cast("double"))
    told = told.join(fixed.select("node").distinct().withColumn("f", F.lit(1)), "node", "left") if fixed is not None else told.withColumn("f", F.lit(0))

    def ids(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        body = (g["node"].to_numpy(np.int64).tobytes(), g["v"].to_numpy(float).tobytes(), (g["f"].fillna(0).to_numpy() > 0).astype(np.int8).tobytes())
        return pd.DataFrame([(2, int(g["at"].iloc[0]), *body)], columns=["kind", "at", "a", "b", "c"])

    def keys(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("q")
        return pd.DataFrame([(3, int(g["task"].iloc[0]), g["node"].to_numpy(np.int64).tobytes(), g["place"].to_numpy(np.int32).tobytes(), None)], columns=["kind", "at", "a", "b", "c"])

    common = told.withColumn("at", F.floor(F.col("place") / side).cast("int")).groupBy("at").applyInPandas(ids, SENT)
    for kind, (name, near, far) in enumerate((("out", "i", "j"), ("into", "j", "i"))):
        if name in orders.split():
            common = common.unionByName(_packed(e, near, far, kind, weighted, side))
    common = written(common, "packed").withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    own = written(starts.withColumn("task", (F.col("q") % tasks).cast("int")).groupBy("task").applyInPandas(keys, SENT), "shares").withColumn("task", F.col("at"))
    # a task is a partition of its own, so that tasks are neither joined nor doubled
    sent = common.unionByName(own).repartitionById(tasks, F.col("task")).sortWithinPartitions("kind", "at").drop("task")
    empty = {k: [] for k, name in enumerate(("out", "into")) if name in orders.split()}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, share = {k: list(v) for k, v in empty.items()}, []
        for b in batches:
            for kind, place, x, y, z in zip(b["kind"], b["at"], b["a"], b["b"], b["c"]):
                (share if kind == 3 else rows.setdefault(kind, [])).append((place, x, y, z))
        if share:
            net = Net(rows, weighted, side)
            for _, x, y, _ in share:
                yield from run(net, np.frombuffer(x, np.int64), np.frombuffer(y, np.int32))

    return sent.mapInPandas(work, schema)


# --- hops, as rows of bits


def _levels(net: Net, places: np.ndarray, max_hops: int) -> Iterator[np.ndarray]:
    """Per hop from 0 a row of bits a node: which sources reach it by that many arcs and no fewer."""
    words = -(-len(places) // 64)
    front = np.zeros((net.n, words * 8), np.uint8)
    cols = np.arange(len(places))
    np.bitwise_or.at(front, (places, cols // 8), (1 << (cols % 8)).astype(np.uint8))
    front = front.view(np.uint64)
    seen, full = front.copy(), np.bitwise_or.reduce(front, axis=0)
    for _ in range(max_hops + 1):
        yield front
        open_ = np.flatnonzero((seen != full).any(1))
        new = np.zeros_like(front)
        for h, begin, at in net.into.pieces(open_):
            new[h] = np.bitwise_or.reduceat(front[net.into.far[at]], begin, axis=0) & ~seen[h]
        if not new.any():
            return
        seen |= new
        front = new


def _shares(net: Net, keys: np.ndarray, places: np.ndarray) -> Iterator[tuple]:
    width = max(64, min(WIDTH, ROWS * 8 // max(1, net.n)) // 64 * 64)
    for i in range(0, len(keys), width):
        yield keys[i : i + width], places[i : i + width]


def _counted(rows: np.ndarray, m: int) -> np.ndarray:
    n = np.zeros(m, np.int64)
    for i in range(0, len(rows), 1024):
        n += np.unpackbits(rows[i : i + 1024].view(np.uint8), axis=1, bitorder="little")[:, :m].sum(0, dtype=np.int64)
    return n


def hop_counts(edges: DataFrame, sources: DataFrame, max_hops: int = 1 << 20, within: DataFrame | None = None, **sizes) -> DataFrame:
    """``key, hop, n``: how many nodes (of ``within``) a source reaches at each hop."""
    if not fits(edges, 4):
        return tiles.hop_counts(*tiles.reached(edges, sources, max_hops), within)
    some = None if within is None else within.select("node").distinct().withColumn("v", F.lit(1.0))
    every = within is None

    def run(net, keys, places):
        told = slice(None) if every else np.flatnonzero(~np.isnan(net.v))
        for k, p in _shares(net, keys, places):
            for hop, front in enumerate(_levels(net, p, max_hops)):
                n = _counted(front[told], len(k))
                yield pd.DataFrame({"key": k[n > 0], "hop": np.int32(hop), "n": n[n > 0]})

    return swept(edges, sources, "into", run, "key long, hop int, n long", values=some, **sizes)


def hop_rows(edges: DataFrame, sources: DataFrame, max_hops: int = 1 << 20, **sizes) -> DataFrame:
    """``key, node, hop``: a row for each source and node it reaches."""
    if not fits(edges, 4):
        return tiles.hop_rows(*tiles.reached(edges, sources, max_hops))

    def run(net, keys, places):
        for k, p in _shares(net, keys, places):
            for hop, front in enumerate(_levels(net, p, max_hops)):
                for i in range(0, net.n, 256):
                    a, b = np.nonzero(np.unpackbits(front[i : i + 256].view(np.uint8), axis=1, bitorder="little"))
                    if len(a):
                        yield pd.DataFrame({"key": k[b], "node": net.ids[i + a], "hop": np.int32(hop)})

    return swept(edges, sources, "into", run, "key long, node long, hop int", **sizes)


# --- path counts and breadth-first trees, source by source


def _search(net: Net, s: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hops from a source (-1: unreached), and per hop the tails and heads of all arcs that lead one hop farther.

    A hop looks at the arcs out of the last one's nodes, or at those into nodes not yet reached where these are fewer.
    """
    hop, steps = np.full(net.n, -1, np.int32), []
    hop[s] = 0
    front, left = np.array([s]), net.into.counts.sum() - net.into.counts[s]
    while len(front) and left:
        if net.out.counts[front].sum() <= left:
            at, k = net.out.of(front)
            tail, head = np.repeat(front, k), net.out.far[at]
            on = hop[head] < 0
        else:
            open_ = np.flatnonzero(hop < 0)
            at, k = net.into.of(open_)
            tail, head = net.into.far[at], np.repeat(open_, k)
            on = hop[tail] == len(steps)
        tail, head = tail[on], head[on]
        if not len(head):
            break
        hop[head] = len(steps) + 1
        steps.append((tail, head))
        front = np.flatnonzero(hop == len(steps))
        left -= net.into.counts[front].sum()
    return hop, steps


def dependencies(edges: DataFrame, pivots: DataFrame, **sizes) -> DataFrame:
    """``node, score``: Brandes dependencies of every node summed over ``pivots``."""
    if not fits(edges, 8):
        return tiles.dependencies(edges, pivots)

    def run(net, keys, places):
        total = np.zeros(net.n)
        for s in places.tolist():
            _, steps = _search(net, s)
            paths, share = np.zeros(net.n), np.zeros(net.n)
            paths[s] = 1
            for tail, head in steps:
                paths += np.bincount(head, paths[tail], net.n)
            np.divide(1, paths, out=share, where=paths > 0)
            for tail, head in reversed(steps):
                dep = paths * np.bincount(tail, share[head], net.n)
                dep[s] = 0
                total += dep
                np.add(share, np.divide(dep, paths, out=np.zeros(net.n), where=paths > 0), out=share)
        on = np.flatnonzero(total)
        for i in range(0, len(on), SIDE):
            yield pd.DataFrame({"node": net.ids[on[i : i + SIDE]], "score": total[on[i : i + SIDE]]})

    return swept(edges, pivots, "out into", run, "node long, score double", **sizes).groupBy("node").agg(F.sum("score").alias("score"))


def tree_logs(edges: DataFrame, sources: DataFrame, **sizes) -> DataFrame:
    """``key, n, logs`` as :func:`tiles.tree_logs`: a node's parent is the smallest one a hop nearer."""
    if not fits(edges, 8):
        return tiles.tree_logs(edges, sources)

    def run(net, keys, places):
        out = []
        for s in places.tolist():
            hop, steps = _search(net, s)
            size = np.ones(net.n)
            for tail, head in reversed(steps):
                parent = np.full(net.n, net.n, np.int64)
                np.minimum.at(parent, head, tail)
                child = np.flatnonzero(parent < net.n)
                size += np.bincount(parent[child], size[child], net.n)
            reached = size[hop >= 0]
            out.append((len(reached), np.log(reached).sum()))
        yield pd.DataFrame({"key": keys, "n": [x for x, _ in out], "logs": [x for _, x in out]})

    return swept(edges, sources, "out into", run, "key long, n long, logs double", **sizes)


# --- costs, products and probabilities, source by source


def _measured(edges: DataFrame, sources: DataFrame, search: Callable, nodes: DataFrame, measure: Callable, names: str, fixed: DataFrame | None = None, **sizes) -> DataFrame:
    """``key`` and what ``measure(values, v)`` gives of the column that ``search(net, place)`` returns, at the nodes of ``nodes(node, v)``."""
    cols = names.split()

    def run(net, keys, places):
        told = np.flatnonzero(~np.isnan(net.v))
        if len(told):
            v = net.v[told][:, None]
            got = [[float(x[0]) for x in measure(search(net, s)[told][:, None], v)] for s in places.tolist()]
            yield pd.DataFrame({"key": keys, **dict(zip(cols, np.array(got).T))})

    return swept(edges, sources, "out", run, "key long, " + ", ".join(f"{c} double" for c in cols), weighted=True, values=nodes, fixed=fixed, **sizes)


def least_costs(edges: DataFrame, sources: DataFrame, max_rounds: int, nodes: DataFrame, measure: Callable, names: str, **sizes) -> DataFrame:
    """``key`` and measures of the least sum of ``w`` from each source (infinite: unreached), as :func:`tiles.least_costs` and :func:`tiles.column_sums`.

    Weights are not negative. Only the search in tiles has rounds, which may not suffice.
    """
    if not fits(edges, 12):
        return tiles.column_sums(*tiles.least_costs(edges, sources, max_rounds), nodes, measure, names)

    def search(net: Net, s: int) -> np.ndarray:
        cost, open_, least = np.full(net.n, np.inf), np.zeros(net.n, bool), net.out.w.min(initial=np.inf)
        cost[s], open_[s] = 0, True
        while len(wait := np.flatnonzero(open_)):
            # what lies less than the cheapest arc above the lowest open cost falls no more, so an arc is mostly looked at once
            front = wait[cost[wait] <= cost[wait].min() + least]
            open_[front] = False
            at, k = net.out.of(front)
            head, sums = net.out.far[at], np.repeat(cost[front], k) + net.out.w[at]
            on = sums < cost[head]
            np.minimum.at(cost, head[on], sums[on])
            open_[head[on]] = True
        return cost

    return _measured(edges, sources, search, nodes, measure, names, **sizes)


def best_products(edges: DataFrame, sources: DataFrame, max_hops: int, nodes: DataFrame, measure: Callable, names: str, **sizes) -> DataFrame:
    """``key`` and measures of the greatest product of ``w`` over walks of up to ``max_hops`` arcs, as :func:`tiles.best_products`."""
    if not fits(edges, 12):
        return tiles.column_sums(*tiles.best_products(edges, sources, max_hops), nodes, measure, names)

    def search(net: Net, s: int) -> np.ndarray:
        best, front = np.zeros(net.n), np.zeros(net.n)
        front[s] = 1
        for _ in range(max_hops):
            on = np.flatnonzero(front)
            at, k = net.out.of(on)
            new = np.zeros(net.n)
            np.maximum.at(new, net.out.far[at], np.repeat(front[on], k) * net.out.w[at])
            new[s] = 0
            np.maximum(best, new, out=best)
            front = new
        best[s] = np.inf
        return best

    return _measured(edges, sources, search, nodes, measure, names, **sizes)


def mean_fields(edges: DataFrame, sources: DataFrame, steps: int, nodes: DataFrame, measure: Callable, names: str, first: float = 1.0, fixed: DataFrame | None = None, least: float = 0.0, **sizes) -> DataFrame:
    """``key`` and measures of each node's mean-field probability after ``steps``, as :func:`tiles.mean_fields`."""
    if not fits(edges, 12):
        return tiles.column_sums(*tiles.mean_fields(edges, sources, steps, first, fixed, least), nodes, measure, names)

    def search(net: Net, s: int) -> np.ndarray:
        x = np.zeros(net.n)
        x[s] = first
        x[net.fixed] = 1
        p = x.copy()
        for _ in range(steps):
            on = np.flatnonzero(x > least)
            at, k = net.out.of(on)
            # a certain arc gives log 0, so that the product is exactly 1
            with np.errstate(divide="ignore"):
                logs = np.bincount(net.out.far[at], np.log1p(-np.minimum(1, np.repeat(x[on], k) * net.out.w[at])), net.n)
            x = (1 - p) * -np.expm1(logs)
            p += x
        return p

    return _measured(edges, sources, search, nodes, measure, names, fixed, **sizes)


# --- spanning forests


def search_forests(net: Net, count: int) -> np.ndarray:
    """Arcs (tail, head) of ``count`` forests, each a breadth-first search of what the earlier ones leave of a symmetric graph."""
    a, n = net.into, net.n
    key = np.repeat(np.arange(n), a.counts) * n + a.far
    alive, out = np.ones(len(key), bool), []
    for _ in range(count):
        seen, made = np.zeros(n, bool), []
        for root in a.held.tolist():
            if seen[root]:
                continue
            seen[root] = True
            front = np.array([root])
            while len(front):
                # nodes of a hop are looked at in the order of their places, and each takes all that are not reached by then
                at, k = a.of(front)
                on = alive[at] & ~seen[a.far[at]]
                front, first = np.unique(a.far[at][on], return_index=True)
                if len(front):
                    made.append(np.column_stack([a.far[at][on][first], key[at][on][first] // n]).astype(np.int64))
                    seen[front] = True
        if not made:
            break
        tree = np.concatenate(made)
        out.append(tree)
        for x, y in ((0, 1), (1, 0)):
            alive[np.searchsorted(key, tree[:, x] * n + tree[:, y])] = False
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def certificate(edges: DataFrame, k: int, **sizes) -> DataFrame:
    """``src, dst``: at most ``k`` + 1 arcs a node of the symmetric ``edges``, such that any ``k`` removals of nodes leave the same components.

    These are scan-first forests, each of what the earlier ones leave (Cheriyan, Kao and Thurimella). One task holds all arcs.
    """
    if not fits(edges, 4):
        raise ValueError("the arcs of the graph do not fit a task")

    def run(net, keys, places):
        arcs = net.ids[search_forests(net, k + 1)]
        yield pd.DataFrame({"src": arcs[:, 0], "dst": arcs[:, 1]})

    return swept(edges, edges.agg(F.min("src").alias("node")), "into", run, "src long, dst long", **sizes)


# --- spectral radii


def radius_falls(edges: DataFrame, nodes: DataFrame, rounds: int = 60, **sizes) -> DataFrame:
    """``node, score``: fall of the leading eigenvalue of the symmetric ``edges`` when the node goes, for every one of ``nodes``.

    Rounds are those of :func:`structure.spectral_radius`. All arcs are in one task, which must hold them.
    """

    def radius(net: Net, gone: int | None) -> float:
        x, top, a = np.ones(net.n), 0.0, net.into
        if gone is not None:
            x[gone] = 0
        for _ in range(rounds):
            new = x.copy()
            for h, begin, at in a.pieces():
                new[h] += np.add.reduceat(x[a.far[at]], begin)
            if gone is not None:
                new[gone] = 0
            size = new.max(initial=0.0) or 1.0
            x, old, top = new / size, top, size - 1
            if abs(top - old) < 1e-9:
                break
        return float(top)

    def run(net, keys, places):
        whole = radius(net, None)
        yield pd.DataFrame({"node": keys, "score": [whole - radius(net, s) for s in places.tolist()]})

    return swept(edges, nodes, "into", run, "node long, score double", **sizes)
