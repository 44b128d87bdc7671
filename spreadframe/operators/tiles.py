"""Searches from many sources at once as products of tiles: nodes in buckets, sources in blocks, arcs between two buckets.

A tile holds what a block of sources knows of a bucket of nodes, a row a node, as bytes; arcs lie in chunks sorted
by their head. Spark deals a block's tiles and the arcs into a bucket to one task, which combines them with numpy.
A block is the narrower the more nodes there are, so what a task holds stays bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import numbered
from ..shared import drop_table, written

SIDE = 8192  # nodes a bucket
CHUNK = 16384  # arcs a row
HELD = 1 << 26  # bytes of one block over all nodes
WIDTH, SPLIT = 1024, 16  # most sources of a block whose trees are summed, and blocks at least if there are sources enough


@dataclass(frozen=True)
class Tiled:
    """Arcs and sources dealt to tiles.

    ``arcs(sb, db, src, dst, w)`` hold local places as int32 bytes and weights as doubles, ``ids(bucket, ids)`` the nodes
    of a bucket, ``keys(block, keys)`` the sources of a block, ``starts(block, bucket, at)`` pairs of local place and column.
    """

    arcs: DataFrame
    back: DataFrame | None
    ids: DataFrame
    keys: DataFrame
    starts: DataFrame
    buckets: int
    blocks: int
    width: int
    side: int


def _chunks(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values(["dst", "src"])
    rows = [(g["sb"].iloc[0], g["db"].iloc[0], *(g[c].to_numpy(t)[i : i + CHUNK].tobytes() for c, t in (("src", np.int32), ("dst", np.int32), ("w", np.float64)))) for i in range(0, len(g), CHUNK)]
    return pd.DataFrame(rows, columns=["sb", "db", "src", "dst", "w"])


def _dealt(arcs: DataFrame, side: int) -> DataFrame:
    place = lambda c: F.floor(F.col(c) / side).cast("int")
    local = lambda c: (F.col(c) % side).cast("int").alias(c)
    cut = arcs.select(place("src").alias("sb"), place("dst").alias("db"), local("src"), local("dst"), "w")
    return written(cut.groupBy("sb", "db").applyInPandas(_chunks, "sb int, db int, src binary, dst binary, w binary"), "arc_tiles")


def tiled(edges: DataFrame, sources: DataFrame, bits: int, back: bool = False, fixed: DataFrame | None = None, side: int | None = None, width: int | None = None) -> Tiled:
    """Tiles for ``edges(src, dst[, w])`` and ``sources(node)``; ``bits`` is the size of one entry, ``back`` adds reversed arcs.

    Places follow the order of the nodes. Tiles of doubles are 2 MB, of bits 1 MB at most. Nodes in ``fixed`` start with every source (column -1).
    """
    side = side or (SIDE if bits == 1 else SIDE // 2)
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).unionByName(sources.select("node")).distinct()
    nodes = nodes if fixed is None else nodes.unionByName(fixed.select("node")).distinct()
    at = written(numbered(nodes, [F.col("node")]), "places")
    n = at.count()
    named = written(numbered(sources.select("node").distinct(), [F.col("node")], "q").join(at, "node"), "sources")
    m = named.count()
    # a multiple of 64 columns, so that rows of bits are whole words
    width = width or max(64, min(HELD * 8 // (bits * max(1, n)), 1024 if bits == 1 else 64, m + 63) // 64 * 64)
    e = edges.withColumn("w", F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0))
    e = e.join(at.select(F.col("node").alias("src"), F.col("place").alias("i")), "src").join(at.select(F.col("node").alias("dst"), F.col("place").alias("j")), "dst")
    e = written(e.select(F.col("i").alias("src"), F.col("j").alias("dst"), "w"), "arcs")
    ids = lambda by, name: lambda g: pd.DataFrame({by: g[by].iloc[:1], name: [g.sort_values("o")["node"].to_numpy(np.int64).tobytes()]})
    bucket, block = F.floor(F.col("place") / side).cast("int").alias("bucket"), F.floor(F.col("q") / width).cast("int").alias("block")
    of = at.select(bucket, F.col("place").alias("o"), "node").groupBy("bucket").applyInPandas(ids("bucket", "ids"), "bucket int, ids binary")
    keys = named.select(block, F.col("q").alias("o"), "node").groupBy("block").applyInPandas(ids("block", "keys"), "block int, keys binary")
    cell = lambda c: F.struct((F.col("place") % side).cast("int").alias("p"), c.cast("int").alias("c")).alias("cell")
    starts = named.select(block, bucket, cell(F.col("q") % width))
    if fixed is not None:
        all_blocks = F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-m // width) - 1)))).alias("block")
        starts = starts.unionByName(at.join(fixed.select("node").distinct(), "node", "left_semi").select(all_blocks, bucket, cell(F.lit(-1))))
    starts = starts.groupBy("block", "bucket").agg(F.collect_list("cell").alias("at"))
    turned = _dealt(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), side) if back else None
    return Tiled(_dealt(e, side), turned, written(of, "bucket_ids"), written(keys, "block_keys"), starts, -(-n // side), -(-m // width), width, side)


def first_tiles(t: Tiled, make: Callable[[np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """``block, bucket, front, seen`` from ``make(rows, columns)`` of a tile's sources."""
    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                front, seen = make(np.array([x["p"] for x in r.at]), np.array([x["c"] for x in r.at]))
                yield pd.DataFrame([(r.block, r.bucket, front, seen)], columns=["block", "bucket", "front", "seen"])

    return t.starts.mapInPandas(build, "block int, bucket int, front binary, seen binary")


def pushed(t: Tiled, tiles: DataFrame, combine: Callable, arcs: DataFrame | None = None, schema: str = "block int, bucket int, front binary, seen binary") -> DataFrame:
    """Tiles after one step along all arcs.

    ``combine(fronts, arcs, seen)`` gets the tiles of a block by bucket, the arcs into one bucket as ``sb, src, dst, w`` and
    that bucket's own ``seen``; it returns the columns after block and bucket, or None for nothing.
    """
    wide = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = tiles.select("block", "bucket", "front", "seen").withColumn("db", wide(t.buckets))
    left = left.select("block", "db", F.col("bucket").alias("sb"), "front", F.when(F.col("db") == F.col("bucket"), F.col("seen")).alias("seen")).where("front is not null or seen is not null")
    right = (t.arcs if arcs is None else arcs).withColumn("block", wide(t.blocks))
    names = [c.split()[0] for c in schema.split(",")]

    def step(key, l, r):
        fronts = {sb: f for sb, f in zip(l["sb"], l["front"]) if f is not None}
        seen = next((s for s in l["seen"] if s is not None), None)
        into = [(sb, np.frombuffer(s, np.int32), np.frombuffer(d, np.int32), np.frombuffer(w, np.float64)) for sb, s, d, w in zip(r["sb"], r["src"], r["dst"], r["w"]) if sb in fronts]
        got = combine(fronts, into, seen)
        return pd.DataFrame([] if got is None else [(*(int(k) for k in key), *got)], columns=names)

    return left.groupBy("block", "db").cogroup(right.groupBy("block", "db")).applyInPandas(step, schema)


def runs(dst: np.ndarray) -> np.ndarray:
    """Where each head's arcs begin."""
    return np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])


# --- reached sets


def reached(edges: DataFrame, sources: DataFrame, max_hops: int = 1 << 20, **sizes) -> tuple[Tiled, list[DataFrame]]:
    """Per hop from 0 the tiles whose ``front`` has a bit for each source that reaches a node by that many arcs and no fewer."""
    t = tiled(edges, sources, 1, **sizes)
    side, width, words = t.side, t.width, t.width // 64

    def start(rows, cols):
        f = np.zeros((side, width // 8), np.uint8)
        np.bitwise_or.at(f, (rows, cols // 8), (1 << (cols % 8)).astype(np.uint8))
        return f.tobytes(), f.tobytes()

    def combine(fronts, into, seen):
        old = np.zeros((side, words), np.uint64) if seen is None else np.frombuffer(seen, np.uint64).reshape(side, words)
        out = np.zeros((side, words), np.uint64)
        for sb, s, d, _ in into:
            at = runs(d)
            out[d[at]] |= np.bitwise_or.reduceat(np.frombuffer(fronts[sb], np.uint64).reshape(side, words)[s], at)
        new = out & ~old
        if not new.any():
            return None if seen is None else (None, seen)
        return new.tobytes(), (old | new).tobytes()

    now = written(first_tiles(t, start), "reached")
    # of a level only its fronts are kept: what was seen is needed for one step and would be a whole square again a level
    levels = [written(now.select("block", "bucket", "front"), "fronts")]
    while len(levels) <= max_hops:
        # sets that a tile has seen stay where no arc leads, so those rows need no step
        new = written(pushed(t, now, combine), "reached")
        drop_table(now)
        now = new
        front = written(now.where("front is not null").select("block", "bucket", "front"), "fronts")
        if front.isEmpty():
            break
        levels.append(front)
    drop_table(now)
    return t, levels


def _leveled(t: Tiled, levels: list[DataFrame]) -> DataFrame:
    out = None
    for h, level in enumerate(levels):
        part = level.where("front is not null").select("block", "bucket", "front", F.lit(h).alias("hop"))
        out = part if out is None else out.unionByName(part)
    return out.join(t.ids, "bucket").join(t.keys, "block")


def _bits(r, width: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, keys = np.frombuffer(r.ids, np.int64), np.frombuffer(r.keys, np.int64)
    return ids, keys, np.frombuffer(r.front, np.uint8).reshape(side, width // 8)[: len(ids)]


def hop_rows(t: Tiled, levels: list[DataFrame]) -> DataFrame:
    """``key, node, hop``: a row for each source and node it reaches."""
    width, side = t.width, t.side

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                ids, keys, f = _bits(r, width, side)
                for i in range(0, len(ids), 256):
                    a, b = np.nonzero(np.unpackbits(f[i : i + 256], axis=1, bitorder="little"))
                    if len(a):
                        yield pd.DataFrame({"key": keys[b], "node": ids[i + a], "hop": np.int32(r.hop)})

    return _leveled(t, levels).mapInPandas(rows, "key long, node long, hop int")


def hop_counts(t: Tiled, levels: list[DataFrame], within: DataFrame | None = None) -> DataFrame:
    """``key, hop, n``: how many nodes (of ``within``) a source reaches at each hop, without a row a pair."""
    tiles, width, side = _leveled(t, levels), t.width, t.side
    if within is not None:
        kept = t.ids.mapInPandas(lambda parts: (pd.DataFrame({"bucket": np.int32(r.bucket), "place": np.arange(len(r.ids) // 8, dtype=np.int32), "node": np.frombuffer(r.ids, np.int64)}) for p in parts for r in p.itertuples()), "bucket int, place int, node long").join(within.select("node").distinct(), "node", "left_semi")
        tiles = tiles.join(kept.groupBy("bucket").agg(F.collect_list("place").alias("kept")), "bucket")
    else:
        tiles = tiles.withColumn("kept", F.lit(None).cast("array<int>"))

    def counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                ids, keys, f = _bits(r, width, side)
                if r.kept is not None:
                    f = f[np.asarray(r.kept, int)]
                n = np.zeros(len(keys), np.int64)
                for i in range(0, len(f), 1024):
                    n += np.unpackbits(f[i : i + 1024], axis=1, bitorder="little")[:, : len(keys)].sum(0, dtype=np.int64)
                on = n > 0
                yield pd.DataFrame({"key": keys[on], "hop": np.int32(r.hop), "n": n[on]})

    return tiles.mapInPandas(counts, "key long, hop int, n long").groupBy("key", "hop").agg(F.sum("n").alias("n"))


# --- path counts


def _sums(fronts: dict, into: list, side: int, width: int, wanted: np.ndarray, value: Callable) -> np.ndarray:
    """Sums over arcs of ``value(rows of the tail's tile, weights)``; arcs whose head is not wanted are left out."""
    out = np.zeros((side, width))
    tiles = {sb: np.frombuffer(f).reshape(side, width) for sb, f in fronts.items()}
    alive = {sb: x.any(1) for sb, x in tiles.items()}
    for sb, s, d, w in into:
        on = alive[sb][s] & wanted[d]
        s, d, w = s[on], d[on], w[on]
        at = np.append(runs(d), len(d)) if len(d) else [0]
        for a, b in zip(at[:-1], at[1:]):
            out[d[a]] += value(tiles[sb][s[a:b]], w[a:b, None]).sum(0)
    return out


def dependencies(edges: DataFrame, pivots: DataFrame, **sizes) -> DataFrame:
    """``node, score``: Brandes dependencies of every node summed over ``pivots``: path counts forward, dependencies back."""
    t = tiled(edges, pivots, 64, back=True, **sizes)
    side, width = t.side, t.width

    def start(rows, cols):
        f = np.zeros((side, width))
        f[rows, cols] = 1
        return f.tobytes(), np.packbits(f > 0).tobytes()

    def forward(fronts, into, seen):
        old = np.zeros((side, width), bool) if seen is None else np.unpackbits(np.frombuffer(seen, np.uint8)).reshape(side, width).astype(bool)
        new = np.where(old, 0, _sums(fronts, into, side, width, ~old.all(1), lambda x, w: x))
        if not new.any():
            return None if seen is None else (None, seen)
        return new.tobytes(), np.packbits(old | (new > 0)).tobytes()

    levels = [written(first_tiles(t, start), "paths")]
    while True:
        new = written(pushed(t, levels[-1], forward), "paths")
        if new.where("front is not null").isEmpty():
            break
        levels.append(new)

    def backward(fronts, into, own):
        if own is None:
            return None
        paths = np.frombuffer(own).reshape(side, width)
        dep = paths * _sums(fronts, into, side, width, paths.any(1), lambda x, w: x)
        share = np.divide(1 + dep, paths, out=np.zeros((side, width)), where=paths > 0)
        return share.tobytes(), dep.sum(1).tobytes()

    schema = "block int, bucket int, front binary, dep binary"
    below, total = None, None
    for level in reversed(levels[1:]):
        own = level.where("front is not null").select("block", "bucket", F.col("front").alias("seen"))
        if below is None:
            both = own.withColumn("front", F.lit(None).cast("binary"))
        else:
            both = own.join(below.select("block", "bucket", "front"), ["block", "bucket"], "full_outer")
        below = written(pushed(t, both, backward, t.back, schema), "shares")
        total = below.select("bucket", "dep") if total is None else total.unionByName(below.select("bucket", "dep"))
    if total is None:
        return edges.sparkSession.createDataFrame([], "node long, score double")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                yield pd.DataFrame({"node": ids, "dep": np.frombuffer(r.dep)[: len(ids)]})

    return total.join(t.ids, "bucket").mapInPandas(rows, "node long, dep double").groupBy("node").agg(F.sum("dep").alias("score"))


# --- costs, probabilities


def _reduced(fronts: dict, into: list, side: int, width: int, of: np.ufunc, empty: float, value: Callable) -> np.ndarray:
    """Per head the least or greatest, by ``of``, of ``value(rows of the tail's tile, weights)``."""
    out = np.full((side, width), empty)
    for sb, s, d, w in into:
        x = np.frombuffer(fronts[sb]).reshape(side, width)
        live = (x != empty).any(1)[s]
        s, d, w = s[live], d[live], w[live]
        at = np.append(runs(d), len(d)) if len(d) else [0]
        for a, b in zip(at[:-1], at[1:]):
            out[d[a]] = of(out[d[a]], of.reduce(value(x[s[a:b]], w[a:b, None]), axis=0))
    return out


def column_sums(t: Tiled, tiles: DataFrame, nodes: DataFrame, measure: Callable, names: str) -> DataFrame:
    """``key`` and sums by source: ``measure(rows of a tile, v)`` gives an array a column of ``names``, ``v`` the rows' value in ``nodes(node, v)``.

    Nodes that are not in ``nodes`` are left out; the result has a row for each source and bucket.
    """
    side, width = t.side, t.width
    cols = names.split()
    unpacked = t.ids.mapInPandas(lambda parts: (pd.DataFrame({"bucket": np.int32(r.bucket), "place": np.arange(len(r.ids) // 8, dtype=np.int32), "node": np.frombuffer(r.ids, np.int64)}) for p in parts for r in p.itertuples()), "bucket int, place int, node long")
    at = unpacked.join(nodes.select("node", F.col("v").cast("double").alias("v")), "node").groupBy("bucket").agg(F.collect_list(F.struct("place", "v")).alias("at"))

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                keys = np.frombuffer(r.keys, np.int64)
                rows, v = np.array([x["place"] for x in r.at]), np.array([x["v"] for x in r.at])
                got = measure(np.frombuffer(r.seen).reshape(side, width)[rows][:, : len(keys)], v[:, None])
                yield pd.DataFrame({"key": keys, **dict(zip(cols, got))})

    return tiles.where("seen is not null").join(at, "bucket").join(t.keys, "block").mapInPandas(sums, "key long, " + ", ".join(f"{c} double" for c in cols))


def least_costs(edges: DataFrame, sources: DataFrame, max_rounds: int, **sizes) -> tuple[Tiled, DataFrame]:
    """Tiles whose ``seen`` holds the least sum of ``w`` from each source to each node, infinite if unreached; unsettled costs are an error."""
    t = tiled(edges, sources, 64, **sizes)
    side, width = t.side, t.width

    def start(rows, cols):
        f = np.full((side, width), np.inf)
        f[rows, cols] = 0
        return f.tobytes(), f.tobytes()

    def combine(fronts, into, seen):
        old = np.full((side, width), np.inf) if seen is None else np.frombuffer(seen).reshape(side, width)
        new = _reduced(fronts, into, side, width, np.minimum, np.inf, lambda x, w: x + w)
        better = new < old
        if not better.any():
            return None if seen is None else (None, seen)
        return np.where(better, new, np.inf).tobytes(), np.where(better, new, old).tobytes()

    now = written(first_tiles(t, start), "costs")
    for _ in range(max_rounds):
        new = written(pushed(t, now, combine), "costs")
        drop_table(now)
        now = new
        if now.where("front is not null").isEmpty():
            return t, now
    raise RuntimeError(f"costs did not settle in {max_rounds} rounds")


def best_products(edges: DataFrame, sources: DataFrame, max_hops: int, **sizes) -> tuple[Tiled, DataFrame]:
    """Tiles whose ``seen`` holds the greatest product of ``w`` over walks of up to ``max_hops`` arcs that do not meet their source again; infinite at the source."""
    t = tiled(edges, sources, 64, **sizes)
    side, width = t.side, t.width

    def start(rows, cols):
        f, own = np.zeros((side, width)), np.zeros((side, width))
        f[rows, cols], own[rows, cols] = 1, np.inf
        return f.tobytes(), own.tobytes()

    def combine(fronts, into, seen):
        old = np.zeros((side, width)) if seen is None else np.frombuffer(seen).reshape(side, width)
        new = np.where(np.isinf(old), 0, _reduced(fronts, into, side, width, np.maximum, 0.0, lambda x, w: x * w))
        if not new.any():
            return None if seen is None else (None, seen)
        return new.tobytes(), np.maximum(old, new).tobytes()

    now = written(first_tiles(t, start), "products")
    for _ in range(max_hops):
        new = written(pushed(t, now, combine), "products")
        drop_table(now)
        now = new
    return t, now


def mean_fields(edges: DataFrame, sources: DataFrame, steps: int, first: float = 1.0, fixed: DataFrame | None = None, least: float = 0.0, **sizes) -> tuple[Tiled, DataFrame]:
    """Tiles whose ``seen`` holds the mean-field probability of each node after ``steps`` when a source starts at ``first`` and ``fixed`` nodes at 1."""
    t = tiled(edges, sources, 64, fixed=fixed, **sizes)
    side, width = t.side, t.width

    def start(rows, cols):
        f = np.zeros((side, width))
        f[rows[cols >= 0], cols[cols >= 0]] = first
        f[rows[cols < 0]] = 1
        return f.tobytes(), f.tobytes()

    def combine(fronts, into, seen):
        old = np.zeros((side, width)) if seen is None else np.frombuffer(seen).reshape(side, width)
        # a certain arc gives log 0, so that the product is exactly 1
        with np.errstate(divide="ignore"):
            logs = _sums(fronts, into, side, width, np.ones(side, bool), lambda x, w: np.log1p(-np.minimum(1, np.where(x > least, x, 0) * w)))
        x = (1 - old) * -np.expm1(logs)
        if not x.any():
            return None if seen is None else (None, seen)
        return x.tobytes(), (old + x).tobytes()

    now = written(first_tiles(t, start), "fields")
    for _ in range(steps):
        new = written(pushed(t, now, combine), "fields")
        drop_table(now)
        now = new
    return t, now


# --- breadth-first trees


def tree_logs(edges: DataFrame, sources: DataFrame, **sizes) -> DataFrame:
    """``key, n, logs``: nodes that a source reaches, and the sum of the logs of all subtree sizes in its breadth-first tree.

    A node's parent is the smallest one a hop nearer. From the farthest hop up, the sizes below each parent are summed in the
    children's bucket and sent to its own; nodes without children have no row.
    """
    share = -(-sources.select("node").distinct().count() // SPLIT)
    t, levels = reached(edges, sources, **{"width": min(WIDTH, max(1, -(-share // 64)) * 64), **sizes})
    side, width, words = t.side, t.width, t.width // 64
    wide = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = t.arcs.select("sb", "db", "src", "dst").withColumn("block", wide(t.blocks))
    none = F.lit(None).cast("binary")

    def step(key, l, r):
        above = {sb: np.frombuffer(f, np.uint64).reshape(side, words) for sb, f in zip(l["sb"], l["above"]) if f is not None}
        front = next((f for f in l["front"] if f is not None), None)
        size = np.ones(side * width, np.int64)
        for at, more in zip(l["at"], l["more"]):
            if at is not None:
                size[np.frombuffer(at, np.int32)] += np.frombuffer(more, np.int64)
        grown, rows = size.reshape(side, width), []
        logs = np.zeros(width)
        for i in range(0, side, 256):
            part = grown[i : i + 256]
            if part.max() > 1:
                logs += np.log(part).sum(0)
        roots = grown.max(0) if not above else np.zeros(width, np.int64)
        rows.append((int(key[0]), -1, logs.tobytes(), roots.tobytes()))
        left = None if front is None else np.frombuffer(front, np.uint64).reshape(side, words).copy()
        # a head's arcs may go on in the next chunk
        chunks = sorted(((sb, np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)) for sb, a, b in zip(r["sb"], r["src"], r["dst"])), key=lambda x: (x[0], x[2][0], x[1][0]))
        for sb in sorted(above) if left is not None else []:
            below = np.zeros(side * width, np.int64)
            for s, d in ((s, d) for x, s, d in chunks if x == sb):
                # arcs of a head lie in the order of their tails: the first tail whose bit is set takes it
                begin = runs(d)
                count = np.diff(np.append(begin, len(d)))
                live = np.flatnonzero(left[d[begin]].any(1))
                turn = 0
                while len(live := live[count[live] > turn]):
                    head, tail = d[begin[live]], s[begin[live] + turn]
                    hit = left[head] & above[sb][tail]
                    on = hit.any(1)
                    left[head] &= ~hit
                    a, c = np.nonzero(np.unpackbits(hit[on].view(np.uint8), axis=1, bitorder="little"))
                    np.add.at(below, tail[on][a].astype(np.int64) * width + c, grown[head[on][a], c])
                    live = live[left[head].any(1)]
                    turn += 1
            at = np.flatnonzero(below)
            if len(at):
                rows.append((int(key[0]), int(sb), at.astype(np.int32).tobytes(), below[at].tobytes()))
        return pd.DataFrame(rows, columns=["block", "bucket", "at", "more"])

    schema, sums, given = "block int, bucket int, at binary, more binary", [], None
    for h in range(len(levels) - 1, -1, -1):
        rows = [levels[h].where("front is not null").select("block", F.col("bucket").alias("db"), F.lit(-1).alias("sb"), none.alias("above"), "front", none.alias("at"), none.alias("more"))]
        if h:
            rows.append(levels[h - 1].where("front is not null").select("block", wide(t.buckets).alias("db"), F.col("bucket").alias("sb"), F.col("front").alias("above"), none.alias("front"), none.alias("at"), none.alias("more")))
        if given is not None:
            rows.append(given.where("bucket >= 0").select("block", F.col("bucket").alias("db"), F.lit(-1).alias("sb"), none.alias("above"), none.alias("front"), "at", "more"))
        left = reduce(DataFrame.unionByName, rows)
        given = written(left.groupBy("block", "db").cogroup((right if h else right.where("false")).groupBy("block", "db")).applyInPandas(step, schema), "trees")
        sums.append(given.where("bucket < 0").select("block", "at", "more"))

    def by_key(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                keys = np.frombuffer(r.keys, np.int64)
                yield pd.DataFrame({"key": keys, "n": np.frombuffer(r.more, np.int64)[: len(keys)], "logs": np.frombuffer(r.at)[: len(keys)]})

    all_sums = reduce(DataFrame.unionByName, sums)
    return all_sums.join(t.keys, "block").mapInPandas(by_key, "key long, n long, logs double").groupBy("key").agg(F.max("n").alias("n"), F.sum("logs").alias("logs"))
