"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are turned so that their leading dimensions hold most of the variance (principal
axes of the commonest length; vectors of other lengths keep their own order, which is as
exact). Tiles are cells of the first ``GRID`` turned dimensions, as wide as the longest
distance that the threshold allows, so a vector meets its own tile and the neighbours it
is close enough to. Tiles are compared in blocks of bounded size: products of leading
dimensions are accumulated first, the rest is bounded by the product of the suffix norms,
and pairs that can no longer reach the threshold stop there. Equal vectors are one from
the start. A vector is dealt a few times (its tile's blocks, and the neighbours within
reach), so what is moved grows with the rows until a tile outgrows ``BLOCK``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..shared import written
from .vectors import packed, scaled, stacked, unit

#: Turned dimensions that place a vector's tile; unit vectors fill at most (2 / width + 2) ** GRID tiles.
GRID = 2
#: Vectors in a block, about; a task compares two blocks, in parts of PART by PART.
BLOCK = 16_384
PART = 2048
STEPS = (8, 20)
BASE = 1 << 10


def principal_axes(vectors: DataFrame) -> np.ndarray:
    """Orthonormal columns by descending variance of the unit vectors in column ``raw``, which are equally long."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                x = np.column_stack([np.ones(len(b)), unit(stacked(b["raw"]))])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"at": np.arange(total.size), "value": total.ravel()})

    sums = vectors.select("raw").mapInPandas(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").toPandas()["value"].to_numpy()
    m = sums.reshape(math.isqrt(len(sums)), -1) / sums[0]
    cov = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:])
    return np.linalg.eigh(cov)[1][:, ::-1]


def _turned(raw: pd.Series, axes: np.ndarray) -> np.ndarray:
    """Unit vectors along the principal axes; in their own dimensions if they are of another length."""
    x = unit(stacked(raw))
    return x @ axes if x.shape[1] == len(axes) else x


def _tiles(y: np.ndarray, width: float, grid: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each vector's tile, and for each later neighbour tile the vectors close enough to visit it."""
    lead = y[:, :grid]
    grid = lead.shape[1]
    cell = np.floor(lead / width).astype(np.int64)
    base = np.array([BASE ** (grid - 1 - d) for d in range(grid)])
    code = (cell + BASE // 2) @ base
    down, up = lead - cell * width, (cell + 1) * width - lead
    visits = []
    for move in itertools.product((-1, 0, 1), repeat=grid):
        if move > (0,) * grid:
            gap = sum(((down[:, d] if s < 0 else up[:, d]) ** 2 for d, s in enumerate(move) if s), np.zeros(len(y)))
            who = np.flatnonzero(gap <= width * width)
            visits.append((who, code[who] + int(np.array(move) @ base)))
    return code, visits


def _near(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of turned unit vectors whose cosine may reach the threshold."""
    least, found = threshold - 1e-9, []
    tail = lambda x, d: np.sqrt(np.maximum(0.0, (x[:, d:] ** 2).sum(1)))
    steps = [d for d in STEPS if d < a.shape[1]] + [a.shape[1]]
    tails = [(tail(a, d), tail(b, d)) for d in steps]
    for at in range(0, len(a), 512):
        part, done = a[at : at + 512], steps[0]
        dots = part[:, :done] @ b[:, :done].T
        i, j = np.nonzero(dots + np.outer(tails[0][0][at : at + 512], tails[0][1]) >= least)
        if same:
            keep = i + at < j
            i, j = i[keep], j[keep]
        sums = dots[i, j]
        for k, d in enumerate(steps[1:], 1):
            if not len(i):
                break
            if len(i) > dots.size // 8:  # most pairs go on: one product for all is cheaper
                sums = sums + (part[:, done:d] @ b[:, done:d].T)[i, j]
            else:
                sums = sums + np.concatenate([np.einsum("ij,ij->i", part[i[c : c + 65536], done:d], b[j[c : c + 65536], done:d]) for c in range(0, len(i), 65536)])
            go = sums + tails[k][0][i + at] * tails[k][1][j] >= least
            i, j, sums, done = i[go], j[go], sums[go], d
        found.append((i + at, j))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _cosines(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    (a, _), (b, _) = scaled(a), scaled(b)
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    return np.concatenate([(a[i[c : c + 65536]] * b[j[c : c + 65536]]).sum(1) / (na[i[c : c + 65536]] * nb[j[c : c + 65536]]) for c in range(0, len(i), 65536)]) if len(i) else np.empty(0)


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one of its component over the pairs."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def vector_groups(vectors: DataFrame, threshold: float = 0.95, grid: int = GRID, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (``vec_id``, ``embedding``).

    n_links counts the other rows whose cosine, in double precision, is at least
    ``threshold``; component_id is the smallest vec_id reachable over links; kept marks
    rows whose vec_id is that. Vectors that are null, empty, zero or not finite link with
    nothing; others link with those of their own length, very large and very small ones
    included. Rows with repeated vec_ids are separate vectors; null vec_ids name a
    component only if it has no other. Other columns are ignored; an empty table gives an
    empty one.
    """
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), packed(F.col("embedding")).alias("raw")), "vectors")
    alone = rows.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    fit = rows.where("raw is not null")
    width_of = F.octet_length("raw").alias("width")
    usual = fit.groupBy(width_of).count().orderBy(F.desc("count"), F.desc("width")).first()
    if usual is None:
        return alone
    reps = fit.groupBy("raw").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    reps = written(reps.select("*", width_of, F.monotonically_increasing_id().alias("node")), "distinct")
    axes, width = principal_axes(reps.where(F.col("width") == usual["width"])), math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def tiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each vector's own tile, and the later neighbours it is close enough to visit."""
        for b in batches:
            for _, part in b.groupby("width"):
                code, visits = _tiles(_turned(part["raw"], axes), width, grid)
                at = np.concatenate([np.arange(len(code)), *(who for who, _ in visits)])
                tile = np.concatenate([code, *(t for _, t in visits)])
                yield part[["node", "width"]].iloc[at].assign(tile=tile, home=np.arange(len(at)) < len(code))

    places = written(reps.select("node", "width", "raw").mapInPandas(tiled, "node long, width int, tile long, home boolean"), "places")
    # unit vectors fill a bounded number of tiles for each length: about (2 / width + 2) ** grid
    tiles = places.groupBy("width", "tile").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visitors")).where("homes > 0")
    tiles = tiles.select("width", "tile", F.ceil(F.col("homes") / block).alias("own_blocks"), F.ceil(F.col("visitors") / block).alias("visit_blocks"))
    # a vector at home meets its tile's other blocks and every block of visitors; a visitor meets every block at home
    mine, theirs = F.pmod(F.xxhash64("node"), F.col("own_blocks")), F.pmod(F.xxhash64("node"), F.col("visit_blocks"))
    at = lambda a, b, visited, right: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), F.lit(visited).alias("visited"), right.alias("right"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    inside = F.transform(upto(F.col("own_blocks")), lambda o: at(F.least(mine, o), F.greatest(mine, o), False, mine > o))
    met = F.when(F.col("visit_blocks") > 0, F.transform(upto(F.greatest(F.lit(1), F.col("visit_blocks"))), lambda o: at(mine, o, True, F.lit(False)))).otherwise(F.array())
    visit = F.transform(upto(F.col("own_blocks")), lambda o: at(o, theirs, True, F.lit(True)))
    units = places.join(tiles, ["width", "tile"]).select("node", "width", "tile", F.explode(F.when(F.col("home"), F.concat(inside, met)).otherwise(visit)).alias("at"))
    units = units.select("node", "width", "tile", "at.*")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        same = bool(not first["visited"] and first["a"] == first["b"])
        left = group if same else group[~group["right"]]
        right = group if same else group[group["right"]]
        none = pd.DataFrame({"node": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return none
        ln, rn, lc, rc = (g[c].to_numpy() for c in ("node", "copies") for g in (left, right))
        a, b = stacked(left["raw"]), stacked(right["raw"])
        ya, yb = _turned(left["raw"], axes), _turned(right["raw"], axes)
        shift = 0 if same else len(left)
        counts, label = np.zeros(shift + len(right), dtype=np.int64), np.arange(shift + len(right))
        for s in range(0, len(ya), PART):
            for t in range(s if same else 0, len(yb), PART):
                i, j = _near(ya[s : s + PART], yb[t : t + PART], threshold, same and s == t)
                keep = _cosines(a[s : s + PART], b[t : t + PART], i, j) >= threshold
                i, j = i[keep] + s, j[keep] + t
                np.add.at(counts, i, rc[j])
                np.add.at(counts, j + shift, lc[i])
                # links so far as a spanning forest, whatever their number
                tree = np.flatnonzero(label != np.arange(len(label)))
                label = _spanning(np.concatenate([i, tree]), np.concatenate([j + shift, label[tree]]), len(label)) if len(i) else label
        nodes = rn if same else np.concatenate([ln, rn])
        tree, linked = np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(counts)
        return pd.concat([none, pd.DataFrame({"node": nodes[linked], "other": -1, "n": counts[linked]}), pd.DataFrame({"node": nodes[tree], "other": nodes[label[tree]], "n": 0})])

    dealt = units.join(reps.select("node", "copies", "raw"), "node")
    found = written(dealt.groupBy("width", "tile", "a", "b", "visited").applyInPandas(compare, "node long, other long, n long"), "links")
    links = found.where("other < 0").groupBy("node").agg(F.sum("n").alias("n"))
    parts = written(connected_components(found.where("other >= 0"), "node", "other"), "parts")
    narrow = reps.select("node", "copies", "first")
    rooted = written(narrow.join(parts, "node", "left").select("node", "copies", "first", F.coalesce("component", "node").alias("root")).join(links, "node", "left"), "rooted")
    best = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(best, "root").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    names = written(reps.select("node", "raw").join(named, "node").select("raw", "component_id", "n_links"), "names")
    linked = fit.join(names, "raw").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)
