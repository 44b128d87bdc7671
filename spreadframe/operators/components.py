"""Connected components by alternating star contractions.

Every round replaces each edge by one towards the smallest neighbour seen (first among
larger nodes, then among smaller ones), until all nodes of a component point at its
smallest node; the number of rounds grows with the logarithm of the largest component.
A round's minima are partial aggregates, and the joins read written tables on both
sides, so adaptive execution can split the partition of a node with many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop_table, written


def _minima(pairs: DataFrame) -> DataFrame:
    return written(pairs.groupBy("u").agg(F.min("v").alias("m")), "minima")


def _large_star(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "minima")
    out = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return written(out.where("u <> v").distinct(), "star"), [m]


def _small_star(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _minima(down)
    out = down.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
    return written(out.where("u <> v").distinct(), "star"), [m]


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """Label every node that an edge touches with the smallest node id of its component.

    Edges are undirected longs; rows with a null endpoint are ignored, a self loop makes
    its node a component of its own, and repeated edges count once. Returns
    ``node, component``; an empty input gives an empty result.
    """
    pairs = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).dropna()
    pairs = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    loops = pairs.where("u = v").select("u")
    now = pairs.where("u <> v")
    before, spent = _state(now), []
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        large, a = _large_star(now)
        small, b = _small_star(large)
        after = _state(small)
        for x in [*spent, *a, *b, large]:
            drop_table(x)
        now, spent = small, [small]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).unionByName(loops.select(F.col("u").alias("node"), F.col("u").alias("component")))
    return nodes.groupBy("node").agg(F.min("component").alias("component"))
