"""Graphs as two DataFrames, ordered selection, and iteration with a cut lineage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import drop_table, written


@dataclass(frozen=True)
class Graph:
    """``nodes(node)`` and ``edges(src, dst, ic_p)``; an undirected graph stores both arcs."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def from_edges(edges: DataFrame, nodes: DataFrame | None = None) -> "Graph":
        if nodes is None:
            nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        return Graph(nodes, edges)

    def out_neighbors(self, node: int) -> DataFrame:
        return self.edges.where(F.col("src") == node).select(F.col("dst").alias("node"))

    def in_neighbors(self, node: int) -> DataFrame:
        return self.edges.where(F.col("dst") == node).select(F.col("src").alias("node"))

    def without(self, removed: DataFrame) -> "Graph":
        """The graph that is left when the nodes in ``removed(node)`` and their arcs go."""
        r = removed.select("node").distinct()
        e = self.edges.join(r, F.col("src") == r["node"], "left_anti").join(r, F.col("dst") == r["node"], "left_anti")
        return Graph(self.nodes.join(r, "node", "left_anti"), e)

    def materialized(self) -> "Graph":
        return Graph(written(self.nodes, "nodes"), written(self.edges, "edges"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both orientations of every arc once, without loops: ``src, dst``."""
    pairs = edges.select("src", "dst").where("src <> dst")
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def top_k(scored: DataFrame, k: int, score: str = "score", node: str = "node", by: list[str] | None = None) -> DataFrame:
    """The ``k`` best rows by score, ties to the smallest id, with ``rank`` from 1; per group if ``by`` is given."""
    order = [F.desc(score), F.asc(node)]
    if by:
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    best = scored.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def over_earlier(df: DataFrame, order: list[Column], value: Column, name: str, of: Callable = F.sum) -> DataFrame:
    """``df`` with the sum (or, with ``F.max``, the greatest) of ``value`` over all rows before in the order; null for the first.

    Rows are dealt to ranges of the order and written, so that no task holds all of them; of the ranges only one row each is
    looked at together. Rows that the order does not tell apart come in any order.
    """
    cut = written(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("_part").agg(of("_value").alias("_all")).select("_part", of("_all").over(until(Window.orderBy("_part"))).alias("_before"))
    within = of("_value").over(until(Window.partitionBy("_part").orderBy(*order)))
    both = F.greatest("_before", "_within") if of is F.max else F.coalesce(F.col("_before") + F.col("_within"), "_before", "_within")
    return cut.join(F.broadcast(parts), "_part").withColumn("_within", within).withColumn(name, both).drop("_part", "_value", "_before", "_within")


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place from 0 in the order, as :func:`over_earlier` counts."""
    return over_earlier(df, order, F.lit(1).cast("long"), name).withColumn(name, F.coalesce(name, F.lit(0)))


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], rounds: int, stop: Callable[[DataFrame, DataFrame], bool] | None = None, name: str = "state", settle: bool = False) -> DataFrame:
    """Apply ``step`` up to ``rounds`` times; each result is a written table, so no lineage builds up.

    With ``settle`` a state that ``stop`` has not found settled after all rounds is an error.
    """
    now = written(state, name)
    for i in range(rounds):
        new = written(step(now, i), name)
        done = stop is not None and stop(now, new)
        drop_table(now)
        now = new
        if done:
            break
    else:
        if settle:
            raise RuntimeError(f"{name} did not settle in {rounds} rounds")
    return now


def product_of(complement: Column) -> Column:
    """1 - the product of (1 - x) over a group, for x below 1; exactly 1 where any x is 1."""
    sure = F.max(F.when(complement >= 1, 1).otherwise(0)) == 1
    return F.when(sure, F.lit(1.0)).otherwise(1 - F.exp(F.sum(F.when(complement < 1, F.log1p(-complement)))))
