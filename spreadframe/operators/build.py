"""Graph construction: edge cleaning, probability models, relabelling, generators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import Graph, numbered, undirected
from ..functions.coins import coin
from .components import connected_components


def clean_edges(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Distinct arcs without loops; both orientations if undirected."""
    return edges.select("src", "dst").where("src <> dst").distinct() if directed else undirected(edges)


def weighted_cascade(arcs: DataFrame) -> DataFrame:
    """``src, dst, ic_p`` with ic_p one over the head's in-degree (also the linear-threshold weight)."""
    indeg = arcs.groupBy("dst").agg(F.count("*").alias("_in"))
    return arcs.join(indeg, "dst").select("src", "dst", (F.lit(1.0) / F.col("_in")).alias("ic_p"))


def with_probability(arcs: DataFrame, model: str = "weighted", uniform_p: float = 0.1, salt: int = 0) -> DataFrame:
    """Arc probabilities: ``weighted`` (1 / in-degree), ``uniform`` or ``random`` in [0.02, 0.4)."""
    if model == "weighted":
        return weighted_cascade(arcs)
    if model == "uniform":
        return arcs.select("src", "dst", F.lit(float(uniform_p)).alias("ic_p"))
    if model == "random":
        return arcs.select("src", "dst", (F.lit(0.02) + F.lit(0.38) * coin(F.col("src"), F.col("dst"), salt, "weight")).alias("ic_p"))
    raise ValueError(f"unknown probability model {model!r}")


def dense_ids(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges renumbered 0..N-1 in id order, and the mapping ``raw, node``.

    Ids are counted in ranges first, so that no single task orders all of them.
    """
    raw = edges.select(F.col("src").alias("raw")).union(edges.select("dst")).distinct()
    ids = numbered(raw, [F.asc("raw")], "node")
    out = edges.join(ids.select(F.col("raw").alias("src"), F.col("node").alias("_s")), "src").join(ids.select(F.col("raw").alias("dst"), F.col("node").alias("_d")), "dst")
    return out.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]), ids


def largest_component(graph: Graph) -> Graph:
    """The biggest weakly connected component, the one with the smallest id if several are."""
    parts = connected_components(graph.edges)
    best = parts.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    keep = parts.join(F.broadcast(best), "component", "left_semi").select("node")
    edges = graph.edges.join(keep.withColumnRenamed("node", "src"), "src", "left_semi")
    return Graph(keep, edges)


def sample_arcs(spark: SparkSession, n: int, p: float, seed: int = 0, directed: bool = False) -> DataFrame:
    """Erdos-Renyi arcs: geometric skips over the pairs of each row, so only arcs are made, not all pairs."""

    def skips(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for u in b["id"]:
                rng = np.random.default_rng([seed, int(u)])
                first = 0 if directed else int(u) + 1
                got = np.flatnonzero(rng.random(max(0, n - first)) < p) + first
                got = got[got != u]
                if len(got):
                    yield pd.DataFrame({"src": int(u), "dst": got})

    arcs = spark.range(n).mapInPandas(skips, "src long, dst long")
    return arcs if directed else undirected(arcs)


def block_model(spark: SparkSession, n: int, blocks: int, p_in: float, p_out: float, seed: int = 0) -> DataFrame:
    """Stochastic block model; node i is in block i mod ``blocks``."""
    a, b = spark.range(n).withColumnRenamed("id", "src"), spark.range(n).withColumnRenamed("id", "dst")
    same = F.col("src") % blocks == F.col("dst") % blocks
    pairs = a.join(b, F.col("src") < F.col("dst")).where(coin(F.col("src"), F.col("dst"), seed, "weight") < F.when(same, p_in).otherwise(p_out))
    return undirected(pairs)


# seed matrices of the Kronecker generator; fixed values
KRONECKER = {"random": (0.5, 0.5, 0.5, 0.5), "hierarchical": (0.9, 0.1, 0.1, 0.9), "core": (0.9, 0.5, 0.5, 0.3)}


def kronecker_arcs(spark: SparkSession, n: int, variant: str = "core", seed: int = 0) -> DataFrame:
    """Stochastic Kronecker arcs on 2**k nodes, cut to the first ``n``, mirrored."""
    a, b, c, d = KRONECKER[variant]
    p = F.lit(1.0)
    for bit in range(max(1, math.ceil(math.log2(max(2, n))))):
        s, t = F.shiftright("src", bit).bitwiseAND(F.lit(1)), F.shiftright("dst", bit).bitwiseAND(F.lit(1))
        p = p * F.when((s == 0) & (t == 0), a).when((s == 0) & (t == 1), b).when((s == 1) & (t == 0), c).otherwise(d)
    pairs = spark.range(n).withColumnRenamed("id", "src").join(spark.range(n).withColumnRenamed("id", "dst"), F.col("src") < F.col("dst"))
    return undirected(pairs.where(coin(F.col("src"), F.col("dst"), seed, "weight") < p))


def grown_graph(spark: SparkSession, family: str, n: int, m: int = 2, p: float = 0.1, seed: int = 0) -> DataFrame:
    """Sequentially grown families: ``ba`` (preferential attachment), ``ws`` (rewired ring), ``plc`` (with triangles).

    Growth depends on all earlier steps, so one task makes the graph; seeds give many graphs side by side.
    """

    def grow(batches):
        import numpy as np
        import pandas as pd

        for _ in batches:
            rng, arcs = np.random.default_rng(seed), set()
            if family == "ws":
                for u in range(n):
                    for k in range(1, m + 1):
                        v = (u + k) % n if rng.random() >= p else int(rng.integers(n))
                        if u != v:
                            arcs.add((u, v))
            else:
                ends, near = list(range(m)), {i: set() for i in range(n)}
                for u in range(m, n):
                    chosen: set[int] = set()
                    last = None
                    while len(chosen) < m:
                        close = [w for w in near[last] if w != u and w not in chosen] if last is not None and family == "plc" and rng.random() < p else []
                        v = close[int(rng.integers(len(close)))] if close else ends[int(rng.integers(len(ends)))]
                        if v not in chosen:
                            chosen.add(v)
                            last = v
                    for v in chosen:
                        arcs.add((u, v))
                        near[u].add(v)
                        near[v].add(u)
                        ends += [u, v]
            yield pd.DataFrame(sorted(arcs), columns=["src", "dst"])

    return undirected(spark.range(1).coalesce(1).mapInPandas(grow, "src long, dst long"))
