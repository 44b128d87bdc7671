"""Approximate nearest neighbours by collision-counting hashing.

Every vector is projected on ``PROJECTIONS`` directions and each projection of a block of
vectors is kept as one sorted array. A query's windows are centred on its own projections
and widened step by step (virtual rehashing: no array is built again). A vector inside
the windows of at least ``COLLISIONS`` of the projections is a candidate and is verified
by its exact inner product; widening stops with ``SPARE`` candidates besides the number
asked for, whatever the size of the block. The directions are orthonormal sets: over a
set the squared distances along them add up to the whole one, which makes the counts far
sharper than those of independent directions. An added dimension makes all vectors
equally long, so the nearest are those of largest inner product.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written
from .vectors import packed, products, scaled, stacked, unit

PROJECTIONS = 260
#: Share of the projections that must collide.
COLLISIONS = 0.85
#: Windows grow by this factor from step to step.
WIDER = 1.03
#: A query's candidates in a block besides the number asked for.
SPARE = 60
#: Vectors of a block, and queries that meet it in one task, about; a row of a block has a 16-bit number.
ROWS = 16_384
QUERIES = 8192


def directions(dimensions: int, seed: int) -> np.ndarray:
    """``PROJECTIONS`` random columns, in sets that are orthonormal."""
    rng, sets = np.random.default_rng(seed), []
    for _ in range(math.ceil(PROJECTIONS / dimensions)):
        q, r = np.linalg.qr(rng.standard_normal((dimensions, min(dimensions, PROJECTIONS))))
        sets.append(q * np.sign(np.diag(r)))
    return np.concatenate(sets, axis=1)[:, :PROJECTIONS]


class Index:
    """Sorted projections of one block of vectors (rows of length at most 1, shortened alike)."""

    def __init__(self, x: np.ndarray, seed: int):
        self.a = directions(x.shape[1] + 1, seed)
        h = np.column_stack([x, np.sqrt(np.maximum(0.0, 1 - (x * x).sum(1)))]) @ self.a
        order = np.argsort(h, axis=0, kind="stable")
        self.n, self.order = len(x), order.T.astype(np.uint16)
        self.sorted = np.take_along_axis(h, order, axis=0).T.astype(np.float32)
        #: Half of the first windows' width; later queries start where earlier ones were about to end.
        self.first = float(np.median(h.std(0))) + 1e-9

    def candidates(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """For each query (rows of length one) the rows whose projections collide often enough."""
        n, m = self.n, PROJECTIONS
        need, most = min(n, k + SPARE), m - math.ceil(COLLISIONS * m)
        centre = (queries @ self.a[:-1]).astype(np.float32)
        out: list[np.ndarray | None] = [None] * len(queries)
        missed = np.zeros((len(queries), n), dtype=np.int64)
        low, high = np.empty((len(queries), m), dtype=np.int64), np.empty((len(queries), m), dtype=np.int64)
        width, left, ends, fresh = np.float32(self.first), np.arange(len(queries)), [], True
        while len(left):
            to_low, to_high = np.empty((len(left), m), dtype=np.int64), np.empty((len(left), m), dtype=np.int64)
            for j in range(m):
                to_low[:, j] = np.searchsorted(self.sorted[j], centre[left, j] - width, side="left")
                to_high[:, j] = np.searchsorted(self.sorted[j], centre[left, j] + width, side="right")
            done = np.zeros(len(left), dtype=bool)
            for r, q in enumerate(left.tolist()):
                a, b = to_low[r].tolist(), to_high[r].tolist()
                if fresh:  # the first windows hold most rows: count what they leave out
                    rings = [self.order[j, : a[j]] for j in range(m)] + [self.order[j, b[j] :] for j in range(m)]
                    missed[q] = np.bincount(np.concatenate(rings), minlength=n)
                else:
                    la, hb = low[q].tolist(), high[q].tolist()
                    rings = [self.order[j, a[j] : la[j]] for j in range(m)] + [self.order[j, hb[j] : b[j]] for j in range(m)]
                    missed[q] -= np.bincount(np.concatenate(rings), minlength=n)
                found = np.flatnonzero(missed[q] <= most)
                if len(found) >= need:
                    out[q], done[r] = found, True
                    ends.append(width)
            low[left], high[left] = to_low, to_high
            left, width, fresh = left[~done], np.float32(width * WIDER), False
        self.first = float(np.quantile(ends, 0.1)) / WIDER if ends else self.first
        return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, seed: int = 3, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest found for each query.

    ``vectors`` has ``vec_id`` and ``embedding``; rows where ``is_query`` holds are the
    queries, and all rows but those of the query's own vec_id its candidates. Score is the
    inner product of the original vectors in double precision (infinite beyond its range);
    ties go to the smaller vec_id. Vectors that are null, empty, zero or not finite, or
    without a vec_id, take no part; vectors meet those of their own length, and very large
    and very small ones take part like any other. Repeated rows are candidates of their
    own; as queries, rows of one vec_id give one list. Other columns are ignored; an empty table gives an empty one.
    """
    all_rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), packed(F.col("embedding")).alias("raw"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id is not null and raw is not null")
    kept = written(all_rows.withColumn("width", F.octet_length("raw")), "vectors")

    def longest(batches):
        for b in batches:
            for width, part in b.groupby("width"):
                x, exponent = scaled(stacked(part["raw"]))
                yield pd.DataFrame({"width": [width], "longest": [float((np.log2((x * x).sum(1)) / 2 + exponent).max())], "n": [len(part)], "asks": [int(part["asks"].sum())]})

    # a row for each length of vectors; `longest` is the binary logarithm of the longest one's length
    sizes = kept.mapInPandas(longest, "width int, longest double, n long, asks long").groupBy("width").agg(F.max("longest").alias("longest"), F.sum("n").alias("n"), F.sum("asks").alias("asks"))
    by_rows = F.ceil(F.col("n") / rows)
    # few blocks: queries are dealt to more tasks, so that all cores have work
    spread_to = F.least(F.ceil(F.col("asks") / 256), F.ceil(F.lit(2 * vectors.sparkSession.sparkContext.defaultParallelism) / F.col("by_rows")))
    plan = written(sizes.withColumn("by_rows", by_rows).withColumn("by_queries", F.greatest(F.lit(1), F.ceil(F.col("asks") / queries), spread_to)).drop("n", "asks"), "plan")
    part = lambda salt, parts: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    planned = kept.join(plan, "width")
    data = planned.select(F.lit(False).alias("asks"), "vec_id", "raw", "width", "longest", part(1, "by_rows").alias("i"), every("by_queries").alias("j"))
    query = planned.where("asks").dropDuplicates(["vec_id", "raw"]).select("asks", "vec_id", "raw", "width", "longest", every("by_rows").alias("i"), part(2, "by_queries").alias("j"))

    def shortened(x: np.ndarray, longest: float) -> np.ndarray:
        y, exponent = scaled(x)
        return y * np.exp2(exponent - longest)[:, None]

    def search(group: pd.DataFrame) -> pd.DataFrame:
        q, d = group[group["asks"]].sort_values("vec_id"), group[~group["asks"]].sort_values("vec_id")
        out = []
        if len(q) and len(d):
            x, ids, ask, longest = stacked(d["raw"]), d["vec_id"].to_numpy(), stacked(q["raw"]), float(d["longest"].iloc[0])
            # hashing leaves blocks a little unequal; a block's rows have 16-bit numbers
            for start in range(0, len(x), 1 << 16):
                block, block_ids = x[start : start + (1 << 16)], ids[start : start + (1 << 16)]
                index = Index(shortened(block, longest), seed)
                for at in range(0, len(q), 64):
                    some = ask[at : at + 64]
                    for query_id, v, found in zip(q["vec_id"].iloc[at : at + 64], some, index.candidates(unit(some), k + 1)):
                        found = found[block_ids[found] != query_id]
                        score = products(block[found], v)
                        best = np.lexsort((block_ids[found], -score))[:k]
                        out.append(pd.DataFrame({"query_id": query_id, "vec_id": block_ids[found][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = data.unionByName(query).groupBy("width", "i", "j").applyInPandas(search, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
