"""The second eigenvector of a large connected graph, by a block of vectors that lies in buckets of nodes.

A block is filtered by Chebyshev polynomials of the normalised adjacency, which lift what lies above a bound, and turned
to Ritz vectors. Spark deals all buckets of vectors and the arcs into one bucket to one task. The driver sees products of the
block with itself, some dozens of numbers square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop_table, written
from . import tiles

#: Vectors of a block, steps that one job does, least and most nodes of a bucket, buckets about.
BLOCK, STEPS, LEAST, BUCKETS = 24, 5, 4096, 16
#: How much one cycle lifts the first vector at most, and steps of a cycle at most.
LIFT, MOST = 1e5, 30

_TILE = "bucket int, front binary, seen binary"


def _mapped(df: DataFrame, of, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                yield pd.DataFrame([of(r)], columns=names)

    return df.mapInPandas(run, schema)


def _pushed(state: DataFrame, arcs: DataFrame, buckets: int, b: int, of, schema: str) -> DataFrame:
    """Each bucket's ``of(product, own block, seen)`` after one product with the matrix.

    ``front`` has a block's rows over the roots of the degrees, then the degrees; ``seen`` has rows of ``b`` numbers and the
    root. ``product`` takes the value that the first eigenvector (the roots themselves) is to have.
    """
    names = [c.split()[0] for c in schema.split(",")]
    db = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("db")
    left = state.select("bucket", "front", "seen", db).select("db", F.col("bucket").alias("sb"), "front", F.when(F.col("db") == F.col("bucket"), F.col("seen")).alias("seen"))

    def step(key, l, r):
        fronts = {sb: np.frombuffer(f).reshape(-1, b + 1) for sb, f in zip(l["sb"], l["front"])}
        own = fronts[key[0]]
        seen = np.frombuffer(next(s for s in l["seen"] if s is not None)).reshape(len(own), -1)
        root = seen[:, -1:]
        sums = np.zeros((len(own), b))
        for sb, s, d in zip(r["sb"], r["src"], r["dst"]):
            s, d = np.frombuffer(s, np.int32), np.frombuffer(d, np.int32)
            at = tiles.runs(d)
            sums[d[at]] += np.add.reduceat(fronts[sb][s, :b], at, axis=0)
        dot = sum(f[:, b] @ f[:, :b] for f in fronts.values()) / sum(f[:, b].sum() for f in fronts.values())

        def product(first: float) -> np.ndarray:
            return sums / root + (first - 1) * root * dot

        return pd.DataFrame([(int(key[0]), *of(product, own[:, :b] * root, seen))], columns=names)

    return left.groupBy("db").cogroup(arcs.groupBy("db")).applyInPandas(step, schema)


def _front(y: np.ndarray, root: np.ndarray) -> bytes:
    return np.hstack([y / root, root * root]).tobytes()


def second_vector(edges: DataFrame, tolerance: float = 1e-7, cycles: int = 500) -> DataFrame:
    """``node, x``: the second eigenvector, of length 1, of the normalised adjacency of a connected graph of ``src, dst`` (both ways, each once).

    The residual is brought under ``tolerance`` of the gap to the next eigenvalue (of 1e-6, if that is smaller); a vector that
    has not come there after all cycles is an error. The smallest node's entry is not positive.
    """
    n = edges.select("src").distinct().count()
    b = min(BLOCK, n - 1)
    t = tiles.tiled(edges, edges.agg(F.min("src").alias("node")), 64, side=max(LEAST, -(-n // BUCKETS)), width=64)
    arcs = t.arcs.select("sb", "db", "src", "dst")
    degrees = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").cast("double").alias("d"))

    def begun(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node")
        root = np.sqrt(g["d"].to_numpy())[:, None]
        y = np.random.default_rng([13, int(g["bucket"].iloc[0])]).standard_normal((len(g), b))
        return pd.DataFrame([(g["bucket"].iloc[0], _front(y, root), np.hstack([y, root]).tobytes())], columns=["bucket", "front", "seen"])

    ids = t.ids.mapInPandas(lambda parts: (pd.DataFrame({"bucket": np.int32(r.bucket), "node": np.frombuffer(r.ids, np.int64)}) for p in parts for r in p.itertuples()), "bucket int, node long")
    state = written(ids.join(degrees, "node").groupBy("bucket").applyInPandas(begun, _TILE), "block")

    def moved(state: DataFrame, b: int, steps: int, low: float, high: float | None) -> DataFrame:
        """``steps`` products, plain ones or (with ``high``) as the recurrence of Chebyshev polynomials on [low, high]."""
        held = None
        for i in range(steps):
            if high is None:
                of = lambda product, y, seen: (_front(product(0.0), seen[:, -1:]), seen.tobytes())
            else:
                mid, half = (high + low) / 2, (high - low) / 2

                def of(product, y, seen, mid=mid, half=half, b=b):
                    new = 2 / half * (product(low) - mid * y) - seen[:, :b]
                    return _front(new, seen[:, -1:]), np.hstack([y, seen[:, -1:]]).tobytes()

            state = _pushed(state, arcs, t.buckets, b, of, _TILE)
            if i % STEPS == STEPS - 1 and i < steps - 1:
                state, old = written(state, "block"), held
                held = state
                if old is not None:
                    drop_table(old)
        return state

    def ended(product, y, seen):
        my = product(0.0)
        return y.tobytes(), my.tobytes(), seen[:, -1:].tobytes(), np.stack([y.T @ y, y.T @ my]).tobytes()

    low, high, first = -1.0, None, 4
    for _ in range(cycles):
        old = state
        state = written(_pushed(moved(state, b, first, low, high), arcs, t.buckets, b, ended, "bucket int, y binary, my binary, root binary, gram binary"), "block")
        drop_table(old)
        gram, with_m = sum(np.frombuffer(r["gram"]).reshape(2, b, b) for r in state.select("gram").collect())
        scale = 1 / np.sqrt(np.maximum(np.diag(gram), np.finfo(float).tiny))
        w, u = np.linalg.eigh(gram * scale * scale[:, None])
        base = scale[:, None] * u[:, w > 1e-11 * w[-1]] / np.sqrt(w[w > 1e-11 * w[-1]])
        values, turn = np.linalg.eigh(base.T @ (with_m + with_m.T) / 2 @ base)
        values, turn = values[::-1], (base @ turn)[:, ::-1].copy()
        gap = values[0] - values[1] if len(values) > 1 else 1.0

        def off(r, b=b, turn=turn, value=values[0]):
            rest = (np.frombuffer(r.my).reshape(-1, b) - value * np.frombuffer(r.y).reshape(-1, b)) @ turn[:, :1]
            return (float((rest * rest).sum()),)

        if _mapped(state.select("y", "my"), off, "off double").agg(F.sum("off")).first()[0] ** 0.5 <= tolerance * max(gap, 1e-6):
            break
        low = min(low if high is not None else 1.0, max(-1.0, values[-1] - 0.1 * (values[0] - values[-1])))
        high = max(values[len(values) * 3 // 4], low + 1e-3 * (values[0] - low))
        mid, half = (high + low) / 2, (high - low) / 2
        first = int(min(MOST, max(4, np.log(2 * LIFT) / np.arccosh(max(1 + 1e-12, (values[0] - mid) / half)))))

        def begin(r, b=b, turn=turn, mid=mid, half=half):
            root = np.frombuffer(r.root)[:, None]
            y, my = (np.frombuffer(x).reshape(-1, b) @ turn for x in (r.y, r.my))
            return r.bucket, _front((my - mid * y) / half, root), np.hstack([y, root]).tobytes()

        old, b = state, turn.shape[1]
        state = written(_mapped(state.select("bucket", "y", "my", "root"), begin, _TILE), "block")
        drop_table(old)
    else:
        raise RuntimeError(f"the second vector did not settle in {cycles} cycles")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for r in p.itertuples():
                yield pd.DataFrame({"node": np.frombuffer(r.ids, np.int64), "x": (np.frombuffer(r.y).reshape(-1, b) @ turn[:, :1])[:, 0]})

    x = written(state.select("bucket", "y").join(t.ids, "bucket").mapInPandas(rows, "node long, x double"), "vector")
    flip = -1.0 if x.agg(F.min_by("x", "node")).first()[0] > 0 else 1.0
    return x.select("node", (F.col("x") * flip).alias("x"))
