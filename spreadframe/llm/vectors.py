"""Vectors as packed bytes: one check of what counts as a vector for all operators on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def packed(embedding: Column) -> Column:
    """Little-endian doubles of a vector; null if it is null, empty, zero or has a null or non-finite component."""

    def pack(rows: pd.Series) -> pd.Series:
        out = []
        for r in rows:
            x = None if r is None else np.array([np.nan if c is None else c for c in r], dtype="<f8") if getattr(r, "dtype", None) == object else np.asarray(r, dtype="<f8")
            out.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(pack, "binary")(embedding.cast("array<double>"))


def stacked(raw: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1) if len(raw) else np.empty((0, 0))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by a power of two, which loses nothing, so that their largest component is in [0.5, 1); and its exponent.

    Sums of squares of such rows neither overflow nor vanish, however large or small the vectors are.
    """
    exponent = np.frexp(np.abs(x).max(1))[1] if len(x) else np.empty(0, dtype=np.int32)
    # in two steps, as a single factor can be beyond the range of doubles
    half = exponent // 2
    return np.ldexp(np.ldexp(x, -half[:, None]), (half - exponent)[:, None]), exponent


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one."""
    y, _ = scaled(x)
    return y / np.sqrt((y * y).sum(1, keepdims=True)) if len(y) else y


def products(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows with a vector in double precision; one beyond its range is infinite with the product's sign."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = (x * v).sum(1)
    bad = ~np.isfinite(out)
    if bad.any():
        (a, ea), (b, eb) = scaled(x[bad]), scaled(v[None, :])
        with np.errstate(over="ignore"):
            out[bad] = np.ldexp((a * b).sum(1), ea + eb)
    return out
