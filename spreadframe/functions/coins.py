"""Counter-based random numbers in plain long arithmetic, equal in Spark and in other SQL engines.

A coin is a function of two ids, a sample and a purpose (``salt``), so runs of different
plans share their random numbers and a lost task draws the same ones again. Two squaring
rounds break up the regular pattern that a linear mix of the inputs would leave.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# multipliers of the mix; fixed values
PRIME = 2147483647
U, V, S, MIX = 73856093, 19349663, 83492791, 48271
ADD1, ADD2 = 1013904223, 69069
#: Purposes, so that coins of one do not repeat those of another.
SALT = {"arc": 11, "threshold": 23, "threshold2": 29, "root": 37, "tie": 41, "split": 53, "weight": 61, "recover": 71, "pick": 83, "mask": 97, "edit": 101}


def coin(u, v, sample=0, salt: str | int = "arc") -> Column:
    """A number in [0, 1) for ids ``u`` and ``v`` (columns or numbers below 2**31) in sample ``sample``."""
    col = lambda x: x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long")
    n = SALT[salt] if isinstance(salt, str) else salt
    h0 = ((col(u) * U + col(v) * V + col(sample) * S + n) % PRIME * MIX) % PRIME
    h1 = (h0 * h0 + ADD1) % PRIME
    return (h1 * h1 + ADD2) % PRIME / F.lit(float(PRIME))


def coin_sql(u: str, v: str, sample: str = "0", salt: str | int = "arc") -> str:
    """The same number as SQL text."""
    n = SALT[salt] if isinstance(salt, str) else salt
    big = lambda x: f"CAST({x} AS BIGINT)"
    h0 = f"((({big(u)}*{U} + {big(v)}*{V} + {big(sample)}*{S} + {n}) % {PRIME} * {MIX}) % {PRIME})"
    h1 = f"(({h0}*{h0} + {ADD1}) % {PRIME})"
    return f"(({h1}*{h1} + {ADD2}) % {PRIME} / CAST({PRIME} AS DOUBLE))"
