"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

The table is cut into blocks of neighbouring rows. How many rows of each block go to each
shard is drawn as a uniform permutation of all rows would have it: a multivariate
hypergeometric draw from what the shards still have room for. Each block is permuted and
dealt out by its counts, the rows are exchanged, and each shard is permuted again.
Numbers come from hashes of a row's place in the written table and the seed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written

#: Cells of the communication matrix at most: beyond it, neighbouring blocks are merged.
CELLS = 1 << 22
#: Populations from which numpy draws hypergeometric numbers itself.
NUMPY_MOST = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` items drawn from ``good + bad`` are good, for populations of any size.

    Large ones are drawn by inversion: the probabilities around the mode follow from it by
    their ratios, and what lies further than 14 standard deviations away has no weight in
    double precision.
    """
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    least, most, total = max(0, n - bad), min(n, good), good + bad
    mode = min(most, max(least, (n + 1) * (good + 1) // (total + 2)))
    reach = 30 + int(14 * math.sqrt(n * (good / total) * (bad / total)))
    low, high = max(least, mode - reach), min(most, mode + reach)
    k = np.arange(mode, high, dtype=float)
    up = np.cumprod((good - k) * (n - k) / ((k + 1) * (bad - n + k + 1)))
    k = np.arange(mode, low, -1, dtype=float)
    down = np.cumprod(k * (bad - n + k) / ((good - k + 1) * (n - k + 1)))
    upto = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
    return low + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks by shards: counts of a uniform permutation with shard sizes at most one apart."""
    rng, total = np.random.default_rng(seed), sum(rows)
    room = [total // shards + extra for extra in (rng.permutation(shards) < total % shards).tolist()]
    out = np.zeros((len(rows), shards), dtype=np.int64)
    for i, n in enumerate(rows):
        beyond = sum(room)
        for s in range(shards):
            beyond -= room[s]
            out[i, s] = took = hypergeometric(rng, room[s], beyond, n)
            room[s] -= took
            n -= took
    return out


def _order(seed: int, salt: int) -> Column:
    return F.xxhash64("_shard_row", F.lit(seed), F.lit(salt))


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 5) -> DataFrame:
    """``docs`` with columns law, shard (0 to ``shards`` - 1) and slot (0, 1, ... within its shard).

    Law ``rows``: shard sizes are at most one apart. Columns of the three new names are
    replaced and all others kept; no column's value matters, so nulls, empty and very
    long texts, ties and repeated rows are rows like any other. An empty table gives an
    empty one. The same table written the same way gives the same shards.
    """
    own = [c for c in docs.columns if c not in ("law", "shard", "slot") and not c.startswith("_shard")]
    table = written(docs.select(*own, F.monotonically_increasing_id().alias("_shard_row")), "rows")
    n = table.count()
    # an id is the number of its task and of the row in it; blocks of a task's rows grow with the square root of all
    bits = max(8, math.ceil(math.log2(math.sqrt(max(1, n)))))
    block = lambda: F.shiftrightunsigned("_shard_row", bits).alias("_block")
    counts = dict(table.groupBy(block()).count().collect())
    while len(counts) * shards > CELLS and len(counts) > 1:
        # many small tasks: neighbouring blocks become one, whose rows still lie side by side
        bits, finer, counts = bits + 1, counts, {}
        for b, c in finer.items():
            counts[b >> 1] = counts.get(b >> 1, 0) + c
    counts = sorted(counts.items())
    keyed = table.select("_shard_row", block())
    upto = communication_matrix([c for _, c in counts], shards, seed).cumsum(axis=1).tolist()
    matrix = table.sparkSession.createDataFrame([(b, u) for (b, _), u in zip(counts, upto)], "_block long, _upto array<long>")

    local = F.row_number().over(Window.partitionBy("_block").orderBy(_order(seed, 1), "_shard_row"))
    place = keyed.withColumn("_at", local).join(F.broadcast(matrix) if len(counts) * shards <= 1 << 20 else matrix, "_block")
    dealt = place.select("_shard_row", F.size(F.filter("_upto", lambda u: u < F.col("_at"))).alias("shard"))
    # again within each shard: rows in the order of a second hash, counted off in parts of it
    parts = math.ceil(math.sqrt(max(1, n / shards)))
    hashed = dealt.select("*", _order(seed, 2).alias("_key")).withColumn("_part", F.floor((F.shiftright("_key", 33) + F.lit(1 << 30)) * F.lit(parts) / F.lit(1 << 31)).cast("long"))
    hashed = written(hashed, "dealt")
    sizes = hashed.groupBy("shard", "_part").count()
    first = F.sum("count").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(sizes.select("shard", "_part", F.coalesce(first, F.lit(0)).alias("_first")), "starts")
    within = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_key", "_shard_row"))
    slots = hashed.select("_shard_row", "shard", "_part", (within - 1).alias("_within")).join(starts, ["shard", "_part"]).select("_shard_row", "shard", (F.col("_first") + F.col("_within")).alias("slot"))
    return table.join(slots, "_shard_row").select(*own, F.lit("rows").alias("law"), "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in the order of their slots in each of its files."""
    rows = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
