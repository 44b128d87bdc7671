"""SimHash near-duplicates by deletion-variant signatures.

A document's fingerprint has a bit for each bit that over half of its word-shingle
hashes have set. Two fingerprints that differ in at most 3 of 64 bits differ in at most
one bit of one of their two halves (with d bits, of one of d // 2 + 1 segments). So each
half is indexed once for each of its bits with that bit wiped out, equal signatures are
joined, and the candidates are verified. Equal fingerprints are one node from the start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..shared import unsent, written

#: Shingles whose bits are counted at once, which bounds a worker's memory.
SLAB = 1 << 15


def _fingerprint(text: bytes | None, shingle: int, h) -> int:
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([h(b" ".join(words), 42)], dtype="<u8")
        return int(hashes.view("<i8")[0])
    n, over = len(words) - shingle + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, n, SLAB):
        part = words[at : at + SLAB + shingle - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        m = len(part) - shingle + 1
        hashes = np.array([h(line[a:b], 42) for a, b in zip(starts[:m].tolist(), (ends[shingle - 1 :] - 1).tolist())], dtype="<u8")
        over += np.unpackbits(hashes.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * over > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """64-bit SimHash of a text as a long: words between ASCII white space, A-Z lower-cased.

    A shingle's hash is XXH64 with seed 42 of its space-joined UTF-8 words; repeats
    count. With fewer words the whole sequence is the one shingle; without any, or null, 0.
    """

    def prints(texts: pd.Series) -> pd.Series:
        from xxhash import xxh64_intdigest

        return pd.Series([_fingerprint(t, shingle, xxh64_intdigest) for t in texts], dtype="int64")

    return F.pandas_udf(prints, "long")(text.cast("string").cast("binary"))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def variants(fp: Column, bits: int = 3) -> Column:
    """Signatures of a fingerprint: each segment with each of its bits wiped out in turn."""
    n = bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    out = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        segment = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        out += [F.struct(F.lit(k * 64 + i).alias("at"), segment.bitwiseAND(F.lit(~(1 << i))).alias("rest")) for i in range(b - a)]
    return F.array(*out)


def near_pairs(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Pairs ``a < b`` of different fingerprints in column ``fp`` that differ in at most ``bits`` bits."""
    index = prints.select("fp", F.explode(variants(F.col("fp"), bits)).alias("s")).select("fp", "s.at", "s.rest")
    a, b = index.withColumnRenamed("fp", "a"), index.withColumnRenamed("fp", "b")
    return a.join(unsent(b), ["at", "rest"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, bits: int = 3, shingle: int = 3, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with fingerprint, component_id and kept.

    ``docs`` has ``doc_id`` and ``text``; columns of the three new names are replaced.
    fingerprint has 16 hex digits; component_id is the smallest doc_id reachable over
    links; kept marks one row of each component, one with that doc_id. Null doc_ids link
    like others and come last, so component_id is null only if all of a component are.
    Of repeated rows at most one is kept. An empty table gives an empty one.
    """
    own = [c for c in carry or docs.columns if c not in ("fingerprint", "component_id", "kept", "_fp", "_row")]
    ids = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    keyed = written(docs.select(*dict.fromkeys(["doc_id", *own]), fingerprint(F.col("text"), shingle).alias("_fp"), F.monotonically_increasing_id().alias("_row")), "fingerprints")
    prints = written(keyed.groupBy(F.col("_fp").alias("fp")).agg(F.min(ids).alias("first")), "prints")
    parts = written(connected_components(near_pairs(prints, bits), "a", "b"), "parts")
    rooted = prints.join(unsent(parts), prints["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("best"))
    names = written(rooted.join(unsent(named), "root").select(F.col("fp").alias("_fp"), F.col("best.id").alias("component_id"), F.col("best.row").alias("_best")), "names")
    return keyed.join(unsent(names), "_fp").select(*own, hex_digits(F.col("_fp")).alias("fingerprint"), "component_id", (F.col("_row") == F.col("_best")).alias("kept"))
