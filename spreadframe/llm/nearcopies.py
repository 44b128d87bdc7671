"""Near copies by SimHash fingerprints, checked and completed by exact Jaccard similarity of word shingles.

Texts whose fingerprints link are compared first, which joins most copies. Fingerprints miss copies of that
similarity, so the rest is found through prefix filtering. Two sets of Jaccard similarity t share at least t times the larger one's size, so they share
one of the first (1 - t) of each set in any fixed order of the shingles. Documents meet in the
buckets of those first shingles, in the order of how many texts of the whole corpus hold them, by a count-min
sketch whose stripes are added up apart. A pair that meets in too few of them, or too late in their order,
to share enough is left out, and the others are verified by their whole sets, so none is
missed. Equal texts are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..shared import drop_table, unsent, written
from .chunks import CHUNK, bucketed, buckets_for, edges, squeeze, unsqueeze
from .simhash import SLAB, fingerprint, near_pairs

#: Least similarity, as a fraction, so that it is compared in whole numbers.
LEAST = (4, 5)
#: Characters of a chunk, about, rows of the sketch, counters in a row for each six bytes of text, and counters of a stripe.
PART, DEPTH, SPARE, STRIPE = CHUNK >> 1, 2, 4, 1 << 25
#: Times that texts are compared with one other before any two of a bucket are.
HUBS, STRAGGLERS = 3, 2
#: Counts end here, which is far above what an order of shingles needs.
FULL = 65_535
# odd multipliers of the mixes; fixed values
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words are one shingle, none give none."""
    from xxhash import xxh64_intdigest as h

    words = text.lower().split() if text else []
    if len(words) <= shingle:
        return np.array([h(b" ".join(words), 42)] if words else [], dtype="<u8").view("<i8")
    parts = []
    for at in range(0, len(words) - shingle + 1, SLAB):
        part = words[at : at + SLAB + shingle - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        m = len(part) - shingle + 1
        parts.append(np.unique(np.array([h(line[a:b], 42) for a, b in zip(starts[:m].tolist(), (ends[shingle - 1 :] - 1).tolist())], dtype="<u8").view("<i8")))
    return np.unique(np.concatenate(parts))


def _key(text: Column) -> Column:
    def keys(texts: pd.Series) -> pd.Series:
        from xxhash import xxh3_64_intdigest

        whole = [xxh3_64_intdigest(b" ".join(t.lower().split()) if t else b"") for t in texts]
        return pd.Series(np.array(whole, dtype="<u8").view("<i8"))

    return F.pandas_udf(keys, "long")(text)


def _pack(keys: list[int], texts: list[bytes]) -> bytes:
    """Texts of a chunk, each once, as a compressed Arrow stream."""
    once = dict(zip(keys, texts))
    batch = pa.record_batch([pa.array(once.keys(), pa.int64()), pa.array(once.values(), pa.large_binary())], ["key", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


class Shingled:
    """The shingle sets of a chunk's texts, and the counters of a sketch that they touch."""

    def __init__(self, body: bytes, shingle: int, width: int):
        table = pa.ipc.open_stream(body).read_all()
        self.keys = table["key"].to_pylist()
        self.sets = [_hashes(t.as_py(), shingle) for t in table["text"]]
        self.grams, self.counts = np.unique(np.concatenate([np.zeros(0, np.int64), *self.sets]), return_counts=True)
        raw, rows = self.grams.view(np.uint64), []
        for r in range(DEPTH):
            h = raw * MIX[r % 2] + np.uint64(r)
            h ^= h >> np.uint64(31)
            rows.append((h & np.uint64(width - 1)) + np.uint64(r * width))
        self.places = np.concatenate(rows)
        self.cells, self.at = np.unique(self.places, return_inverse=True)

    def sketch(self, number: int) -> Iterator[tuple]:
        held = np.minimum(np.bincount(self.at, weights=np.tile(self.counts, DEPTH), minlength=len(self.cells)), FULL).astype("u2")
        for stripe, a, b in edges((self.cells // np.uint64(STRIPE)).astype(np.int64)):
            local = (self.cells[a:b] - np.uint64(stripe * STRIPE)).astype(np.uint32)
            yield number, stripe, b - a, squeeze(np.diff(local, prepend=np.uint32(0)), held[a:b])

    def prefixes(self, replies: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
        """gram, node, size, pos of the first shingles of each text, rare ones first; those of one text alone are left out, but count in ``pos``."""
        parts = [unsqueeze(b, "u2")[0] for b in replies.sort_values("stripe")["body"]]
        total = np.concatenate(parts)[self.at].reshape(DEPTH, -1).min(axis=0) if parts else np.zeros(0, "u2")
        out = [(np.zeros(0, np.int64),) * 4]
        for key, s in zip(self.keys, self.sets):
            if len(s):
                often = total[np.searchsorted(self.grams, s)]
                order = np.argsort(often, kind="stable")[: len(s) - -(-num * len(s) // den) + 1]
                pos = np.flatnonzero(often[order] > 1)
                out.append((s[order][pos], np.full(len(pos), key), np.full(len(pos), len(s)), pos))
        return pd.DataFrame(dict(zip(("gram", "node", "size", "pos"), map(np.concatenate, zip(*out)))))


def merge_counts(rows: pd.DataFrame) -> pd.DataFrame:
    """Adds up one stripe of all chunks' sketches and gives each chunk the sums of its counters."""
    counts, parts = np.zeros(STRIPE, dtype=np.uint16), []
    for body in rows["body"]:
        gaps, held = unsqueeze(body, "u4", "u2")
        cells = np.cumsum(gaps, dtype=np.int64)
        counts[cells] = np.minimum(counts[cells].astype(np.uint32) + held, FULL)
    for body in rows["body"]:
        parts.append(squeeze(counts[np.cumsum(unsqueeze(body, "u4", "u2")[0], dtype=np.int64)]))
    return rows.assign(body=parts)


def _prefixes(texts: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """gram, node, size, pos: the first shingles of each text, rare ones of the whole corpus first, and their places from 0.

    How many texts hold a shingle is estimated by a count-min sketch of all texts, whose stripes are
    added up apart; an estimate of one is sure, and such a shingle meets nobody. The estimate is the same
    wherever a shingle stands, so all texts keep to one order.
    """
    spark, (num, den) = texts.sparkSession, least
    volume = texts.agg(F.sum(F.octet_length("_bytes"))).first()[0] or 0
    width = 1 << max(10, (SPARE * (volume // 6 + 1) - 1).bit_length())

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, keys, held, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for key, text in zip(batch["_key"].tolist(), batch["_bytes"]):
                keys.append(key)
                held.append(bytes(text) if text is not None else b"")
                size += len(held[-1])
                if size >= PART:
                    yield pd.DataFrame({"chunk": [number], "body": [_pack(keys, held)]})
                    number, keys, held, size = number + 1, [], [], 0
        if keys:
            yield pd.DataFrame({"chunk": [number], "body": [_pack(keys, held)]})

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, body in zip(batch["chunk"], batch["body"]):
                yield pd.DataFrame(list(Shingled(body, shingle, width).sketch(number)), columns=["chunk", "stripe", "n", "body"])

    def first(key: tuple, bodies: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        parts = [Shingled(body, shingle, width).prefixes(replies, num, den) for body in bodies["body"]]
        return pd.concat(parts) if parts else pd.DataFrame({"gram": [], "node": [], "size": [], "pos": []})

    sent = "chunk long, stripe long, n long, body binary"
    table = bucketed(texts.mapInPandas(chunks, "chunk long, body binary"), "chunk", buckets_for(spark, 2 * volume))
    sums = written(table.mapInPandas(sketched, sent).groupBy("stripe").applyInPandas(merge_counts, sent), "counts")
    rows = written(table.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInPandas(first, "gram long, node long, size int, pos int").distinct(), "prefixes")
    for used in (table, sums):
        drop_table(used)
    return rows


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, least: tuple[int, int], name: str) -> DataFrame:
    """The pairs ``a, b`` whose whole shingle sets reach the least similarity."""
    # written first, so that its size is known and whole texts are not shuffled for a list that Spark would broadcast
    nodes = written(pairs.select(F.col("a").alias("_key")).union(pairs.select(F.col("b").alias("_key"))).distinct(), "nodes")
    num, den = least

    def sets(of: pd.Series) -> pd.Series:
        return pd.Series([_hashes(t, shingle).tobytes() for t in of])

    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(den * both >= num * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    one = texts.join(nodes, "_key").dropDuplicates(["_key"])
    held = written(one.select("_key", F.pandas_udf(sets, "binary")(F.col("_bytes")).alias("held")), "sets")
    both = pairs.join(held.select(F.col("_key").alias("a"), F.col("held").alias("x")), "a").join(held.select(F.col("_key").alias("b"), F.col("held").alias("y")), "b")
    out = written(both.where(F.pandas_udf(alike, "boolean")(F.col("x"), F.col("y"))).select("a", "b"), name)
    for used in (nodes, held):
        drop_table(used)
    return out


def _simhash_pairs(texts: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of ``_key``s whose SimHash fingerprints link as in :mod:`simhash`, one text standing for each fingerprint; its others meet that one."""
    prints = written(texts.select("_key", fingerprint(F.col("_bytes")).alias("fp")).distinct(), "prints")
    lead = written(prints.groupBy("fp").agg(F.min("_key").alias("one")), "leads")
    same = prints.join(unsent(lead), "fp").select(F.col("one").alias("a"), F.col("_key").alias("b")).where("a < b")
    at = lambda side: lead.select(F.col("fp").alias(side), F.col("one").alias(f"one_{side}"))
    near = near_pairs(lead).join(at("a"), "a").join(at("b"), "b")
    out = written(same.unionByName(near.select(F.least("one_a", "one_b").alias("a"), F.greatest("one_a", "one_b").alias("b"))), "simhash")
    for used in (prints, lead):
        drop_table(used)
    return out


def near_copy_links(texts: DataFrame, shingle: int = 5, least: tuple[int, int] = LEAST) -> DataFrame:
    """Pairs ``a, b`` of ``_key``s that join all texts (``_key``, ``_bytes``) of at least the similarity into components.

    First come the pairs that SimHash fingerprints link, each verified. Near copies that those miss are then found, a few times,
    by dealing texts by one of their first shingles and comparing them with one
    text of those, which joins the copies of a group at a cost that grows with the texts alone; then any two of a bucket that are not in one component
    by then; a pair left out is in one component already.
    A bucket holds the texts that share a shingle which is among the rarest of each. The first shingle that two texts share is met
    at such places in both that enough of either is left to reach the similarity; two that meet only later are not compared.
    """
    num, den = least
    rows = _prefixes(texts, shingle, least)

    def mixed_in(of: DataFrame) -> DataFrame:
        """Rows of the buckets that hold more than one component."""
        several = of.groupBy("gram").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("gram")
        return of.join(several, "gram", "left_semi")

    def regrouped() -> DataFrame:
        parts = written(connected_components(links, "a", "b"), "parts")
        placed = written(shared.drop("part").join(parts, "node", "left").select("gram", "node", "size", "pos", F.coalesce("component", "node").alias("part")), "placed")
        out = written(mixed_in(placed), "mixed")
        for used in (parts, placed):
            drop_table(used)
        return out

    shared = written(mixed_in(rows.withColumn("part", F.col("node"))), "shared")
    drop_table(rows)
    # what two sets can share if they share nothing before the places x_pos and y_pos, against what the similarity asks for
    fits = (num + den) * F.least(F.col("x") - F.col("x_pos"), F.col("y") - F.col("y_pos")) >= num * (F.col("x") + F.col("y"))

    def close(met: DataFrame) -> DataFrame:
        # the shared shingles that pass come before all others, so these and what follows the last of them are all
        last = (F.max(c).alias(c) for c in ("x_pos", "y_pos"))
        counted = met.where(fits).groupBy("a", "b").agg(F.count("*").alias("n"), F.first("x").alias("x"), F.first("y").alias("y"), *last)
        after = F.least(F.col("x") - F.col("x_pos"), F.col("y") - F.col("y_pos")) - 1
        return counted.where((num + den) * (F.col("n") + after) >= num * (F.col("x") + F.col("y"))).select("a", "b")

    tested = _simhash_pairs(texts)
    links = _verified(tested, texts, shingle, least, "links")
    mixed = regrouped()
    for turn in range(HUBS + STRAGGLERS):
        if turn < HUBS:
            # near copies share most of their first shingles, so mostly also the one that comes first in yet another order
            lead = mixed.groupBy("node", "size", "part").agg(F.min(F.struct(F.xxhash64("gram", F.lit(turn)).alias("at"), "pos")).alias("m")).select("node", "size", "part", "m.at", "m.pos")
            hub = lead.groupBy("at").agg(F.min(F.struct("pos", "node", "size", "part")).alias("hub"))
        else:
            # stragglers meet one text of the component that most of a bucket's texts are in
            lead = mixed.withColumnRenamed("gram", "at")
            held = lead.groupBy("at", "part").agg(F.count("*").alias("n"), F.min(F.struct("pos", "node", "size", "part")).alias("one"))
            hub = held.groupBy("at").agg(F.max_by("one", F.struct("n", "part")).alias("hub"))
        met = lead.join(unsent(hub), "at").where(F.col("part") != F.col("hub.part")).select(
            F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b"), F.col("node").alias("own"),
            F.col("hub.size").alias("x"), F.col("size").alias("y"), F.col("hub.pos").alias("x_pos"), F.col("pos").alias("y_pos"),
        )
        often = met.where(fits).groupBy("a", "b", "own").agg(F.count("*").alias("n"))
        nearest = often.groupBy("own").agg(F.max_by(F.struct("a", "b"), F.struct("n", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b").distinct()
        nearest = written(nearest.join(tested, ["a", "b"], "left_anti"), "nearest")
        found = _verified(nearest, texts, shingle, least, "found")
        old = (tested, links, mixed, nearest, found)
        tested = written(tested.unionByName(nearest), "tested")
        links = written(links.unionByName(found), "links")
        mixed = regrouped()
        for used in old:
            drop_table(used)
    a, b = (mixed.select("gram", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "size", "pos", "part"))) for s in "ab")
    rest = a.join(unsent(b), "gram").where((F.col("node_a") < F.col("node_b")) & (F.col("part_a") != F.col("part_b")))
    named = (F.col(c).alias(n) for c, n in (("node_a", "a"), ("node_b", "b"), ("size_a", "x"), ("size_b", "y"), ("pos_a", "x_pos"), ("pos_b", "y_pos")))
    rest = written(close(rest.select(*named)).join(tested, ["a", "b"], "left_anti"), "rest")
    last = _verified(rest, texts, shingle, least, "links")
    for used in (shared, mixed, tested, rest):
        drop_table(used)
    return links.unionByName(last)


def near_copy_groups(docs: DataFrame, shingle: int = 5, least: tuple[int, int] = LEAST) -> DataFrame:
    """``docs`` with component_id and kept, where links are texts of at least the Jaccard similarity.

    Words lie between ASCII white space, A-Z lower-cased; a text with fewer words than a
    shingle is one shingle, and texts without words (null, empty) are equal. component_id and kept are
    as in :func:`simhash.simhash_groups`; columns of these names are replaced, long texts are read whole,
    of repeated rows one is kept, and an empty table gives no rows.
    """
    own = [c for c in docs.columns if c not in ("component_id", "kept", "_key", "_row")]
    ids = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    keyed = written(docs.select(*own, _key(F.col("text").cast("string").cast("binary")).alias("_key"), F.monotonically_increasing_id().alias("_row")), "keyed")
    texts = keyed.select("_key", F.col("text").cast("string").cast("binary").alias("_bytes"))
    firsts = written(keyed.groupBy("_key").agg(F.min(ids).alias("first")), "firsts")
    parts = written(connected_components(near_copy_links(texts, shingle, least), "a", "b"), "parts")
    rooted = firsts.join(unsent(parts), firsts["_key"] == parts["node"], "left").select("_key", "first", F.coalesce("component", "_key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("best"))
    names = written(rooted.join(unsent(named), "root").select("_key", F.col("best.id").alias("component_id"), F.col("best.row").alias("_best")), "names")
    return keyed.join(unsent(names), "_key").select(*own, "component_id", (F.col("_row") == F.col("_best")).alias("kept"))
