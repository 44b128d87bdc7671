"""Token-id files by a static range asymmetric numeral system.

All ids of a corpus share one table of frequencies. Documents stand in ascending order of
doc_id in chunks; a chunk's ids are coded in independent blocks. A block has many
interleaved coders (lanes) that share one stream of 32-bit words; every ``EVERY``
steps a checkpoint holds all lanes' states, the place in the stream and a checksum of the
ids up to the next, so a reader can start at any checkpoint and verify what it read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import new_path, written
from .bpe import encoder, portions

MAGIC = b"RNS1"
BITS = 18
LOW = np.uint64(1 << 31)
LANES = 2048
BLOCK = 1 << 19
EVERY = 128
#: A chunk closes with the document that brings it to so many ids.
CHUNK = 1 << 19
_HEAD = struct.Struct("<4sIII")
_POINT = struct.Struct("<II")


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Shares of 2**BITS by largest remainder; every id that occurs has at least one."""
    total, room = int(counts.sum()), 1 << BITS
    out = np.zeros(len(counts), dtype=np.int64)
    if not total:
        return out
    seen = np.flatnonzero(counts)
    exact = counts[seen] * (room - len(seen)) / total
    share = np.floor(exact).astype(np.int64)
    rest = room - len(seen) - int(share.sum())
    share[np.argsort(share - exact, kind="stable")[:rest]] += 1
    out[seen] = share + 1
    return out


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        # by slot: the id, its frequency, and the slot's place among the id's slots
        self.ids = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.uint32), freq)
        self.slot_freq = self.freq[self.ids]
        self.slot_place = np.arange(len(self.ids), dtype=np.uint64) - self.start[self.ids]


def encode_block(ids: np.ndarray, table: Table) -> bytes:
    n = len(ids)
    steps = -(-n // LANES)
    freq, start = table.freq[ids], table.start[ids]
    x = np.full(LANES, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    states: dict[int, np.ndarray] = {}
    for t in range(steps - 1, -1, -1):
        a, b = t * LANES, min(n, (t + 1) * LANES)
        now, f = x[: b - a], freq[a:b]
        full = now >= (f << np.uint64(63 - BITS))
        words.append((now[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        now[full] >>= np.uint64(32)
        q, r = np.divmod(now, f)
        x[: b - a] = (q << np.uint64(BITS)) + r + start[a:b]
        if t % EVERY == 0:
            states[t] = x.copy()
    words.reverse()
    ends = np.cumsum([0, *map(len, words)])
    points = []
    for t in range(0, steps, EVERY):
        part = ids[t * LANES : (t + EVERY) * LANES].astype("<u4")
        points.append(_POINT.pack(int(ends[t]), zlib.crc32(part.tobytes())) + states[t].astype("<u8").tobytes())
    return _HEAD.pack(MAGIC, n, len(points), int(ends[-1])) + b"".join(points) + (np.concatenate(words).tobytes() if words else b"")


def decode_from(block: bytes, table: Table, point: int) -> np.ndarray:
    """The ids from one checkpoint of a block up to the next, verified by their checksum."""
    magic, n, points, n_words = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    each = _POINT.size + 8 * LANES
    at, crc = _POINT.unpack_from(block, _HEAD.size + point * each)
    x = np.frombuffer(block, "<u8", LANES, _HEAD.size + point * each + _POINT.size).astype(np.uint64)
    words = np.frombuffer(block, "<u4", n_words, _HEAD.size + points * each).astype(np.uint64)
    first, last = point * EVERY * LANES, min(n, (point + 1) * EVERY * LANES)
    out = np.empty(last - first, dtype=np.uint32)
    mask, bits, word = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    for a in range(first, last, LANES):
        b = min(last, a + LANES)
        now = x[: b - a]
        slot = (now & mask).view(np.int64)
        out[a - first : b - first] = table.ids.take(slot)
        now = table.slot_freq.take(slot) * (now >> bits) + table.slot_place.take(slot)
        low = now < LOW
        k = int(low.sum())
        if k:
            now[low] = (now[low] << word) | words[at : at + k]
            at += k
        x[: b - a] = now
    if zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("a block of token ids is damaged")
    return out


def decode_block(block: bytes, table: Table) -> np.ndarray:
    points = _HEAD.unpack_from(block)[2]
    return np.concatenate([decode_from(block, table, k) for k in range(points)]) if points else np.empty(0, dtype=np.uint32)


_DOC = np.dtype([("known", "?"), ("doc", "<i8"), ("n", "<u4")])
_STAGED = "part int, seq int, n_tokens long, docs binary, ids binary, counts binary"
_FILES = "part int, seq int, n_tokens long, docs binary, blocks array<binary>"


def _staged(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, end = encoder(tokenizer).encode, np.array([end_id], dtype="<u4").tobytes()
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple] = []
        held: list[bytes] = []
        counts = np.zeros(0, dtype=np.int64)

        def frame(last: bool) -> pd.DataFrame:
            nonlocal counts
            ids = np.frombuffer(b"".join(held), "<u4")
            new = np.bincount(ids, minlength=len(counts))
            new[: len(counts)] += counts
            counts = new
            return pd.DataFrame({"counts": [counts.astype("<i8").tobytes() if last else None], "part": [part], "seq": [seq], "n_tokens": [len(ids)], "docs": [np.array(rows, dtype=_DOC).tobytes()], "ids": [ids.astype("<u2" if len(counts) <= 1 << 16 else "<u4").tobytes()]})

        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            for at, to in portions(texts):
                for doc, ids in zip(batch["doc_id"].iloc[at:to], encode(texts[at:to])):
                    ids += end
                    rows.append((False, 0, len(ids) // 4) if pd.isna(doc) else (True, int(doc), len(ids) // 4))
                    held.append(ids)
                    size += len(ids) // 4
                    if size >= CHUNK:
                        yield frame(False)
                        rows, held, size, seq = [], [], 0, seq + 1
        if rows or len(counts):
            yield frame(True)

    order = [F.col("doc_id"), F.xxhash64("text")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(texts.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(chunks, _STAGED), "ids")


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write the ids of ``docs`` (``doc_id``, ``text``) under ``path``: ``blocks`` and ``table``.

    Documents stand in ascending order of doc_id, nulls first and repeated ids by a hash
    of their texts; each is its ids and ``end_id``, so null and empty texts are one id.
    Other columns are ignored; an empty table gives files without blocks.
    """
    staged = _staged(docs, tokenizer, end_id)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["counts"]:
                each = np.frombuffer(raw, "<i8")
                seen = np.flatnonzero(each)
                yield pd.DataFrame({"id": seen, "n": each[seen]})

    counted = staged.where("counts is not null").select("counts").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 1, dtype=np.int64)
    counts[counted["id"].to_numpy(dtype=np.int64)] = counted["n"]
    freq = frequencies(counts)
    spark = docs.sparkSession
    raw = freq.astype("<u4").tobytes()
    spark.createDataFrame([(bytearray(raw), zlib.crc32(raw))], "freq binary, crc32 long").write.parquet(f"{path}/table")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Table(freq)
        for batch in batches:
            for r in batch.itertuples(index=False):
                ids = _ids(r.ids, r.n_tokens)
                blocks = [encode_block(ids[a : a + BLOCK], table) for a in range(0, len(ids), BLOCK)]
                yield pd.DataFrame({"part": [r.part], "seq": [r.seq], "n_tokens": [r.n_tokens], "docs": [r.docs], "blocks": [blocks]})

    staged.drop("counts").mapInPandas(encode, _FILES).write.option("compression", "none").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids (little-endian unsigned 32-bit)."""
    raw, crc = spark.read.parquet(f"{path}/table").first()
    if zlib.crc32(bytes(raw)) != crc:
        raise ValueError("the table of frequencies is damaged")
    freq = np.frombuffer(bytes(raw), "<u4").astype(np.int64)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Table(freq)
        for batch in batches:
            for r in batch.itertuples(index=False):
                docs = np.frombuffer(r.docs, dtype=_DOC)
                ids = np.concatenate([np.empty(0, dtype=np.uint32), *(decode_block(b, table) for b in r.blocks)]).astype("<u4")
                ends = np.cumsum(docs["n"].astype(np.int64))
                starts = ends - docs["n"]
                each = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
                out = {"part": r.part, "seq": r.seq, "doc_id": pd.array(np.where(docs["known"], docs["doc"], 0), dtype="Int64"), "before": starts, "n_tokens": docs["n"].astype(np.int64), "ids_crc32": [zlib.crc32(x) for x in each]}
                frame = pd.DataFrame(out | ({"ids": each} if with_ids else {}))
                frame.loc[~docs["known"], "doc_id"] = pd.NA
                yield frame

    blocks = spark.read.schema(_FILES).parquet(f"{path}/blocks")
    rows = blocks.mapInPandas(decode, "part int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    sizes = blocks.select("part", "seq", "n_tokens")
    by_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = by_part.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("part_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    starts = sizes.select("part", "seq", inside.alias("inside")).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("inside")).alias("first"))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_files_roundtrip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files to the shared folder and read them back, without the ids themselves."""
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path, with_ids=False)
