"""Removal of passages that stand earlier in the corpus, over windows of a fixed number of words.

Texts are written once as chunks of some million characters, in a bucketed table that later
passes read without a shuffle. Each chunk makes a count-min sketch of its windows: the
counters it touches, cut into stripes, go to the stripe's task, which adds the sketches of
all chunks up and tells each chunk which of its counters reach two. The estimates are never
too low, so a window with an estimate of one occurs once. The others take a second, exact
pass: each chunk sends the 128-bit fingerprint and first place of each different one to a
task by fingerprint, which finds the first place of all and answers a bit for each.

Neither exchange grows with the copies within a chunk, a very common window is one entry
a chunk, and the sketch is never whole in one place: its width follows the size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .chunks import CHUNK, bucketed, buckets_for, edges, squeeze, unsqueeze

#: Rows of the sketch (hash functions), counters in a row for each six bytes of text, and counters of a stripe.
DEPTH, SPARE, STRIPE = 2, 8, 1 << 26
#: Windows of the input for each task of the exact pass.
EXACT = 1 << 22
# odd multipliers of the mixes; fixed values
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


# --- words and windows of a chunk


def pack(ids: list, texts: list[bytes]) -> bytes:
    """Documents of a chunk in ascending order of their ids, nulls last, as a compressed Arrow stream."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    batch = pa.record_batch([pa.array([ids[i] for i in order], pa.int64()), pa.array([texts[i] for i in order], pa.large_binary())], ["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _mixed(a: np.ndarray, b: np.ndarray, by: np.uint64) -> np.ndarray:
    """One hash of two in order."""
    out = (a ^ (b >> np.uint64(31)) ^ (b << np.uint64(33))) * by
    out ^= out >> np.uint64(29)
    return out + b


class Chunk:
    """Words of a chunk's documents in one list, with the hashes of all windows inside a document."""

    def __init__(self, body: bytes):
        from xxhash import xxh64_intdigest

        table = pa.ipc.open_stream(body).read_all()
        self.ids = table["doc_id"].to_pylist()
        self.words: list[bytes] = []
        ends = []
        for text in table["text"]:
            self.words += text.as_py().split()
            ends.append(len(self.words))
        self.ends = np.array(ends, dtype=np.int64)
        self.begins = np.concatenate(([0], self.ends[:-1]))
        self.hashes = np.fromiter(map(xxh64_intdigest, self.words), dtype=np.uint64, count=len(self.words))

    def windows(self, size: int) -> None:
        """Sets ``starts`` (word numbers) and ``keys`` (two 64-bit hashes) of the windows of ``size`` words."""
        keep = np.zeros(len(self.words) + 1, dtype=np.int32)
        longer = self.ends - self.begins >= size
        np.add.at(keep, self.begins[longer], 1)
        np.add.at(keep, self.ends[longer] - size + 1, -1)
        self.starts = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
        self.keys = [self._rolled(size, m)[self.starts] if len(self.starts) else np.zeros(0, np.uint64) for m in MIX[:2]]

    def _rolled(self, size: int, by: np.uint64) -> np.ndarray:
        # runs of 1, 2, 4, ... words; a window is put together from the runs of its binary digits
        run, length, out, done = self.hashes * by, 1, None, 0
        while True:
            if size & length:
                out = run if out is None else _mixed(out[: len(run) - done], run[done:], by)
                done += length
            length *= 2
            if length > size:
                return out
            run = _mixed(run[: len(run) - length // 2], run[length // 2 :], by)

    def cells(self, width: int) -> np.ndarray:
        """The counter of each window in each row of the sketch (row x window)."""
        rows = []
        for r in range(DEPTH):
            h = (self.keys[0] ^ (self.keys[1] >> np.uint64(r + 1))) * MIX[2 + r % 2] + np.uint64(r)
            rows.append(((h ^ (h >> np.uint64(32))) & np.uint64(width - 1)) + np.uint64(r * width))
        return np.array(rows, dtype=np.uint64).reshape(DEPTH, len(self.starts))


def _bits(replies: pd.DataFrame) -> np.ndarray:
    """Answers to a chunk in the order of its stripes."""
    rows = replies.sort_values("stripe")
    parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(rows["body"], rows["n"])]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, dtype=bool)


# --- the passes

SENT = "chunk long, stripe long, n long, body binary"


def _touched(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The different counters of a chunk in order, and whether it touches one more than once."""
    cells = np.sort(chunk.cells(width).ravel())
    new = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.zeros(0, np.int64)
    return cells[new], np.diff(np.append(new, len(cells))) > 1


def sketch_rows(chunk: Chunk, number: int, width: int) -> Iterator[tuple]:
    """A chunk's sketch by stripe: gaps between its counters, and which it touches twice or more."""
    cells, twice = _touched(chunk, width)
    for stripe, a, b in edges((cells // np.uint64(STRIPE)).astype(np.int64)):
        local = (cells[a:b] - np.uint64(stripe * STRIPE)).astype(np.uint32)
        yield number, stripe, b - a, squeeze(np.diff(local, prepend=np.uint32(0)), twice[a:b].astype(np.uint8))


def merge_sketches(rows: pd.DataFrame) -> pd.DataFrame:
    """Adds up the sketches of one stripe, up to two, and answers each chunk a bit for each of its counters."""
    counts, parts = np.zeros(STRIPE, dtype=np.uint8), []
    for body in rows["body"]:
        gaps, twice = unsqueeze(body, "u4", "u1")
        cells = np.cumsum(gaps, dtype=np.int64)
        counts[cells] = np.minimum(counts[cells] + 1 + twice, 2)
    for body in rows["body"]:
        parts.append(np.packbits(counts[np.cumsum(unsqueeze(body, "u4", "u1")[0], dtype=np.int64)] > 1).tobytes())
    return rows.assign(body=parts)


def _candidates(chunk: Chunk, width: int, replies: pd.DataFrame) -> np.ndarray:
    """Places in ``chunk.starts`` of the windows whose smallest counter reaches two."""
    cells, _ = _touched(chunk, width)
    often = cells[_bits(replies)]
    if not len(often):
        return np.zeros(0, dtype=np.int64)
    left = np.arange(len(chunk.starts))
    for row in chunk.cells(width):
        mine = row[left]
        at = np.minimum(np.searchsorted(often, mine), len(often) - 1)
        left = left[often[at] == mine]
    return left


class Entries:
    """The different candidate windows of a chunk by fingerprint, each with its first place."""

    def __init__(self, chunk: Chunk, places: np.ndarray):
        a, b = (k[places] for k in chunk.keys)
        order = np.lexsort((places, b, a))
        a, b, self.places = a[order], b[order], places[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, dtype=bool)
        self.a, self.b, self.entry, self.first = a[new], b[new], np.cumsum(new) - 1, self.places[new]


def entry_rows(chunk: Chunk, number: int, width: int, replies: pd.DataFrame, tasks: int) -> Iterator[tuple]:
    e = Entries(chunk, _candidates(chunk, width, replies))
    start = chunk.starts[e.first]
    doc = np.searchsorted(chunk.ends, start, side="right")
    none = np.array([i is None for i in chunk.ids], dtype=np.uint8)
    ids = np.array([i or 0 for i in chunk.ids], dtype=np.int64)
    stripes = (e.a >> np.uint64(32)) * np.uint64(tasks) >> np.uint64(32)
    for stripe, a, b in edges(stripes.astype(np.int64)):
        d = doc[a:b]
        yield number, stripe, b - a, squeeze(e.a[a:b], e.b[a:b], none[d], ids[d], (start[a:b] - chunk.begins[d]).astype(np.int64))


def first_places(rows: pd.DataFrame) -> pd.DataFrame:
    """Answers each chunk which of its entries stand first of all with their fingerprint."""
    parts = [unsqueeze(b, "u8", "u8", "u1", "i8", "i8") for b in rows["body"]]
    a, b, none, ids, start = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, ids, none, b, a))
    new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
    best = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    first = np.empty(len(a), dtype=bool)
    # rows that share a doc_id may both hold the first place
    first[order] = (none[order] == none[best]) & (ids[order] == ids[best]) & (start[order] == start[best])
    out, at = [], 0
    for n in rows["n"]:
        out.append(np.packbits(first[at : at + n]).tobytes())
        at += n
    return rows.assign(body=out)


def kept_words(chunk: Chunk, width: int, size: int, replies: pd.DataFrame, firsts: pd.DataFrame) -> pd.DataFrame:
    """A row for each document of a chunk: its words, how many go, and the text of the rest."""
    e = Entries(chunk, _candidates(chunk, width, replies))
    gone = np.ones(len(e.places), dtype=bool)
    # a chunk's own first of an entry stays if it is the first of all; others of the entry always go,
    # but for rows that share its doc_id and place
    ahead = _bits(firsts)
    start = chunk.starts[e.places]
    doc = np.searchsorted(chunk.ends, start, side="right")
    same = np.array([(i is None, i or 0) for i in chunk.ids], dtype=[("none", "?"), ("id", "i8")])
    lead = chunk.starts[e.first][e.entry]
    head = np.searchsorted(chunk.ends, lead, side="right")
    stays = ahead[e.entry] & (same[doc] == same[head]) & (start - chunk.begins[doc] == lead - chunk.begins[head]) if len(start) else gone
    gone &= ~stays
    cover = np.zeros(len(chunk.words) + 1, dtype=np.int64)
    np.add.at(cover, start[gone], 1)
    np.add.at(cover, start[gone] + size, -1)
    removed = np.cumsum(cover[:-1]) > 0
    sums = np.concatenate(([0], np.cumsum(removed)))
    lost = sums[chunk.ends] - sums[chunk.begins]
    texts = []
    for a, b, n in zip(chunk.begins.tolist(), chunk.ends.tolist(), lost.tolist()):
        words = chunk.words[a:b]
        texts.append(b" ".join([words[i] for i in np.flatnonzero(~removed[a:b]).tolist()] if n else words).decode("utf-8"))
    return pd.DataFrame({"doc_id": pd.array(chunk.ids, dtype="Int64"), "n_words": chunk.ends - chunk.begins, "n_removed": lost, "kept": texts})


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words joined by one space) of each document.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. A word goes if a window of
    ``window`` words over it also starts earlier: in a document with a smaller doc_id, or in
    the same one before. Windows are judged on the input. Null and empty texts have no words;
    texts shorter than a window lose none; long texts are whole in one task. Null doc_ids come
    last and count as one document, as do rows that share a doc_id: of two windows at the
    same start of such rows neither is earlier, so repeated rows fare alike. Equality of windows
    is equality of 128-bit hashes. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    volume = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    windows = volume // 6 + 1
    width = 1 << max(10, (SPARE * windows - 1).bit_length())
    tasks = windows // EXACT + 1

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids.append(None if pd.isna(doc) else int(doc))
                texts.append(bytes(text))
                size += len(texts[-1])
                if size >= CHUNK:
                    yield pd.DataFrame({"chunk": [number], "body": [pack(ids, texts)]})
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield pd.DataFrame({"chunk": [number], "body": [pack(ids, texts)]})

    def framed(rows: Iterator[tuple]) -> pd.DataFrame:
        return pd.DataFrame(list(rows), columns=["chunk", "stripe", "n", "body"])

    def opened(body: bytes) -> Chunk:
        chunk = Chunk(body)
        chunk.windows(window)
        return chunk

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, body in zip(batch["chunk"], batch["body"]):
                yield framed(sketch_rows(opened(body), number, width))

    def exact(key: tuple, texts: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        parts = [framed(entry_rows(opened(body), key[0], width, replies, tasks)) for body in texts["body"]]
        return pd.concat(parts) if parts else framed(iter(()))

    def apply(key: tuple, texts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        parts = [kept_words(opened(body), width, window, answers[answers["kind"] == 0], answers[answers["kind"] == 1]) for body in texts["body"]]
        return pd.concat(parts) if parts else pd.DataFrame({"doc_id": pd.array([], dtype="Int64"), "n_words": [], "n_removed": [], "kept": []})

    table = bucketed(own.mapInPandas(chunks, "chunk long, body binary"), "chunk", buckets_for(spark, volume))
    often = written(table.mapInPandas(sketched, SENT).groupBy("stripe").applyInPandas(merge_sketches, SENT), "often")
    entries = table.groupBy("chunk").cogroup(often.groupBy("chunk")).applyInPandas(exact, SENT)
    first = written(entries.groupBy("stripe").applyInPandas(first_places, SENT), "first")
    answers = often.withColumn("kind", F.lit(0)).unionByName(first.withColumn("kind", F.lit(1)))
    return table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(apply, "doc_id long, n_words long, n_removed long, kept string")
