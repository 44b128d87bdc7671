"""Packing token sequences into windows: best-fit decreasing over remaining capacities.

Every document is tokenized where it is read. An overlong one is first cut into full
windows; what remains of each document is a piece shorter than a window. Pieces gather
into bins of some ten thousand and each bin is packed on its own, longest piece first,
into the open window with the least room that still holds it. A segment tree over the
remaining capacities 0 to ``window`` finds that window in log(window) steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written
from .bpe import encoder, portions

#: Pieces packed together; a bin of its own leaves at most a few windows with much room.
BIN = 16_384
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin string, local long, offset long"
PIECES_WITH_IDS = PIECES + ", ids binary"


class Capacities:
    """Open windows by remaining capacity; a segment tree of counts finds the tightest fit."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.tree = [0] * (2 * self.base)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, n: int) -> None:
        at = room + self.base
        while at:
            self.tree[at] += n
            at >>= 1

    def put(self, room: int, which: int) -> None:
        self.open[room].append(which)
        self._add(room, 1)

    def tightest(self, need: int) -> int:
        """The smallest room of at least ``need`` that an open window has, or -1."""
        at = need + self.base
        if self.tree[at]:
            return need
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.base
            at >>= 1
        return -1

    def take(self, room: int) -> int:
        self._add(room, -1)
        return self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Window number and offset of each piece, and how many windows there are."""
    rooms, used = Capacities(window), 0
    place, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        room = rooms.tightest(n)
        if room < 0:
            room, which, used = window, used, used + 1
        else:
            which = rooms.take(room)
        place[i], offset[i] = which, window - room
        if room > n:
            rooms.put(room - n, which)
    return place, offset, used


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, bin_size: int = BIN, with_ids: bool = False) -> DataFrame:
    """Pack the token ids of all documents into sequences of at most ``window`` ids.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. A document is its
    ids by the tokenizer file and then ``end_id``, so null and empty texts are one id.
    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id (0, 1, ... over all sequences), offset, and with ``with_ids`` the piece's
    ids as little-endian unsigned 32-bit integers. Repeated rows and null doc_ids are
    packed like any other row; an empty table gives no rows. Bins follow the partitions
    of the input, and are written to the shared folder before sequences are numbered.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, end = encoder(tokenizer).encode, np.array([end_id], dtype="<u4").tobytes()
        part, bins = TaskContext.get().partitionId(), 0
        rest: list[tuple] = []

        def frame(rows: list[tuple], name: str, local, offset) -> pd.DataFrame:
            doc, start, length, crc, total, ids = zip(*rows)
            out = {"doc_id": pd.array(doc, dtype="Int64"), "start": start, "length": length, "ids_crc32": crc, "doc_tokens": total, "bin": name, "local": local, "offset": offset}
            return pd.DataFrame(out | ({"ids": list(ids)} if with_ids else {}))

        def packed() -> pd.DataFrame:
            place, offset, _ = best_fit_decreasing([r[2] for r in rest], window)
            return frame(rest, f"{part}-{bins}", place, offset)

        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            for at, to in portions(texts):
                full = []
                for doc, ids in zip(batch["doc_id"].iloc[at:to], encode(texts[at:to])):
                    ids, doc = ids + end, None if pd.isna(doc) else int(doc)
                    n = len(ids) // 4
                    for s in range(0, n, window):
                        piece = ids[4 * s : 4 * (s + window)]
                        row = (doc, s, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else None)
                        (full if row[2] == window else rest).append(row)
                if full:
                    yield frame(full, f"{part}-{bins}-full", range(len(full)), 0)
                    bins += 1
                if len(rest) >= bin_size:
                    yield packed()
                    rest, bins = [], bins + 1
        if rest:
            yield packed()

    placed = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(pieces, PIECES_WITH_IDS if with_ids else PIECES), "pieces")
    # bins are as many as the input has tens of thousands of pieces; their running sum numbers the sequences
    bins = placed.groupBy("bin").agg((F.max("local") + 1).alias("n"))
    first = bins.select("bin", (F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("local")).alias("sequence_id"), "offset"]
    return placed.join(first, "bin").select(*cols, *(["ids"] if with_ids else []))
