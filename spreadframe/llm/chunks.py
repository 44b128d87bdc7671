"""Chunks of a corpus that several passes read: bucketed tables, and compact arrays that travel between tasks."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shared import new_path

#: Characters of a chunk, about; one longer text is a chunk of its own.
CHUNK = 1 << 23
#: Buckets of a table at most.
BUCKETS = 50_000


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers of one length, byte planes apart, compressed."""
    raw = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for k, s in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[at : at + n * s].reshape(s, n).T).view(k).ravel())
        at += n * s
    return out


def edges(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(label, from, to) of the runs of a sorted array."""
    at = np.flatnonzero(np.diff(labels, prepend=-1)).tolist()
    return [(int(labels[a]), a, b) for a, b in zip(at, [*at[1:], len(labels)])]


def buckets_for(spark: SparkSession, volume: int) -> int:
    """Buckets for so many bytes of text: twice as many as chunks, so that few hold several."""
    return min(BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * (volume // CHUNK + 1)))


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``key`` without a shuffle before."""
    spark, name = df.sparkSession, f"chunks_{uuid.uuid4().hex}"
    df.write.option("path", new_path(spark, "chunks")).bucketBy(buckets, key).saveAsTable(name)

    def forget() -> None:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session may have ended, and the catalog with it
            pass

    atexit.register(forget)
    return spark.table(name)
