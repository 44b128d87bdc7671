"""Alignment of two tokenizers' tokens by the bytes they stand for.

Tokens of both sides that end at the same byte close a group, and a group's last two tokens
are linked. How often a pair of ids is linked in the whole corpus is counted in dense
matrices: a stripe is the second side's ids of one remainder against all first ids, which
is a block of bounded size. Chunks of documents send a stripe the counts of their different
pairs; the stripe's block adds them up (``np.add.at``), its row maxima are the best counts, and
each chunk gets its own pairs' counts back. A chunk's links lie in a bucketed table and are
scored where they lie. Chunks are dealt to salted parts of a stripe first, so neither a
common id nor a large corpus makes a task's input grow.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .bpe import Encoder
from .chunks import CHUNK, bucketed, buckets_for, edges, squeeze, unsqueeze

#: Stripes of the count matrix, by the second side's ids.
STRIPES = 250
#: Chunks that a task adds up at once, about.
FOLD = 256
#: Words of the second side remembered by a Python worker.
WORDS = 300_000
#: Characters of a chunk; the different pairs of a chunk are few, so its size matters for memory alone.
PART = CHUNK >> 2
MARK = "▁"

_sides: dict[tuple[str, str], tuple["FirstSide", "SecondSide"]] = {}


def byte_of_character() -> dict[str, int]:
    """Byte-level tokenizers write printable bytes as themselves and the others as characters from 256 up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class FirstSide:
    """A byte-level tokenizer file: ids of ``space + text`` and each id's bytes."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        tokenizer, back = self.encoder.tokenizer, byte_of_character()
        names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        self.signs: pa.Array | None = None
        self.bytes_of = pa.array([bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in names], pa.large_binary())
        self.lengths = pc.binary_length(self.bytes_of).to_numpy()

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encoder.encode([" " + t for t in texts])


class SecondSide:
    """A piece model with byte fallback that puts a space before the text.

    No piece crosses a single space between other characters, if the model has none with a
    space mark after anything but space marks; then a text's ids are those of its words.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = not any(MARK in t.lstrip(MARK) for t in names)
        self.bytes_of = pa.array([bytes([int(t[3:5], 16)]) if self.model.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(names)], pa.large_binary())
        self.lengths = pc.binary_length(self.bytes_of).to_numpy()
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        lists = self.model.encode(texts, num_threads=1)
        raw = np.fromiter(chain.from_iterable(lists), dtype="<u4").tobytes()
        ends = (4 * np.cumsum([0, *map(len, lists)])).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        # runs of spaces, and spaces at the ends, are pieces of several spaces
        loose = re.compile(rf"  |^ | \Z|{MARK}|^\Z")
        apart = [i for i, t in enumerate(texts) if not self.by_word or loose.search(t)]
        out = dict(zip(apart, self._ids([texts[i] for i in apart])))
        split = pc.split_pattern(pa.array([t if i not in out else "" for i, t in enumerate(texts)], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > WORDS:
            self.known = {}
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, self._ids(new)))
        joined = pa.array([self.known[w] for w in words], pa.large_binary()).take(coded.indices)
        _, offsets, ids = joined.buffers()
        cuts = np.frombuffer(offsets, "<i8", len(joined) + 1)[split.offsets.to_numpy()].tolist()
        ids = ids.to_pybytes() if ids else b""
        return [out[i] if i in out else ids[a:b] for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def sides(first: str, second: str) -> tuple[FirstSide, SecondSide]:
    """Both sides, once for each pair of files and Python worker."""
    if (first, second) not in _sides:
        _sides[first, second] = FirstSide(first), SecondSide(second)
    return _sides[first, second]


def _joined(table: pa.Array, ids: np.ndarray, counts: np.ndarray) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """Entries of ``table`` one after the other, where each entry ends, and where each document ends."""
    out = table.take(pa.array(ids))
    _, offsets, data = out.buffers()
    ends = np.frombuffer(offsets, "<i8", len(out) + 1)
    return memoryview(data).cast("B") if data else memoryview(b""), ends[1:], ends[np.cumsum(counts)]


class Aligned:
    """Groups and links of a chunk's texts; a text whose tokens do not give its bytes back has none."""

    def __init__(self, texts: list[str | None], first: FirstSide, second: SecondSide):
        full = [t or "" for t in texts]
        a, b = first.encode(full), second.encode(full)
        spaced = [b" " + t.encode() for t in full]
        good = []
        for side, ids in ((first, a), (second, b)):
            data, _, ends = _joined(side.bytes_of, np.frombuffer(b"".join(ids), "<u4"), np.array([len(i) // 4 for i in ids], dtype=np.int64))
            good.append([data[x:y] == t for x, y, t in zip([0, *ends.tolist()], ends.tolist(), spaced)])
        fits = [bool(t) and x and y for t, x, y in zip(texts, *good)]
        a, b = ([i if f else b"" for i, f in zip(ids, fits)] for ids in (a, b))
        self.n_a, self.n_b = (np.array([len(i) // 4 for i in ids], dtype=np.int64) for ids in (a, b))
        self.a, self.b = (np.frombuffer(b"".join(ids), "<u4") for ids in (a, b))
        ends_a, ends_b = np.cumsum(first.lengths[self.a]), np.cumsum(second.lengths[self.b])
        # both sides hold the same bytes, so ends compare across the whole chunk
        at = np.searchsorted(ends_b, ends_a)
        shared = ends_b[at] == ends_a if len(ends_b) else np.zeros(0, dtype=bool)
        self.last_a, self.last_b = np.flatnonzero(shared), at[shared]
        self.doc = np.searchsorted(np.cumsum(self.n_a), self.last_a, side="right")
        self.n_groups = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)

    def groups(self, first: FirstSide, second: SecondSide) -> list[str]:
        """Each text's groups: ``a1,a2|b1;a3|b2,b3``."""
        na, nb = len(self.a), len(self.b)
        if not na:
            return [""] * len(self.n_a)
        if first.signs is None or len(first.signs) != 2 * len(first.bytes_of) + 3 * len(second.bytes_of):
            first.signs = pa.array([f"{i}{sign}" for n, ends in ((len(first.bytes_of), ",|"), (len(second.bytes_of), (",", ";", ""))) for sign in ends for i in range(n)], pa.large_string())
        end_a, end_b = np.zeros(na, dtype=np.int32), np.zeros(nb, dtype=np.int32)
        end_a[self.last_a] = end_b[self.last_b] = 1
        group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        before = np.concatenate(([0], self.last_b + 1))
        order = np.empty(na + nb, dtype=np.int32)
        end_b[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 2
        order[np.arange(na) + before[group_a]] = self.a.astype(np.int32) + end_a * len(first.bytes_of)
        order[np.arange(nb) + self.last_a[group_b] + 1] = self.b.astype(np.int32) + 2 * len(first.bytes_of) + end_b * len(second.bytes_of)
        data, _, ends = _joined(first.signs, order, self.n_a + self.n_b)
        return [str(data[x:y], "ascii") for x, y in zip([0, *ends.tolist()], ends.tolist())]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The different linked pairs by stripe, second and first id, their counts, and the pair of each link."""
        a, b = self.a[self.last_a].astype(np.int64), self.b[self.last_b].astype(np.int64)
        link, key = pd.factorize((b % STRIPES) << 48 | (b // STRIPES) << 32 | a)
        order = np.argsort(key)
        place = np.empty(len(key), dtype=np.int64)
        place[order] = np.arange(len(key))
        key, link = key[order], place[link]
        n = np.bincount(link, minlength=len(key))
        return key & 0xFFFFFFFF, ((key >> 32) & 0xFFFF) * STRIPES + (key >> 48), n.astype(np.int64), link


TABLE = "chunk long, stripe int, n long, body binary, doc_id long, n_a long, n_b long, n_groups long, groups string"
SENT = "chunk long, stripe int, n long, body binary"


def add_up(rows: pd.DataFrame, ids: int) -> tuple[np.ndarray, np.ndarray]:
    """A stripe's dense block of link counts (second id x first id) from packed pairs."""
    parts = [unsqueeze(b, "u4", "u4", "i8") for b in rows["body"]]
    a, b, n = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
    block = np.zeros((int(b.max()) // STRIPES + 1, ids), dtype=np.int64)
    np.add.at(block, (b // STRIPES, a), n)
    return block


def _nonzero(block: np.ndarray, stripe: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, a = np.nonzero(block)
    return a.astype(np.uint32), (row * STRIPES + stripe).astype(np.uint32), block[row, a]


def looked_up(pairs: bytes, totals: tuple[np.ndarray, ...]) -> bytes:
    """A chunk's pairs of a stripe with their counts in the whole corpus, and whether they are their second id's highest."""
    a, b, _ = unsqueeze(pairs, "u4", "u4", "i8")
    keys, count, best = totals
    at = np.searchsorted(keys, b.astype(np.int64) << 32 | a)
    return squeeze(count[at], best[at])


def align_tokens(docs: DataFrame, first: str, second: str, groups: Callable[[Column], Column] = lambda g: g) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of each document.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. ``first`` is a byte-level
    tokenizer file that reads a space and the text, ``second`` a piece model that adds the space
    itself. Groups are ``a1,a2|b1;a3|b2,b3`` in order, as a column that ``groups`` may turn into
    another string before it is stored, a digest say. n_best counts links whose pair is linked
    as often as any pair of its second id in the corpus, count_sum adds up the counts of all links.
    Null and empty texts, and texts whose tokens do not give back their bytes, have zeros and no
    groups. Repeated rows and null doc_ids are rows like others and count again. A long text is
    encoded whole in one task. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    volume = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    salts = volume // (FOLD * PART) + 1

    def chunk_rows(number: int, ids: list, texts: list) -> pd.DataFrame:
        one, two = sides(first, second)
        found = Aligned(texts, one, two)
        a, b, n, link = found.pairs()
        # a document's links as gaps between its pairs' numbers in order
        sorted_links = np.sort(found.doc << 32 | link) & 0xFFFFFFFF
        cuts = np.concatenate(([0], np.cumsum(found.n_groups))).tolist()
        bodies = [squeeze(np.diff(sorted_links[x:y], prepend=0).astype("u4")) if y > x else None for x, y in zip(cuts, cuts[1:])]
        documents = pd.DataFrame({"chunk": number, "stripe": -1, "n": found.n_groups, "body": bodies, "doc_id": pd.array(ids, dtype="Int64"), "n_a": found.n_a, "n_b": found.n_b, "n_groups": found.n_groups, "groups": found.groups(one, two)})
        counted = [(number, s, y - x, squeeze(a[x:y].astype("u4"), b[x:y].astype("u4"), n[x:y])) for s, x, y in edges(b % STRIPES)]
        return pd.concat([documents, pd.DataFrame(counted, columns=["chunk", "stripe", "n", "body"])], ignore_index=True).astype({c: "Int64" for c in ("doc_id", "n_a", "n_b", "n_groups")})

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids.append(None if pd.isna(doc) else int(doc))
                texts.append(text if isinstance(text, str) else None)
                size += len(texts[-1] or "")
                if size >= PART:
                    yield chunk_rows(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield chunk_rows(number, ids, texts)

    def ids() -> int:
        return len(sides(first, second)[0].bytes_of)

    def folded(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b, n = _nonzero(add_up(rows, ids()), key[0])
        return pd.DataFrame({"chunk": [None], "stripe": [key[0]], "n": [len(a)], "body": [squeeze(a, b, n)]}).astype({"chunk": "Int64"})

    def totals(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = add_up(rows, ids())
        a, b, n = _nonzero(block, key[0])
        best = n == block.max(axis=1)[b // STRIPES]
        return pd.DataFrame({"chunk": [None], "stripe": [key[0]], "n": [len(a)], "body": [squeeze(b.astype(np.int64) << 32 | a, n, best.astype("u1"))]}).astype({"chunk": "Int64"})

    def answered(key: tuple, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        found = [unsqueeze(b, "i8", "i8", "u1") for b in known["body"]][0] if len(asked) else None
        return asked[["chunk", "stripe", "n"]].assign(body=[looked_up(b, found) for b in asked["body"]])

    def scored(key: tuple, documents: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        parts = [unsqueeze(b, "i8", "u1") for b in answers.sort_values("stripe")["body"]]
        count, best = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
        n_best, count_sum = [], []
        for body in documents["body"]:
            link = np.cumsum(unsqueeze(body, "u4")[0], dtype=np.int64) if body is not None else np.zeros(0, np.int64)
            n_best.append(int(best[link].sum()))
            count_sum.append(int(count[link].sum()))
        out = documents[["doc_id", "n_a", "n_b", "n_groups"]].assign(doc_id=documents["doc_id"].astype("Int64"))
        return out.assign(n_links=documents["n_groups"], n_best=n_best, count_sum=count_sum, groups=documents["groups"])

    table = bucketed(own.mapInPandas(chunks, TABLE).withColumn("groups", groups(F.col("groups"))), "chunk", buckets_for(spark, 2 * volume))
    salt = F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")
    pairs = table.where("stripe >= 0").select("chunk", "stripe", "n", "body", salt.alias("salt"))
    part = pairs.groupBy("stripe", "salt").applyInPandas(folded, SENT)
    total = written(part.groupBy("stripe").applyInPandas(totals, SENT), "totals")
    spread = total.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(int(salts - 1)))))
    answers = written(pairs.groupBy("stripe", "salt").cogroup(spread.groupBy("stripe", "salt")).applyInPandas(answered, SENT), "answers")
    documents = table.where("stripe < 0").drop("stripe", "n")
    return documents.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
