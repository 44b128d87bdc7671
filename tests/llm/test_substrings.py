import hashlib
import random
import re

import numpy as np
import pytest

from spreadframe.llm import substrings
from spreadframe.llm.queries import QUERIES

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(table, window=20):
    """Rows of (doc_id, words, removed, kept) by a dictionary of all windows' words."""
    first, split = {}, []
    for doc, text in table:
        words, place = WORD.findall(text or ""), (doc is None, doc or 0)
        split.append((doc, place, words))
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, ((2, 0), 0)), (place, i))
    out = []
    for doc, place, words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (place, i):
                gone.update(range(i, i + window))
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_plain_search(spark, sf):
    path = f"/root/testdata/{sf}"
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = {tuple(r) for r in QUERIES["op13_substrings"](spark, path).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == {(d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in plain(table)}
    assert sum(g for _, _, g, _ in got) > 0


@pytest.mark.parametrize("window", [1, 3, 20])
def test_odd_documents(spark, window):
    assert found(substrings.remove_repeats(cases.documents(spark), window)) == plain(cases.TEXTS, window)


def test_empty_table(spark):
    assert substrings.remove_repeats(cases.empty(spark)).collect() == []


def test_many_chunks_stripes_and_tasks(spark, monkeypatch):
    rng = random.Random(5)
    passages = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(rng.randint(3, 30))) for _ in range(25)]
    table = [(rng.randint(0, 60), "\n".join(rng.choice(passages) for _ in range(rng.randint(0, 9)))) for _ in range(80)] + [(-7, passages[0] * 3), (None, passages[1] + " " + passages[1])]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    for width in (1, 8):  # a sketch so narrow that most windows collide, and a usual one
        monkeypatch.setattr(substrings, "CHUNK", 300)
        monkeypatch.setattr(substrings, "STRIPE", 256)
        monkeypatch.setattr(substrings, "EXACT", 100)
        monkeypatch.setattr(substrings, "SPARE", width)
        # workers import the module anew: the passes are run here, over the same rows
        chunks = run_here(table, 5)
        assert chunks == plain(table, 5)
    assert found(substrings.remove_repeats(df, 5)) == plain(table, 5)


def run_here(table, size):
    """All passes in this process, exchanging rows as Spark does."""
    import pandas as pd

    groups, group, weight = [], [], 0
    for row in table:
        group.append(row)
        weight += len(row[1] or "")
        if weight >= substrings.CHUNK:
            groups, group, weight = [*groups, group], [], 0
    groups.append(group)
    chunks = []
    for g in groups:
        c = substrings.Chunk(substrings.pack([d for d, _ in g], [(t or "").encode() for _, t in g]))
        c.windows(size)
        chunks.append(c)
    total = sum(len(t or "") for _, t in table) // 6 + 1
    width = 1 << max(10, (substrings.SPARE * total - 1).bit_length())
    cols = ["chunk", "stripe", "n", "body"]

    def exchange(rows, merge):
        frame = pd.DataFrame([r for part in rows for r in part], columns=cols)
        return pd.concat([merge(g.reset_index(drop=True)) for _, g in frame.groupby("stripe")]) if len(frame) else frame

    often = exchange([list(substrings.sketch_rows(c, i, width)) for i, c in enumerate(chunks)], substrings.merge_sketches)
    mine = lambda f, i: f[f["chunk"] == i]
    first = exchange([list(substrings.entry_rows(c, i, width, mine(often, i), total // substrings.EXACT + 1)) for i, c in enumerate(chunks)], substrings.first_places)
    out = pd.concat([substrings.kept_words(c, width, size, mine(often, i), mine(first, i)) for i, c in enumerate(chunks)])
    return sorted(((None if r.doc_id is pd.NA else int(r.doc_id), int(r.n_words), int(r.n_removed), r.kept) for r in out.itertuples()), key=repr)


def test_estimates_are_never_too_low():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 40, 4000)]
    c = substrings.Chunk(substrings.pack([1, 2], [" ".join(words[:2000]).encode(), " ".join(words[1500:]).encode()]))
    c.windows(20)
    rows = [tuple(r) for r in substrings.sketch_rows(c, 0, 1 << 15)]
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["chunk", "stripe", "n", "body"])
    often = pd.concat([substrings.merge_sketches(g) for _, g in frame.groupby("stripe")])
    left = set(substrings._candidates(c, 1 << 15, often).tolist())
    assert set(range(1500, 1981)) <= left  # the windows of the shared passage in the first text
    assert len(left) < 1.1 * 2 * 481 + 200


def test_codec_round_trip():
    a, b = np.arange(1000, dtype="u4") * 77, np.arange(1000, dtype="u8") << 40
    x, y = substrings.unsqueeze(substrings.squeeze(a, b), "u4", "u8")
    assert (a == x).all() and (b == y).all()
