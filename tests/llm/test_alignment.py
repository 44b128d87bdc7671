import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from spreadframe.llm import alignment
from spreadframe.llm.queries import QUERIES, piece_file, tokenizer_file

from . import cases


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=piece_file())
    back = alignment.byte_of_character()
    first = lambda s: [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + s, add_special_tokens=False).ids]
    piece = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
    return first, lambda s: [(i, piece(i)) for i in m.encode(s)]


def plain(table, tools):
    """Rows by whole-text encoding, byte ranges as sets, and a counter of all linked pairs."""
    out, pairs = [], Counter()
    for doc, text in table:
        if not text:
            out.append((doc, [], [], [], []))
            continue
        a, b = (f(text) for f in tools)
        raw = b" " + text.encode()
        if any(b"".join(t for _, t in side) != raw for side in (a, b)):
            out.append((doc, [], [], [], []))
            continue
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in (a, b)]
        both, groups, links, at = set(ends[0]) & set(ends[1]), [], [], [0, 0]
        for e in sorted(both):
            parts = []
            for k, side in enumerate((a, b)):
                to = ends[k].index(e, at[k]) + 1
                parts.append([i for i, _ in side[at[k] : to]])
                at[k] = to
            groups.append(",".join(map(str, parts[0])) + "|" + ",".join(map(str, parts[1])))
            links.append((parts[0][-1], parts[1][-1]))
        pairs.update(links)
        out.append((doc, a, b, groups, links))
    best = Counter()
    for (x, y), n in pairs.items():
        best[y] = max(best[y], n)
    return sorted(((d, len(a), len(b), len(g), len(k), sum(pairs[p] == best[p[1]] for p in k), sum(pairs[p] for p in k), ";".join(g)) for d, a, b, g, k in out), key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_plain_counts(spark, tools, sf):
    path = f"/root/testdata/{sf}"
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    got = {tuple(r) for r in QUERIES["op12_alignment"](spark, path).select(*COLUMNS[:-1], "groups_sha256").collect()}
    assert got == {(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in plain(table, tools)}


ODD = [(20, "▁mark"), (21, " leading and  double "), (22, "<s> <unk> </s> <|endoftext|> [UNK]"), (23, "é é ﬁ Ⅷ ​ x"), (24, "\U0001f642\U0001f9ea 12345 \x00 \x1f"), (25, " "), (26, "\n\n"), (27, "a" * 5000), (28, " x　y")]


def test_odd_documents(spark, tools):
    table = cases.TEXTS + ODD
    assert found(alignment.align_tokens(cases.documents(spark, table), tokenizer_file(), piece_file())) == plain(table, tools)


def test_empty_table(spark):
    assert alignment.align_tokens(cases.empty(spark), tokenizer_file(), piece_file()).collect() == []


def test_words_remembered_give_the_ids_of_whole_texts(tools):
    side, rng = alignment.SecondSide(piece_file()), random.Random(2)
    bits = ["a", "the", "\n", "tab\t", "日本", "é", "🙂", "x.y", ".", ",", "1234", "<0x41>", "--", "​", "", "Word's"]
    texts = [" ".join("".join(rng.choices(bits, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    assert [np.frombuffer(b, "<u4").tolist() for b in side.encode(texts)] == [[i for i, _ in tools[1](t)] for t in texts]


def test_stripes_add_up_like_one_matrix():
    import pandas as pd

    from spreadframe.llm.chunks import squeeze

    rng = np.random.default_rng(4)
    parts = []
    for _ in range(6):
        b = 7 + alignment.STRIPES * rng.integers(0, 9, 300)
        a = rng.integers(0, 50, 300)
        key, n = np.unique(b * 64 + a, return_counts=True)
        parts.append((key % 64, key // 64, n))
    rows = pd.DataFrame({"body": [squeeze(a.astype("u4"), b.astype("u4"), n.astype("i8")) for a, b, n in parts]})
    block, want = alignment.add_up(rows, 64), Counter()
    for a, b, n in parts:
        for x, y, z in zip(a.tolist(), b.tolist(), n.tolist()):
            want[y, x] += z
    a, b, n = alignment._nonzero(block, 7)
    assert dict(zip(zip(b.tolist(), a.tolist()), n.tolist())) == dict(want)
