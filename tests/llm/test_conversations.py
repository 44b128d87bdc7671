import hashlib
import itertools
import random
import re
import sys
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import Row

from spreadframe.llm import conversations
from spreadframe.llm import queries
from spreadframe.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, copies string, gaps string, cost string"
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]")


sys.setrecursionlimit(20_000)


def plain_edits(rows):
    """All cheapest repairs' letters by search over (row, state); the least one."""
    accept, kept = {"", "a"}, {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    forced = {"": "u", "s": "u", "u": "a", "a": "u"}
    n = len(rows)

    @lru_cache(None)
    def best(i, state, inserts):
        out = []
        if i == n and state in accept:
            out.append((0, ""))
        if inserts < 4:
            c, s = best(i, forced[state], inserts + 1)
            out.append((c + 2, "I" + s))
        if i < n:
            initial, gone, cut = rows[i]
            c, s = best(i + 1, state, 0)
            out.append((c + 3, "D" + s))
            if not gone:
                if (state, initial) in kept:
                    c, s = best(i + 1, kept[state, initial], 0)
                    out.append((c + cut, "K" + s))
                c, s = best(i + 1, forced[state], 0)
                out.append((c + cut + 2, "R" + s))
        return min(out) if out else (10**6, "")

    return best(0, "", 0)


def plain(table):
    out = {}
    for conv in {r["conv_id"] for r in table}:
        rows = []
        for r in sorted((r for r in table if r["conv_id"] == conv), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"] if r["role"] is not None else " ", r["text"] if r["text"] is not None else " ")):
            s = lambda x: " " if x is None else str(x)
            kind, role, text = zlib.crc32(f"{s(conv)}:{s(r['turn'])}".encode()) % 20, s(r["role"]), s(r["text"])
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(r["turn"], "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen, form = [0, 0, 0], set(), []
        for _, role, text in rows:
            chars = NOT_SPACE.findall(text)
            f = 0 if not chars else 1 if (role, text) in seen else 2 if chars[-1] not in ".!?" else 3
            seen.add((role, text))
            if f < 3:
                faults[f] += 1
            form.append((role[:1], f < 2, int(f == 2)))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = plain_edits(tuple(form))
        i, turns_out = 0, []
        for e in audit:
            need = "assistant" if turns_out and turns_out[-1][0][0] == "u" else "user"
            if e == "I":
                turns_out.append((need, ""))
                continue
            if e != "D":
                turns_out.append((rows[i][1] if e == "K" else need, rows[i][2]))
            i += 1
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in turns_out))
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns_out).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def compare(df, table):
    if "repaired" in df.columns:
        df = queries.digested(df)
    found = df.collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found} == plain(table)
    assert len(found) == len({r["conv_id"] for r in found})


def test_query_equals_plain_search(spark, tiny):
    compare(QUERIES["op11_conversations"](spark, tiny), [r.asDict() for r in spark.read.parquet(f"{tiny}/conversations.parquet").collect()])


def test_query_on_larger_table(spark):
    sf = "/root/testdata/sf0.01"
    compare(QUERIES["op11_conversations"](spark, sf), [r.asDict() for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()])


def odd_table(n=120, seed=3):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", None, "", "usher", "User", "tool"]
    texts = ["Fine.", "Fine.", "cut off", "", "  \n", None, "Why?  ", "so!\t", "é。", " x", "tail\x0b\x1c", "long " * 3000 + "."]
    out = []
    for _ in range(n):
        conv, turn = rng.choice([None, *range(30)]), rng.choice([None, *range(9)])
        out.append({"conv_id": conv, "turn": turn, "role": rng.choice(roles), "text": rng.choice(texts)})
    out += [out[0]] * 3 + [{"conv_id": 99, "turn": t, "role": rng.choice(roles[:3]), "text": f"{t % 7} {'.' if t % 3 else ''}"} for t in range(300)]
    return out


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_nulls_ties_repeats_and_clashing_columns(spark, seed):
    table = odd_table(seed=seed)
    df = spark.createDataFrame([Row(**r, copies="x", gaps="y", cost="z") for r in table], SCHEMA)
    compare(conversations.repair_conversations(conversations.damage(df)), table)


def test_empty_table(spark):
    assert conversations.repair_conversations(conversations.damage(spark.createDataFrame([], SCHEMA))).collect() == []


def test_conversations_across_batches_stay_whole(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    was = conversations.ROWS
    try:
        conversations.ROWS = 10
        table = odd_table(seed=8)
        df = spark.createDataFrame([Row(**r, copies="x", gaps="y", cost="z") for r in table], SCHEMA)
        compare(conversations.repair_conversations(conversations.damage(df)), table)
    finally:
        conversations.ROWS = was
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tensor_program_over_all_short_forms():
    kinds = [(c, g, t) for c in "sua?" for g, t in ((False, 0), (False, 1), (True, 0))]
    for n in range(1, 4):
        forms = list(itertools.product(kinds, repeat=n))
        initial = np.array([[ord(k[0]) for k in f] for f in forms], dtype=np.uint8).T
        gone, cut = (np.array([[bool(k[i]) for k in f] for f in forms]).T for i in (1, 2))
        cost, edits = conversations.cheapest_edits(initial, gone, cut, np.full(len(forms), n))
        lines = edits.reshape(-1, len(forms)).T
        for k, f in enumerate(forms):
            assert (cost[k], lines[k][lines[k] > 0].tobytes().decode()) == plain_edits(f)
