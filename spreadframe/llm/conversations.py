"""Repair of conversation structure by dynamic programming, over many conversations at once.

A conversation should read ``(system)? (user assistant)+`` or be empty. Its rows are kept,
rerolled or deleted and empty turns inserted at the least cost; of equally cheap repairs
the one whose edits' initials come first in ASCII order is taken. Spark sorts the rows by
conversation and turn; tasks take runs of whole conversations, bucket them by length and
hold costs as arrays of turn x conversation x state: one pass from the last turn to the
first stores what it costs to finish from each state, one pass forwards traces the edits.
What a conversation still needs is a state: nothing read yet, a system turn, a user turn
or an assistant turn came last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# costs of edits; fixed values
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEVER = np.int32(1 << 28)
#: States by what came last. A user turn may follow START, SYSTEM and ASSISTANT, an assistant turn USER.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or rerolled turn.
AFTER = np.array([USER, USER, ASSISTANT, USER])
#: Rows, or bytes of text, gathered before whole conversations are repaired, and cells of a cost array.
ROWS, BYTES, CELLS = 1 << 16, 1 << 24, 1 << 22
SPACE = " \t\n\v\f\r"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role: string, text: string>>"


def damage(rows: DataFrame) -> DataFrame:
    """Rows as ``crc32(conv_id:turn) % 20`` damages them; nulls in role and text are one space.

    0 drops the row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 sets role user.
    Returns conv_id, turn, role, text, copies (0 for a dropped row).
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(space("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"), space("role").alias("_role"), space("text").alias("_text"),
    )


def _next_kept(initial: np.ndarray) -> np.ndarray:
    """The state after a kept row, for each state in the first axis; -1 where it may not be kept."""
    s, u, a = (initial == ord(c) for c in "sua")
    out = np.full((4, *initial.shape), -1, dtype=np.int8)
    out[START][s], out[START][u] = SYSTEM, USER
    out[SYSTEM][u] = out[ASSISTANT][u] = USER
    out[USER][a] = ASSISTANT
    return out


def _inserted(costs: np.ndarray) -> np.ndarray:
    """Costs by state (conversation x state) once empty turns may be inserted first."""
    u = np.minimum(costs[:, USER], INSERT + costs[:, ASSISTANT])
    a = np.minimum(costs[:, ASSISTANT], INSERT + costs[:, USER])
    return np.stack([np.minimum(costs[:, START], INSERT + u), np.minimum(costs[:, SYSTEM], INSERT + u), u, a], axis=1)


def cheapest_edits(initial: np.ndarray, must_go: np.ndarray, truncated: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost and edits of conversations side by side.

    ``initial`` (role initials as bytes), ``must_go`` and ``truncated`` are turn x conversation,
    filled up to the longest; ``lengths`` says how many rows are real. Edits come back as turn x
    4 x conversation: up to three inserts and the row's own edit, 0 for none; the last turn
    holds what is inserted at the end.
    """
    turns, n = initial.shape
    kept, fine = _next_kept(initial), np.where(truncated, TRUNCATED, 0).astype(np.int32)
    costs = np.empty((turns + 1, n, 4), dtype=np.int32)
    costs[turns] = _inserted(np.tile(np.array([0, NEVER, NEVER, 0], dtype=np.int32), (n, 1)))
    every = np.arange(n)

    def keep(t: int, state: int | np.ndarray) -> np.ndarray:
        to = kept[state, t] if isinstance(state, int) else kept[state, t, every]
        return np.where((to < 0) | must_go[t], NEVER, fine[t] + costs[t + 1][every, np.maximum(to, 0)])

    for t in range(turns - 1, -1, -1):
        after = costs[t + 1]
        own = np.empty((n, 4), dtype=np.int32)
        for state in range(4):
            rerole = np.where(must_go[t], NEVER, REROLE + fine[t] + after[:, AFTER[state]])
            own[:, state] = np.minimum(np.minimum(DELETE + after[:, state], keep(t, state)), rerole)
        costs[t] = np.where((t < lengths)[:, None], _inserted(own), after)
    edits = np.zeros((turns + 1, 4, n), dtype=np.uint8)
    state = np.zeros(n, dtype=np.int64)
    for t in range(turns + 1):
        real, open_ = t < lengths, np.ones(n, dtype=bool)
        for step in range(4):
            left, after = costs[t, every, state], AFTER[state]
            # D, I, K, R: the first in ASCII order that stays on a cheapest way
            delete = open_ & real & (left == DELETE + costs[t + 1, every, state]) if t < turns else np.zeros(n, dtype=bool)
            insert = open_ & ~delete & (left == INSERT + costs[t, every, after]) & (real | (t == turns))
            edits[t, step][delete], edits[t, step][insert] = ord("D"), ord("I")
            if t < turns:
                taken = open_ & real & ~delete & ~insert
                hold = taken & (left == keep(t, state))
                to = kept[state, t, every]
                edits[t, step][hold], edits[t, step][taken & ~hold] = ord("K"), ord("R")
                state = np.where(hold, to, np.where(taken, after, state))
            state = np.where(insert, after, state)
            open_ = insert
            if not open_.any():
                break
    return costs[0, :, START], edits


def _repair(rows: pd.DataFrame, code: np.ndarray) -> pd.DataFrame:
    """One row for each conversation of ``rows``, which hold whole conversations in order; ``code`` numbers them."""
    n = int(code[-1]) + 1
    copies = rows["copies"].to_numpy()
    first = np.flatnonzero(np.diff(code, prepend=-1))
    ids = rows["conv_id"].iloc[first].array
    real = copies > 0
    turn, known = rows["turn"].fillna(0).to_numpy(dtype=np.int64), rows["turn"].notna().to_numpy() & real
    gaps = np.zeros(n, dtype=np.int64)
    if known.any():
        c, t = code[known], turn[known]
        at = np.flatnonzero(np.diff(c, prepend=-1))
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (t[1:] != t[:-1])))
        gaps[c[at]] = np.maximum.reduceat(t, at) - np.minimum.reduceat(t, at) + 1 - np.add.reduceat(new.astype(np.int64), at)
    times = np.repeat(np.arange(len(rows)), copies)
    role, text, conv = rows["role"].to_numpy(dtype=object)[times], rows["text"].to_numpy(dtype=object)[times], code[times]
    bare = [x.rstrip(SPACE) for x in text]
    initial = np.array([ord(r[0]) if r and r[0] in "sua" else 0 for r in role], dtype=np.uint8)
    blank = np.array([not x for x in bare], dtype=bool)
    duplicate = pd.DataFrame({"c": conv, "r": role, "t": text}).duplicated().to_numpy() & ~blank if len(conv) else blank
    cut = np.array([bool(x) and x[-1] not in ".!?" for x in bare], dtype=bool) & ~duplicate
    count = lambda flag: np.bincount(conv[flag], minlength=n).astype(np.int64)
    follows = conv[1:] == conv[:-1]
    pair = initial[:-1].astype(np.int32) * 256 + initial[1:]
    wrong = follows & ~np.isin(pair, [ord(x) * 256 + ord(y) for x, y in ("su", "ua", "au")])
    illegal = np.bincount(conv[1:][wrong], minlength=n).astype(np.int64) if len(conv) else np.zeros(n, dtype=np.int64)
    lengths = np.bincount(conv, minlength=n)
    begins = np.cumsum(lengths) - lengths
    cost, audit, repaired = np.zeros(n, dtype=np.int64), [""] * n, [[] for _ in range(n)]
    # conversations of like length side by side: a bucket reaches from half its longest up
    bucket = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for b in np.unique(bucket[lengths > 0]):
        members = np.flatnonzero((bucket == b) & (lengths > 0))
        wide = max(1, CELLS >> int(b))
        for at in range(0, len(members), wide):
            part = members[at : at + wide]
            turns = int(lengths[part].max())
            inside = np.arange(turns)[:, None] < lengths[part][None, :]
            where = np.where(inside, begins[part][None, :] + np.arange(turns)[:, None], 0)
            spent, edits = cheapest_edits(np.where(inside, initial[where], 0), (blank | duplicate)[where], cut[where], lengths[part])
            cost[part] = spent
            lines = edits.reshape(-1, len(part)).T
            for k, c in enumerate(part.tolist()):
                steps = lines[k][lines[k] > 0].tobytes()
                audit[c] = steps.decode("ascii")
                repaired[c] = list(repaired_turns(steps, role[begins[c] : begins[c] + lengths[c]], text[begins[c] : begins[c] + lengths[c]]))
    return pd.DataFrame({"conv_id": ids, "gaps": gaps, "blank": count(blank), "duplicate": count(duplicate), "truncated": count(cut), "illegal": illegal, "cost": cost, "audit": audit, "repaired": repaired})


def repaired_turns(steps: bytes, roles, texts) -> Iterator[dict[str, str]]:
    """Roles and texts that the edits make of a conversation's rows."""
    row, last = 0, ""
    for step in steps:
        if step == ord("D"):
            row += 1
            continue
        role, text = ("assistant" if last == "u" else "user"), ""
        if step != ord("I"):
            role, text = (roles[row] if step == ord("K") else role), texts[row]
            row += 1
        last = role[0]
        yield {"role": role, "text": text}


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Counts of faults, the cheapest repair and its turns for each conversation of ``rows``.

    ``rows`` has conv_id, turn, role, text and copies (how often the row stands there, 0 for a
    row that is gone but whose conversation is still reported); other columns are ignored but
    for ``_role`` and ``_text``, which order rows of one turn, role and text else. Null turns
    come first, a null conv_id is a conversation of its own, nulls in role and text are one
    space; repeated rows stand next to each other and count as duplicates. Empty texts are
    blank. An empty table gives no rows. A conversation's rows are in one task, as its
    repair is one row; a task holds some ten thousand rows, or one longer conversation.
    """
    order = [c for c in ("_role", "_text") if c in rows.columns] or ["role", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = weight = 0

        def codes(part: pd.DataFrame) -> np.ndarray:
            ids, none = part["conv_id"].fillna(0).to_numpy(dtype=np.int64), part["conv_id"].isna().to_numpy()
            return np.cumsum(np.concatenate(([False], (ids[1:] != ids[:-1]) | (none[1:] != none[:-1]))))

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size, weight = size + len(batch), weight + int(batch["text"].str.len().sum())
            if size < ROWS and weight < BYTES:
                continue
            part = pd.concat(held, ignore_index=True)
            code = codes(part)
            cut = int(np.searchsorted(code, code[-1]))
            if cut:
                yield _repair(part[:cut], code[:cut])
                part = part[cut:]
            # a conversation longer than this waits for twice as many rows before the next look
            held, size, weight = [part], 0, 0
            if cut == 0:
                size, weight = -len(part), -int(part["text"].str.len().sum())
        if held:
            part = pd.concat(held, ignore_index=True)
            yield _repair(part, codes(part))

    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *map(space, dict.fromkeys(["role", "text", *order])), F.col("copies").cast("int").alias("copies"))
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), *order)
    slim = dealt.select("conv_id", "turn", "role", "text", "copies")
    return slim.mapInPandas(run, RESULT)
