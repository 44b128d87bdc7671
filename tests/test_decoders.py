"""Decoders against plain Python over small graphs."""

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from spreadframe.core import Graph
from spreadframe.functions.coins import ADD1, ADD2, MIX, PRIME, SALT, S, U, V
from spreadframe.operators import decoders


def toss(u, v, sample, salt):
    h = ((u * U + v * V + sample * S + SALT[salt]) % PRIME * MIX) % PRIME
    h = (h * h + ADD1) % PRIME
    return (h * h + ADD2) % PRIME / PRIME


def case(spark, seed, n=14, m=34):
    rng = random.Random(seed)
    arcs = {(a, b): round(rng.uniform(0.05, 0.9), 3) for a, b in itertools.product(range(n), repeat=2) if a != b}
    arcs = dict(rng.sample(sorted(arcs.items()), m))
    g = Graph(spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame([(a, b, p) for (a, b), p in arcs.items()], "src long, dst long, ic_p double"))
    reports = {v: rng.choice([None, 1, 2, 3, 0]) for v in rng.sample(range(n), 5)}
    return g, arcs, reports, spark.createDataFrame(list(reports.items()), "node long, time int")


def plain_explained(arcs, times, horizon):
    now = {v: max(0, min(t, horizon)) for v, t in times.items()}
    while True:
        added = {}
        for v, t in now.items():
            into = [(p, -a) for (a, b), p in arcs.items() if b == v]
            if t > 0 and into and not any(now.get(-a, 99) < t for _, a in into):
                best = -max(into)[1]
                added[best] = min(added.get(best, 99), t - 1)
        if not added:
            break
        for v, t in added.items():
            now[v] = min(t, now.get(v, 99))
    out = {}
    for v, t in now.items():
        into = [(now[a] == t - 1, p, -a) for (a, b), p in arcs.items() if b == v and now.get(a, 99) < t]
        out[v] = (t, -max(into)[2]) if t and into else (0, None)
    return out


def plain_grown(arcs, reports, horizon, nearest):
    def cheapest(tree):
        heap, done = [(0.0, [v]) for v in sorted(tree)], {}
        heapq.heapify(heap)
        while heap:
            cost, path = heapq.heappop(heap)
            if path[-1] in done:
                continue
            done[path[-1]] = (cost, path)
            for (a, b), p in arcs.items():
                if a == path[-1] and b not in done:
                    heapq.heappush(heap, (cost - math.log(p), [*path, b]))
        return done

    order = sorted(reports, key=lambda v: (reports[v] is None, reports[v] or 0, v))
    times = {order[0]: reports[order[0]] or 0}
    while True:
        reach, left = cheapest(times), [v for v in order if v not in times]
        if nearest:
            left = sorted((v for v in left if v in reach), key=lambda v: (reach[v][0], v))
        if not left:
            break
        v = left[0]
        if v not in reach:
            times[v] = reports[v] or 0
            continue
        path, span = reach[v][1], max(1, len(reach[v][1]) - 1)
        anchor = times[path[0]]
        end = reports[v] if reports[v] is not None else min(horizon, anchor + span)
        end = end if nearest else max(end, anchor + 1)
        for i, x in enumerate(path):
            times.setdefault(x, max(0, min(anchor + round((end - anchor) * i / span), horizon)))
    for v, t in reports.items():
        times.setdefault(v, t or 0)
        if t is not None:
            times[v] = min(t, horizon)
    return plain_explained(arcs, times, horizon)


def plain_logprob(arcs, times, horizon, n):
    total = 0.0
    for s in range(1, horizon + 1):
        for v in range(n):
            if times.get(v, 99) < s:
                continue
            p = 1 - math.prod(1 - q for (a, b), q in arcs.items() if b == v and times.get(a) == s - 1)
            p = min(max(p, decoders.CLIP), 1 - decoders.CLIP)
            total += math.log(p) if times.get(v) == s else math.log1p(-p)
    # catching a node without any try costs log CLIP, escaping without one nothing to speak of
    return total


def history_of(df):
    return {r["node"]: (r["time"], r["parent"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 3])
@pytest.mark.parametrize("nearest", [True, False])
def test_grown_tree(spark, seed, nearest):
    g, arcs, reports, said = case(spark, seed)
    assert history_of(decoders.grown_tree(g, said, 6, nearest)) == plain_grown(arcs, reports, 6, nearest)


def test_grown_tree_without_reports_or_arcs(spark):
    g, _, _, said = case(spark, 1)
    assert decoders.grown_tree(g, said.limit(0), 4).collect() == []
    bare = Graph(g.nodes, g.edges.limit(0))
    assert {v: t for v, (t, _) in history_of(decoders.grown_tree(bare, said, 4)).items()} == dict.fromkeys((r["node"] for r in said.collect()), 0)


def test_history_logprob(spark):
    g, arcs, _, _ = case(spark, 5)
    times = {0: 0, 1: 1, 4: 2, 7: 2, 9: 3}
    got = decoders.history_logprob(g, spark.createDataFrame(list(times.items()), "node long, time int"), 5).first()[0]
    assert got == pytest.approx(plain_logprob(arcs, times, 5, 14), abs=1e-6)


def test_chain_scores_are_likelihoods_of_their_histories(spark):
    g, arcs, _, _ = case(spark, 7)
    begin, held = {v: (v * 7) % 5 for v in range(11)}, {3, 6}
    start = spark.createDataFrame(list(begin.items()), "node long, time int")
    rows = decoders.chain_histories(g, start, start.where("node in (3, 6)"), 5, chains=4, sweeps=5, burn_in=0.25).collect()
    base = plain_logprob(arcs, begin, 5, 14)
    for chain in range(4):
        mine = [r for r in rows if r["chain"] == chain]
        now, best = ({r["node"]: r[c] for r in mine} for c in ("time", "best"))
        assert mine[0]["score"] == pytest.approx(plain_logprob(arcs, now, 5, 14) - base, abs=1e-5)
        assert mine[0]["best_score"] == pytest.approx(plain_logprob(arcs, best, 5, 14) - base, abs=1e-5)
        assert all(now[v] == begin[v] for v in begin if v in held or begin[v] == 0)
    assert len({tuple(sorted((r["node"], r["time"]) for r in rows if r["chain"] == c)) for c in range(4)}) > 1


def test_chains_find_the_likeliest_steps(spark):
    # one source, two nodes whose steps are open: all four by four histories can be tried
    arcs = {(0, 1): 0.9, (1, 2): 0.8, (0, 2): 0.1, (2, 3): 0.7}
    g = Graph(spark.range(4).withColumnRenamed("id", "node"), spark.createDataFrame([(a, b, p) for (a, b), p in arcs.items()], "src long, dst long, ic_p double"))
    start = spark.createDataFrame([(0, 0), (1, 2), (2, 3), (3, 3)], "node long, time int")
    rows = decoders.chain_histories(g, start, start.where("node = 3"), 4, chains=8, sweeps=10, burn_in=0.0).collect()
    top = max(rows, key=lambda r: (r["best_score"], -r["chain"]))
    want = max(((plain_logprob(arcs, {0: 0, 1: a, 2: b, 3: 3}, 4, 4), a, b) for a in range(1, 5) for b in range(1, 5)))
    found = {r["node"]: r["best"] for r in rows if r["chain"] == top["chain"]}
    assert (found[1], found[2]) == want[1:]


def test_mcmc_decode_keeps_reports_and_coherence(spark):
    g, arcs, reports, said = case(spark, 9)
    got = history_of(decoders.mcmc_decode(g, said, 5, chains=3, sweeps=4))
    assert set(reports) <= set(got)
    for v, (t, parent) in got.items():
        assert (parent is None) == (t == 0)
        assert parent is None or ((parent, v) in arcs and got[parent][0] < t)


@pytest.mark.parametrize("seed", [4])
def test_forward_backward(spark, seed):
    g, arcs, reports, said = case(spark, seed)
    horizon, particles = 5, 24
    tree = {v: t for v, (t, _) in plain_grown(arcs, reports, horizon, False).items()}
    times = {v: 0 for v, t in tree.items() if t == 0}
    wave = set(times)
    for t in range(1, horizon + 1):
        if not wave:
            break
        new = set()
        for v in range(14):
            p = 1 - math.prod(1 - q for (a, b), q in arcs.items() if b == v and a in wave)
            share = sum(toss(v, t, k, "mask") < p for k in range(particles)) / particles
            if v not in times and (p > 0 and share >= 0.5 or reports.get(v) == t):
                new.add(v)
        times |= dict.fromkeys(new, t)
        wave = new
    times |= {v: t for v, t in tree.items() if v not in times}
    times |= {v: min(t, horizon) for v, t in reports.items() if t is not None}
    assert history_of(decoders.forward_backward(g, said, horizon)) == plain_explained(arcs, times, horizon)
