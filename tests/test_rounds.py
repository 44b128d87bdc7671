"""Seeding in rounds against plain Python, realisation by realisation."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spreadframe.core import Graph
from spreadframe.operators import dynamics, rounds, selectors, structure


def graph(spark, arcs):
    return Graph.from_edges(spark.createDataFrame(arcs, "src long, dst long, ic_p double")).materialized()


ARCS = [(i, (i * 7 + k * k + 1) % 24, 0.15 + 0.1 * (k % 3)) for i in range(24) for k in range(1 + i % 4) if i != (i * 7 + k * k + 1) % 24]
RUNS, BATCHES, GAP, HORIZON = 4, [2, 2], 2, 3


@pytest.fixture(scope="module")
def net(spark):
    return graph(spark, sorted({(a, b): (a, b, p) for a, b, p in ARCS}.values()))


@pytest.fixture(scope="module")
def plain(net):
    """Arcs, degrees and live arcs of each realisation."""
    arcs = [(r["src"], r["dst"]) for r in net.edges.collect()]
    degree = {r["node"]: r["score"] for r in structure.degree(net).collect()}
    return arcs, degree, worlds(net, RUNS, 0)


def worlds(net, runs, seed):
    live = [defaultdict(set) for _ in range(runs)]
    for r in dynamics.live_edges(net, runs, seed).collect():
        live[r["sample"]][r["src"]].add(r["dst"])
    return live


def replayed(live, policy, feedback="full"):
    out = set()
    for s, arcs in enumerate(live):
        state, front = {}, set()
        for t in range(HORIZON + 1):
            front = {d for u in front for d in arcs[u]} - set(state)
            state |= {v: (t, False) for v in front}
            if t % GAP == 0 and t // GAP < len(BATCHES):
                seen = {v for v, (at, _) in state.items() if feedback == "full" or at == t}
                new = [v for v in policy(s, seen, BATCHES[t // GAP], t) if v not in state]
                state |= {v: (t, True) for v in new}
                front |= set(new)
        out |= {(s, v, t, p) for v, (t, p) in state.items()}
    return out


def ran(net, policy, feedback="full"):
    return {(r["sample"], r["node"], r["t"], r["seeded"]) for r in rounds.rollout(net, policy, BATCHES, GAP, HORIZON, RUNS, feedback=feedback).collect()}


def best(score, seen, batch):
    return sorted((v for v in score if v not in seen), key=lambda v: (-score[v], v))[:batch]


@pytest.mark.parametrize("feedback", ["full", "myopic"])
def test_degree_in_rounds(net, plain, feedback):
    _, degree, live = plain
    want = replayed(live, lambda s, seen, batch, t: best(degree, seen, batch), feedback)
    assert ran(net, rounds.by_ranking(structure.degree(net)), feedback) == want
    if feedback == "myopic":
        assert sum(p for *_, p in want) < RUNS * sum(BATCHES)  # seeds are spent on reached nodes


def test_discounted_degree_in_rounds(net, plain):
    arcs, degree, live = plain

    def policy(s, seen, batch, t):
        score = {v: degree[v] - sum((a == v and b in seen) + (b == v and a in seen) for a, b in arcs) for v in degree}
        chosen = []
        for _ in range(batch):
            v = best(score, seen | set(chosen), 1)[0]
            chosen.append(v)
            for a, b in arcs:
                for x, y in ((a, b), (b, a)):
                    if x == v:
                        score[y] -= 1
        return chosen

    assert ran(net, rounds.by_discounted_degree(net)) == replayed(live, policy)


def test_marginal_gain_in_rounds(net, plain):
    _, degree, live = plain
    model = worlds(net, 6, 1000)

    def reach(starts):
        found = set()
        for w, arcs in enumerate(model):
            seen, front = set(starts), set(starts)
            for _ in range(3):
                front = {d for u in front for d in arcs[u]} - seen
                seen |= front
            found |= {(w, v) for v in seen}
        return found

    def policy(s, seen, batch, t):
        pool, chosen = best(degree, seen, 7), []
        for _ in range(batch):
            gain = {v: len(reach(seen | set(chosen) | {v})) - len(reach(seen | set(chosen))) for v in pool if v not in chosen}
            chosen.append(max(gain, key=lambda v: (gain[v], -pool.index(v))))
        return chosen

    assert ran(net, rounds.by_marginal_gain(net, candidates=7, runs=6, horizon=3)) == replayed(live, policy)


@pytest.mark.parametrize("theta", [3, 60])
def test_uncovered_sets_in_rounds(net, plain, theta):
    _, degree, live = plain
    sets = defaultdict(set)
    for r in selectors.reverse_sets(net, theta, 7).collect():
        sets[r["rr_id"]].add(r["node"])

    def policy(s, seen, batch, t):
        left = [x for x in sets.values() if not x & seen]
        if not left:
            return best(degree, seen, batch)
        chosen = []
        for _ in range(batch):
            v = best({v: sum(v in x for x in left) for v in degree}, seen | set(chosen), 1)[0]
            chosen.append(v)
            left = [x for x in left if v not in x]
        return chosen

    assert ran(net, rounds.by_uncovered_sets(net, theta)) == replayed(live, policy)


def test_random_rounds_repeat_and_avoid_the_reached(net):
    a, b = ran(net, rounds.at_random(net)), ran(net, rounds.at_random(net))
    assert a == b and sum(p for *_, p in a) == RUNS * sum(BATCHES)


def test_spread_by_round(net, plain):
    h = rounds.rollout(net, rounds.by_ranking(structure.degree(net)), BATCHES, GAP, HORIZON, RUNS)
    rows = h.collect()
    got = {r["round"]: (r["t"], r["spread"]) for r in rounds.round_spreads(h, 4, GAP, HORIZON, RUNS).collect()}
    assert got == {i + 1: (2 * i + 1, sum(r["t"] <= 2 * i + 1 for r in rows) / RUNS) for i in range(2)}


def test_refusals(net):
    with pytest.raises(ValueError):
        rounds.round_schedule([1, 1, 1], 4, 7)
    with pytest.raises(ValueError):
        rounds.round_schedule([1], 0, 7)
    with pytest.raises(ValueError):
        rounds.observed_state(net.nodes, 0, "other")
    with pytest.raises(ValueError):  # the same node again, though the policy sees that it is reached
        rounds.rollout(net, lambda seen, w, batch, t: w.withColumn("node", F.lit(1).cast("long")), [1, 1], 1, 2, 2)
    with pytest.raises(ValueError):
        rounds.rollout(net, lambda seen, w, batch, t: w.join(net.nodes), [1], 1, 2, 2)


def test_no_node_left_to_choose(spark):
    net = graph(spark, [(0, 1, 1.0), (1, 2, 1.0)])
    got = rounds.rollout(net, rounds.by_ranking(structure.degree(net)), [2, 2, 2], 1, 4, 2)
    assert got.where("seeded").count() == 2 * 2 and got.count() == 2 * 3
    for policy in (rounds.by_discounted_degree(net), rounds.by_marginal_gain(net, 3, 2, 2), rounds.by_uncovered_sets(net, 4)):
        assert rounds.rollout(net, policy, [3, 2], 1, 4, 2).count() == 2 * 3
