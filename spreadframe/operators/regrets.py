"""Regret of one-step choices, from states drawn on many graphs, choosers of candidates, and sampled truth.

Every table carries ``graph_id`` and ``state``, so all graphs, states, candidates and samples run in one job.
Of a graph, only arcs out of active nodes and candidates are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import product_of, top_k
from ..functions.coins import coin
from ..shared import written

STATE = ["graph_id", "state"]
#: Coins of the two sides' arcs (side 0 and side 1); fixed values.
SIDES = (11, 13)


def _of_graph(state: DataFrame, edges: DataFrame) -> DataFrame:
    """``state`` with each arc ``dst, ic_p`` out of its nodes."""
    return state.join(edges.select("graph_id", F.col("src").alias("node"), "dst", "ic_p"), ["graph_id", "node"])


def drawn_states(nodes: DataFrame, states: int, share: float, seed: int = 0) -> DataFrame:
    """``graph_id, state, node``: each node of ``nodes(graph_id, node)`` active by coin, at least the first in coin order."""
    every = nodes.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(states - 1))))
    drawn = every.withColumn("_coin", coin(F.col("node"), seed, F.col("state"), "pick"))
    least = drawn.groupBy(*STATE).agg(F.min("_coin").alias("_least"))
    return drawn.join(least, STATE).where((F.col("_coin") < share) | (F.col("_coin") == F.col("_least"))).select(*STATE, "node")


def drawn_candidates(nodes: DataFrame, active: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """``graph_id, state, node``: of the nodes that are not active, the first ``most`` in another coin order."""
    open_ = nodes.join(active.select(*STATE).distinct(), "graph_id").join(active, [*STATE, "node"], "left_anti")
    return top_k(open_.withColumn("score", -coin(F.col("node"), seed, F.col("state"), "tie")), most, by=STATE).select(*STATE, "node")


def degrees(edges: DataFrame) -> DataFrame:
    """``graph_id, node, degree``: arcs in and out."""
    return edges.select("graph_id", F.col("src").alias("node")).unionAll(edges.select("graph_id", "dst")).groupBy("graph_id", "node").agg(F.count("*").alias("degree"))


def _hit(model: DataFrame, active: DataFrame) -> DataFrame:
    """``graph_id, state, node, hit``: the chance of a node outside ``active`` to be reached in one step."""
    met = _of_graph(active, model).groupBy(*STATE, F.col("dst").alias("node")).agg(product_of(F.col("ic_p")).alias("hit"))
    return met.join(active, [*STATE, "node"], "left_anti")


def predicted_gain(model: DataFrame, active: DataFrame, candidates: DataFrame) -> DataFrame:
    """``graph_id, state, node, predicted``: expected nodes that a candidate adds to the next step, itself included."""
    hit = written(_hit(model, active), "hit")
    own = candidates.join(hit, [*STATE, "node"], "left").select(*STATE, "node", (1 - F.coalesce("hit", F.lit(0.0))).alias("add"))
    near = _of_graph(candidates, model).where("node <> dst").join(active.withColumnRenamed("node", "dst"), [*STATE, "dst"], "left_anti")
    near = near.join(hit.withColumnRenamed("node", "dst"), [*STATE, "dst"], "left").select(*STATE, "node", ((1 - F.coalesce("hit", F.lit(0.0))) * F.col("ic_p")).alias("add"))
    return own.unionByName(near).groupBy(*STATE, "node").agg(F.sum("add").alias("predicted"))


def sampled_gain(edges: DataFrame, active: DataFrame, candidates: DataFrame, runs: int, seed: int = 0) -> DataFrame:
    """``graph_id, state, node, truth``: mean nodes that a candidate adds to the next step over ``runs`` samples."""
    def live(state: DataFrame) -> DataFrame:
        tried = _of_graph(state, edges).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
        return tried.where(coin(F.col("node"), F.col("dst"), F.col("sample") + runs * seed, "arc") < F.col("ic_p"))

    got = live(active).select(*STATE, "sample", "dst").distinct()
    had = written(got.unionByName(active.select(*STATE, F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("sample"), F.col("node").alias("dst"))).distinct(), "had")
    own = candidates.select(*STATE, "node", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("sample"), F.col("node").alias("dst"))
    added = own.unionByName(live(candidates).select(*STATE, "node", "sample", "dst")).distinct().join(had, [*STATE, "sample", "dst"], "left_anti")
    n = added.groupBy(*STATE, "node").agg(F.count("*").alias("n"))
    return candidates.join(n, [*STATE, "node"], "left").select(*STATE, "node", (F.coalesce("n", F.lit(0)) / runs).alias("truth"))


def contested(edges: DataFrame, starts: DataFrame, runs: int, horizon: int, spreads: bool = True, seed: int = 0) -> DataFrame:
    """``graph_id, state, plan, sample, node, t, side``: two sides from ``starts(graph_id, state, plan, node, side)``.

    A node belongs to the side that reaches it first, to side 1 in a tie. Sides try an arc by coins of their own,
    drawn when its tail is reached. Without ``spreads`` side 1 only holds its nodes, as a dose does.
    """
    keys = [*STATE, "plan", "sample"]
    begun = starts.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    front = written(begun.groupBy(*keys, "node").agg(F.max("side").alias("side")).withColumn("t", F.lit(0)), "front")
    seen = front
    s = F.col("sample") + runs * seed
    draw = F.when(F.col("side") == 1, coin(F.col("node"), F.col("dst"), s, SIDES[1])).otherwise(coin(F.col("node"), F.col("dst"), s, SIDES[0]))
    for t in range(1, horizon + 1):
        tried = _of_graph(front if spreads else front.where("side = 0"), edges).where(draw < F.col("ic_p"))
        new = tried.groupBy(*keys, F.col("dst").alias("node")).agg(F.max("side").alias("side")).join(seen, [*keys, "node"], "left_anti")
        front = written(new.withColumn("t", F.lit(t)), "front")
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front), "seen")
    return seen


def ring(edges: DataFrame, active: DataFrame, most: int) -> DataFrame:
    """``graph_id, state, node``: the ``most`` smallest nodes one arc away from the active ones."""
    near = _of_graph(active, edges).select(*STATE, F.col("dst").alias("node")).distinct().join(active, [*STATE, "node"], "left_anti")
    return top_k(near.withColumn("score", F.lit(0)), most, by=STATE).select(*STATE, "node")


def predicted_prevention(model: DataFrame, active: DataFrame, candidates: DataFrame, spreads: bool = True) -> DataFrame:
    """``graph_id, state, node, predicted``: expected nodes of the next step that a candidate keeps from side 0."""
    hit = written(_hit(model, active), "hit")
    kept = candidates.join(hit, [*STATE, "node"], "left").select(*STATE, "node", F.coalesce("hit", F.lit(0.0)).alias("add"))
    if spreads:
        near = _of_graph(candidates, model).where("node <> dst").join(hit.withColumnRenamed("node", "dst"), [*STATE, "dst"]).select(*STATE, "node", (F.col("hit") * F.col("ic_p")).alias("add"))
        kept = kept.unionByName(near)
    return kept.groupBy(*STATE, "node").agg(F.sum("add").alias("predicted"))


def sampled_prevention(edges: DataFrame, active: DataFrame, candidates: DataFrame, runs: int, horizon: int, spreads: bool = True, seed: int = 0) -> DataFrame:
    """``graph_id, state, node, truth``: mean nodes that side 0 loses at the horizon when a candidate is taken first."""
    plans = candidates.select(*STATE, F.col("node").alias("plan")).unionByName(active.select(*STATE).distinct().withColumn("plan", F.lit(None).cast("long")))
    # plan null (no candidate) as -1, since null keys do not join
    plans = plans.withColumn("plan", F.coalesce("plan", F.lit(-1)))
    first = plans.where("plan >= 0").select(*STATE, "plan", F.col("plan").alias("node"), F.lit(1).alias("side"))
    starts = plans.join(active, STATE).select(*STATE, "plan", "node", F.lit(0).alias("side")).unionByName(first)
    over = contested(edges, starts, runs, horizon, spreads, seed).where("side = 0").groupBy(*STATE, "plan").agg((F.count("*") / runs).alias("reach"))
    free = over.where("plan < 0").select(*STATE, F.col("reach").alias("free"))
    return over.where("plan >= 0").join(free, STATE).select(*STATE, F.col("plan").alias("node"), (F.col("free") - F.col("reach")).alias("truth"))


def choice_regrets(judged: DataFrame, choosers: dict[str, list[Column]], by: list[str] | None = None) -> DataFrame:
    """``by, chooser, best, chosen, regret``: the best truth of a group's candidates and that of each chooser's pick.

    ``judged(by, node, truth, ...)``. A chooser takes the candidate with the greatest columns, one after the other;
    nulls are least, ties go to the smaller node. Scores are compared to nine places.
    """
    by = by or STATE
    picks = [F.max_by("truth", F.struct(*(F.round(c.cast("double"), 9) for c in cols), -F.col("node"))).alias(f"_{name}") for name, cols in choosers.items()]
    got = judged.groupBy(*by).agg(F.max("truth").alias("best"), *picks)
    each = F.array(*(F.struct(F.lit(name).alias("chooser"), F.col(f"_{name}").alias("chosen")) for name in choosers))
    return got.select(*by, "best", F.inline(each)).withColumn("regret", F.col("best") - F.col("chosen"))


def over_graphs(regrets: DataFrame) -> DataFrame:
    """``chooser, graphs, mean, std``: each graph's mean regret over its states, then mean and deviation over graphs."""
    per = regrets.groupBy("graph_id", "chooser").agg(F.avg("regret").alias("regret"))
    return per.groupBy("chooser").agg(F.count("*").alias("graphs"), F.avg("regret").alias("mean"), F.stddev_pop("regret").alias("std"))


def planning_regrets(edges: DataFrame, nodes: DataFrame, model: DataFrame, states: int = 4, share: float = 0.05, most: int = 20, runs: int = 8, seed: int = 0) -> DataFrame:
    """Regret of adding one node to a drawn state: by the model's expected gain, by degree, and by chance."""
    active = written(drawn_states(nodes, states, share, seed), "active")
    candidates = written(drawn_candidates(nodes, active, most, seed), "candidates")
    judged = sampled_gain(edges, active, candidates, runs, seed).join(predicted_gain(model, active, candidates), [*STATE, "node"]).join(degrees(edges), ["graph_id", "node"], "left")
    return choice_regrets(judged, {"model": [F.col("predicted")], "degree": [F.col("degree")], "random": [coin(F.col("node"), seed, F.col("state"), "mask")]})


def prevention_regrets(edges: DataFrame, nodes: DataFrame, model: DataFrame, states: int = 4, share: float = 0.01, most: int = 20, near: int = 5, runs: int = 8, horizon: int = 6, spreads: bool = True, seed: int = 0) -> DataFrame:
    """Regret of one blocker (or one dose, without ``spreads``) against a drawn outbreak.

    Candidates are drawn nodes and some of the ring around the outbreak. Choosers: the model's expected
    prevention, degree, chance, the ring's highest degree (``proximity``; without a ring, degree),
    and a drawn arc's head (``acquaintance``; without one, degree).
    """
    active = written(drawn_states(nodes, states, share, seed), "active")
    around = written(ring(edges, active, near), "ring")
    candidates = written(drawn_candidates(nodes, active, most, seed).unionByName(around).distinct(), "candidates")
    judged = sampled_prevention(edges, active, candidates, runs, horizon, spreads, seed).join(predicted_prevention(model, active, candidates, spreads), [*STATE, "node"]).join(degrees(edges), ["graph_id", "node"], "left")
    # a candidate is known by the drawn arcs that lead to it from other candidates
    met = _of_graph(candidates, edges).withColumn("_coin", coin(F.col("node"), F.col("dst"), F.col("state"), "tie"))
    known = met.select(*STATE, F.col("dst").alias("node"), "_coin").groupBy(*STATE, "node").agg(F.max("_coin").alias("known"))
    judged = judged.join(known, [*STATE, "node"], "left").join(around.withColumn("in_ring", F.lit(1)), [*STATE, "node"], "left")
    return choice_regrets(judged, {
        "model": [F.col("predicted")], "degree": [F.col("degree")], "random": [coin(F.col("node"), seed, F.col("state"), "mask")],
        "proximity": [F.col("in_ring"), F.col("degree")], "acquaintance": [F.col("known"), F.col("degree")],
    })
