"""Seeding in rounds: policies that choose anew in every realisation from what it has shown so far.

All realisations run in one job: ``sample`` is a key of every table, a step of all of them
is one join and one aggregation, and a policy answers for all samples at once. The driver
sees whether a step reached anyone, never a node.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import Graph
from ..functions.coins import coin
from ..shared import written
from . import dynamics, structure
from .selectors import reverse_sets

#: ``(seen(sample, node, t), worlds(sample), batch, time) -> picks(sample, node)``
Policy = Callable[[DataFrame, DataFrame, int, int], DataFrame]


def round_schedule(batches: list[int], gap: int, horizon: int) -> dict[int, int]:
    """Time and size of each batch; a batch past the horizon would never be spent and is refused."""
    if gap < 1:
        raise ValueError(f"rounds need a gap of at least 1, not {gap}")
    if (len(batches) - 1) * gap > horizon:
        raise ValueError(f"{len(batches)} rounds {gap} apart do not fit in {horizon} steps")
    return {i * gap: n for i, n in enumerate(batches)}


def observed_state(state: DataFrame, time: int, feedback: str = "full") -> DataFrame:
    """What a policy may read of ``state(sample, node, t)`` at ``time``: all of it, or (``myopic``) the last wave."""
    if feedback not in ("full", "myopic"):
        raise ValueError(f"feedback is full or myopic, not {feedback!r}")
    until = state.where(F.col("t") <= time)
    return until if feedback == "full" else until.where(F.col("t") == time)


def rollout(graph: Graph, policy: Policy, batches: list[int], gap: int, horizon: int, runs: int, seed: int = 0, feedback: str = "full") -> DataFrame:
    """``sample, node, t, seeded``: independent cascades of ``runs`` realisations, seeded in rounds by ``policy``.

    Batch i is placed at time i * gap, before that time's spread; picks spread from then on.
    A policy with full feedback that picks a reached node is in error and refused; with
    myopic feedback the pick is spent without effect. More picks than the batch are refused.
    """
    schedule = round_schedule(batches, gap, horizon)
    spark = graph.nodes.sparkSession
    worlds = spark.range(runs).select(F.col("id").cast("int").alias("sample"))
    live = written(dynamics.live_edges(graph, runs, seed), "live")
    state: DataFrame | None = None
    front = None
    for t in range(horizon + 1):
        wave = None
        if front is not None:
            reached = front.join(live, (front["sample"] == live["sample"]) & (front["node"] == live["src"])).select(front["sample"], F.col("dst").alias("node")).distinct()
            wave = reached.join(state, ["sample", "node"], "left_anti").select("sample", "node", F.lit(t).alias("t"), F.lit(False).alias("seeded"))
            wave = written(wave, "wave")
            state = state.unionByName(wave)
        if t in schedule:
            seen = state if state is not None else spark.createDataFrame([], "sample int, node long, t int, seeded boolean")
            picks = written(policy(observed_state(seen, t, feedback), worlds, schedule[t], t).select("sample", "node").distinct(), "picks")
            if not picks.groupBy("sample").count().where(F.col("count") > schedule[t]).isEmpty():
                raise ValueError(f"the policy picks more than {schedule[t]} nodes at {t}")
            if feedback == "full" and not picks.join(seen, ["sample", "node"], "left_semi").isEmpty():
                raise ValueError(f"the policy picks a node at {t} that the cascade has reached")
            placed = picks.join(seen, ["sample", "node"], "left_anti").select("sample", "node", F.lit(t).alias("t"), F.lit(True).alias("seeded"))
            placed = written(placed, "placed")
            state = placed if state is None else state.unionByName(placed)
            front = placed if wave is None else wave.unionByName(placed)
        else:
            front = wave
        if front is None or (t > max(schedule) and front.isEmpty()):
            break
    return written(state, "rounds")


def round_spreads(history: DataFrame, rounds: int, gap: int, horizon: int, runs: int) -> DataFrame:
    """``round, t, spread``: mean number reached one step after each round; rounds without that step have no row."""
    at = [(i + 1, i * gap + 1) for i in range(rounds) if i * gap + 1 <= horizon]
    times = history.sparkSession.createDataFrame(at, "round long, at long")
    counts = history.groupBy("t").agg(F.count("*").alias("n"))  # a row a step
    j = times.join(F.broadcast(counts), F.col("t") <= F.col("at"), "left")
    return j.groupBy("round", "at").agg((F.coalesce(F.sum("n"), F.lit(0)) / runs).alias("spread")).select("round", F.col("at").alias("t"), "spread")


# --- policies


def _unreached(scores: DataFrame, worlds: DataFrame, seen: DataFrame) -> DataFrame:
    """``sample`` and the columns of ``scores(node, ..)`` for every node not seen in that sample."""
    samples = worlds.agg(F.collect_list("sample").alias("all"))  # a short list of realisations
    return scores.join(F.broadcast(samples)).withColumn("sample", F.explode("all")).drop("all").join(seen, ["sample", "node"], "left_anti")


def _first(rows: DataFrame, batch: int, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("sample").orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= batch)


def by_ranking(scores: DataFrame) -> Policy:
    """The best unreached nodes by ``scores(node, score)``, ties to the smallest id.

    With degree or PageRank this is the adaptive heuristic; with the scores of a static
    plan it is that plan dealt out in batches, the control for what adapting gains.
    """
    scores = written(scores.select("node", F.col("score").cast("double").alias("score")), "scores")
    return lambda seen, worlds, batch, time: _first(_unreached(scores, worlds, seen), batch, F.desc("score"), F.asc("node"))


def at_random(graph: Graph, seed: int = 0) -> Policy:
    """Unreached nodes by a coin of node, realisation and round."""
    def pick(seen, worlds, batch, time):
        drawn = _unreached(graph.nodes.select("node"), worlds, seen).withColumn("score", coin(F.col("node"), F.col("sample"), time + 4096 * seed, "pick"))
        return _first(drawn, batch, F.asc("score"), F.asc("node"))

    return pick


def by_discounted_degree(graph: Graph) -> Policy:
    """Degree less one for every arc to or from a reached node, and within a batch less one for every arc with an earlier pick."""
    ends = written(graph.edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(graph.edges.select(F.col("dst").alias("node"), F.col("src").alias("other"))), "ends")
    degree = written(structure.degree(graph).select("node", "score"), "degree")

    def pick(seen, worlds, batch, time):
        def losses(nodes: DataFrame) -> DataFrame:
            return nodes.select("sample", F.col("node").alias("other")).join(ends, "other").groupBy("sample", "node").agg(F.count("*").alias("less"))

        base = _unreached(degree, worlds, seen).join(losses(seen), ["sample", "node"], "left")
        left = written(base.select("sample", "node", (F.col("score") - F.coalesce("less", F.lit(0))).alias("score")), "left")
        chosen = None
        for _ in range(batch):
            now = left
            if chosen is not None:
                now = left.join(chosen, ["sample", "node"], "left_anti").join(losses(chosen), ["sample", "node"], "left").select("sample", "node", (F.col("score") - F.coalesce("less", F.lit(0))).alias("score"))
            best = written(_first(now, 1, F.desc("score"), F.asc("node")).select("sample", "node"), "best")
            chosen = best if chosen is None else chosen.unionByName(best)
        return chosen

    return pick


def by_marginal_gain(graph: Graph, candidates: int = 40, runs: int = 8, horizon: int = 10, seed: int = 1000) -> Policy:
    """Greedy by the gain over what each realisation has reached, among its ``candidates`` unreached nodes of highest degree.

    Gains are measured in ``runs`` worlds of their own. A node reaches the same nodes of a
    world whatever is seeded beside it, so a candidate's reach is taken once for all
    realisations, and its gain is the part that a realisation's reached nodes and earlier
    picks do not reach within the horizon. Ties go to the higher degree, then the smaller id.
    """
    degree = written(structure.degree(graph).select("node", "score"), "degree")
    worlds_of_model = written(dynamics.live_edges(graph, runs, seed), "model")

    def reach(starts: DataFrame, key: str) -> DataFrame:
        return written(dynamics.spread_over(worlds_of_model, dynamics.samples(starts, runs), horizon).select(key, F.col("sample").alias("world"), "node").distinct(), "reach")

    def pick(seen, worlds, batch, time):
        pool = written(_first(_unreached(degree, worlds, seen), candidates, F.desc("score"), F.asc("node")).select("sample", F.col("node").alias("cand"), "place"), "pool")
        own = reach(pool.select("cand", F.col("cand").alias("node")).distinct(), "cand")
        held = reach(seen.select(F.col("sample").alias("real"), "node"), "real").withColumnRenamed("real", "sample")
        chosen = None
        for _ in range(batch):
            left = pool if chosen is None else pool.join(chosen, ["sample", "cand"], "left_anti")
            adds = left.join(own, "cand").join(held, ["sample", "world", "node"], "left_anti").groupBy("sample", "cand").agg(F.count("*").alias("gain"))
            scored = left.join(adds, ["sample", "cand"], "left").withColumn("gain", F.coalesce("gain", F.lit(0)))
            best = scored.groupBy("sample").agg(F.max(F.struct("gain", (-F.col("place")).alias("p"), "cand")).alias("b")).select("sample", F.col("b.cand").alias("cand"))
            best = written(best, "best")
            chosen = best if chosen is None else chosen.unionByName(best)
            held = held.unionByName(best.join(own, "cand").select("sample", "world", "node"))
        return chosen.withColumnRenamed("cand", "node")

    return pick


def by_uncovered_sets(graph: Graph, theta: int, seed: int = 7) -> Policy:
    """Greedy cover, in each realisation, of the reverse-reachable sets that hold no reached node.

    The sets depend on the graph alone and are drawn once. A node's count is its count over
    all sets less that over covered ones, so only covered sets are spread over realisations.
    Ties go to the smallest id; a realisation whose sets are all covered takes the highest degree.
    """
    sets = written(reverse_sets(graph, theta, seed).select("rr_id", "node"), "sets")
    n_sets = sets.select("rr_id").distinct().count()
    totals = sets.groupBy("node").agg(F.count("*").alias("n"))
    base = written(structure.degree(graph).select("node", F.col("score").alias("degree")).join(totals, "node", "left").select("node", "degree", F.coalesce("n", F.lit(0)).alias("n")), "totals")

    def pick(seen, worlds, batch, time):
        covered = written(seen.select("sample", "node").join(sets, "node").select("sample", "rr_id").distinct(), "covered")
        spent = covered.groupBy("sample").count().where(F.col("count") >= n_sets).select("sample", F.lit(True).alias("spent"))
        left = written(_unreached(base, worlds, seen).join(F.broadcast(spent), "sample", "left").withColumn("plain", F.when(F.col("spent"), F.col("degree")).otherwise(F.lit(0.0))), "left")
        chosen = None
        for _ in range(batch):
            less = covered.join(sets, "rr_id").groupBy("sample", "node").agg(F.count("*").alias("less"))
            now = left if chosen is None else left.join(chosen, ["sample", "node"], "left_anti")
            scored = now.join(less, ["sample", "node"], "left").withColumn("gain", F.col("n") - F.coalesce("less", F.lit(0)))
            best = written(_first(scored, 1, F.desc("gain"), F.desc("plain"), F.asc("node")).select("sample", "node"), "best")
            chosen = best if chosen is None else chosen.unionByName(best)
            covered = written(covered.unionByName(best.join(sets, "node").select("sample", "rr_id")).distinct(), "covered")
        return chosen

    return pick
