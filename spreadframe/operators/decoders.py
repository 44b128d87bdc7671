"""Decoders of whole histories from partial reports: grown trees, Markov chains over histories, filtering.

``reports`` is ``node, time`` (null: infected at an unknown step). A history is ``node, time`` and,
once it is coherent, ``parent``. Every loop here keeps its state in written tables; the driver
sees one path or a few sums a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Graph, iterate
from ..functions.coins import coin
from ..shared import drop_table, written
from . import dynamics, inference

#: Probabilities of a step are kept this far from 0 and 1.
CLIP = 1e-12


# --- coherent histories


def explained(graph: Graph, times: DataFrame, horizon: int) -> DataFrame:
    """``node, time, parent``: a history in which every later node has an earlier in-neighbour.

    A node without one gets its likeliest in-neighbour at the step before, moved there if it came
    later; each round works towards step 0, so the horizon bounds the rounds. A node that nothing can
    explain is a source. Ties go to the smallest id.
    """
    arcs = written(graph.edges.select("src", "dst", "ic_p"), "arcs")

    def step(now: DataFrame, _: int) -> DataFrame:
        a, b = now.select(F.col("node").alias("src"), F.col("time").alias("ts")), now.where("time > 0").select(F.col("node").alias("dst"), F.col("time").alias("td"))
        tries = b.join(arcs, "dst").join(a, "src", "left").groupBy("dst", "td").agg(F.coalesce(F.max((F.col("ts") < F.col("td")).cast("int")), F.lit(0)).alias("ok"), F.max(F.struct("ic_p", (-F.col("src")).alias("s"))).alias("m"))
        added = tries.where("ok = 0").select((-F.col("m.s")).alias("node"), (F.col("td") - 1).alias("time"))
        return now.unionByName(added).groupBy("node").agg(F.min("time").alias("time"))

    size = lambda d: tuple(d.agg(F.count("*"), F.sum("time")).first())
    clamped = times.groupBy("node").agg(F.least(F.greatest(F.min("time").cast("int"), F.lit(0)), F.lit(horizon)).alias("time"))
    full = iterate(clamped, step, horizon + 2, lambda x, y: size(x) == size(y), "times")
    tree = inference.with_parents(graph, full)
    return tree.select("node", F.when(F.col("parent").isNull(), 0).otherwise(F.col("time")).cast("int").alias("time"), "parent")


def said_times(times: DataFrame, reports: DataFrame, horizon: int) -> DataFrame:
    """Reported steps in place of inferred ones."""
    said = reports.where("time is not null").groupBy("node").agg(F.least(F.greatest(F.min("time").cast("int"), F.lit(0)), F.lit(horizon)).alias("said"))
    return times.join(said, "node", "full_outer").select("node", F.coalesce("said", "time").cast("int").alias("time"))


def grown_tree(graph: Graph, reports: DataFrame, horizon: int, nearest: bool = True) -> DataFrame:
    """``node, time, parent``: a tree that takes in one report after the other along cheapest -log p paths.

    The first is the earliest report. Then the one closest to the tree comes next (``nearest``), or
    the earliest (unknown steps last). A path's inner nodes are spread evenly between the steps of
    its ends; an unreported end is as many steps on as the path has arcs. Path costs only fall
    as the tree grows, so each round relaxes what its new path improves. Reports out of reach are sources.
    """
    spark = graph.nodes.sparkSession
    arcs = written(graph.edges.groupBy("src", "dst").agg((-F.log(F.greatest(F.max("ic_p"), F.lit(1e-9)))).alias("w")), "costs")
    left = written(reports.groupBy("node").agg(F.min("time").cast("int").alias("time")), "left")
    first = left.orderBy(F.col("time").isNull(), "time", "node").first()
    if first is None:
        return spark.createDataFrame([], "node long, time int, parent long")
    row = lambda rows: spark.createDataFrame([(int(n), int(t)) for n, t in rows], "node long, time int")
    tree = written(row([(first["node"], first["time"] or 0)]), "tree")
    paths, grown = None, [first["node"]]
    while True:
        # costs from the new nodes on, as far as they fall
        front = spark.createDataFrame([(int(n), 0.0, [int(n)]) for n in grown], "node long, cost double, path array<long>")
        paths = written(front if paths is None else paths.join(front.select("node"), "node", "left_anti").unionByName(front), "paths")
        while True:
            more = front.join(arcs, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("path", F.array("dst")).alias("path")).groupBy("node").agg(F.min(F.struct("cost", "path")).alias("m")).select("node", "m.cost", "m.path")
            front = written(more.join(paths.select("node", F.col("cost").alias("had")), "node", "left").where("had is null or cost < had - 1e-12").drop("had"), "front")
            if front.isEmpty():
                break
            paths = written(paths.join(front.select("node"), "node", "left_anti").unionByName(front), "paths")
        left = written(left.join(tree, "node", "left_anti"), "left")
        order = [F.col("time").isNull(), "time", "node"] if not nearest else ["cost", "node"]
        best = left.join(paths, "node", "inner" if nearest else "left").orderBy(*order).first()
        if best is None:
            break
        if best["path"] is None:  # the earliest report is out of reach: a source of its own
            grown, steps = [best["node"]], [(best["node"], best["time"] or 0)]
        else:
            grown, span = best["path"], max(1, len(best["path"]) - 1)
            anchor = tree.where(F.col("node") == grown[0]).first()["time"]
            end = best["time"] if best["time"] is not None else min(horizon, anchor + span)
            end = end if nearest else max(end, anchor + 1)
            steps = [(n, max(0, min(anchor + round((end - anchor) * i / span), horizon))) for i, n in enumerate(grown)]
        new = row(steps)
        tree = written(tree.unionByName(new.join(tree, "node", "left_anti")), "tree")
        grown = [n for n in grown if best["path"] is None or n != best["path"][0]]
    rest = left.select("node", F.coalesce("time", F.lit(0)).alias("time"))
    return explained(graph, said_times(tree.unionByName(rest), reports, horizon), horizon)


# --- Markov chains over histories


def _clipped(p: Column) -> Column:
    return F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))


def log_terms(graph: Graph, arrivals: DataFrame, by: list[str], horizon: int) -> DataFrame:
    """``by, logp``: the share of a history's log-likelihood that belongs to single nodes.

    ``arrivals`` has ``by``, ``own`` (the node's step, null if never), ``ts`` (an in-neighbour's step,
    null if never) and ``p`` of its arc, one row for each in-neighbour or one with nulls. A node escapes
    at every step after an in-neighbour's up to its own, and must be caught at its own.
    """
    step = F.when((F.col("ts") + 1 <= F.coalesce("own", F.lit(horizon))) & (F.col("ts") < horizon), F.col("ts") + 1)
    steps = arrivals.groupBy(*by, "own", step.alias("s")).agg(F.sum(F.log1p(-F.least(F.col("p"), F.lit(1 - CLIP)))).alias("q"))
    caught, p = F.col("s") == F.col("own"), _clipped(1 - F.exp(F.col("q")))
    each = steps.withColumn("c", F.when(F.col("s").isNull(), 0.0).when(F.coalesce(caught, F.lit(False)), F.log(p)).otherwise(F.log1p(-p)))
    missed = (F.first("own") > 0) & ~F.coalesce(F.max(caught), F.lit(False))
    return each.groupBy(*by).agg((F.sum("c") + F.when(F.coalesce(missed, F.lit(False)), F.log(F.lit(CLIP))).otherwise(0.0)).alias("logp"))


def history_logprob(graph: Graph, history: DataFrame, horizon: int) -> DataFrame:
    """``logprob``: log-probability of ``node, time`` under independent cascade, every node's escapes and catch."""
    own, ts = history.select("node", F.col("time").alias("own")), history.select(F.col("node").alias("src"), F.col("time").alias("ts"))
    rows = graph.nodes.select("node").join(own, "node", "left").join(graph.edges.select("src", F.col("dst").alias("node"), F.col("ic_p").alias("p")), "node", "left").join(ts, "src", "left")
    return log_terms(graph, rows, ["node"], horizon).agg(F.sum("logp").alias("logprob"))


def chain_histories(graph: Graph, start: DataFrame, fixed: DataFrame, horizon: int, chains: int = 16, sweeps: int = 24, burn_in: float = 0.25, seed: int = 0) -> DataFrame:
    """``chain, node, time, best, score, best_score``: Metropolis-Hastings over the steps of a history.

    All chains run in one job a sweep, the chain being a key. A sweep moves many nodes at once: each node
    that may move (not in ``fixed``, not at step 0) draws a number, and those with the smallest
    number around every node whose likelihood they enter propose a step one earlier or later, so that no
    two proposals share a term and each is accepted on its own. Changes of the likelihood come from
    the arcs of the moved nodes alone. Draws are counters of node, sweep and chain. ``best`` is the
    step in the likeliest history that the chain met after its burn-in (the start, if none is likelier).
    Scores are relative to the start.
    """
    spark = graph.nodes.sparkSession
    arcs = written(graph.edges.groupBy("src", "dst").agg(F.max("ic_p").alias("p")), "arcs")
    movable = start.where("time > 0").select("node").distinct().join(fixed.select("node"), "node", "left_anti")
    touch = movable.select(F.col("node").alias("u"), F.col("node").alias("x")).unionByName(movable.join(arcs, F.col("node") == F.col("src")).select(F.col("node").alias("u"), F.col("dst").alias("x"))).distinct()
    touch = written(touch, "touch")
    every = spark.range(chains).select(F.col("id").cast("int").alias("chain"))
    state = written(start.select("node", F.col("time").cast("int").alias("time")).crossJoin(F.broadcast(every)).select("chain", "node", "time", F.col("time").alias("best"), F.lit(0.0).alias("score"), F.lit(0.0).alias("best_score")), "chains")
    for sweep in range(sweeps):
        at = seed * sweeps + sweep
        drawn = touch.crossJoin(F.broadcast(every)).withColumn("draw", F.struct(coin(F.col("u"), at, F.col("chain"), "tie").alias("c"), F.col("u").alias("who")))
        least = drawn.groupBy("chain", "x").agg(F.min("draw").alias("least"))
        winners = drawn.join(least, ["chain", "x"]).groupBy("chain", "u").agg(F.min((F.col("least.who") == F.col("u")).cast("int")).alias("w")).where("w = 1").select("chain", F.col("u").alias("node"))
        shift = F.when(coin(F.col("node"), at, F.col("chain"), "pick") < 0.5, 1).otherwise(-1)
        moves = written(winners.join(state, ["chain", "node"]).select("chain", "node", "time", F.greatest(F.lit(1), F.least(F.lit(horizon), F.col("time") + shift)).alias("new")).where("new <> time").drop("time"), "moves")
        # the terms that a move enters, before and after it
        entered = moves.join(touch, F.col("node") == F.col("u")).select("chain", "u", "x")
        now = state.select("chain", "node", "time").join(moves, ["chain", "node"], "left").select("chain", "node", "time", F.coalesce("new", "time").alias("new"))
        own = now.select("chain", F.col("node").alias("x"), F.col("time").alias("own0"), F.col("new").alias("own1"))
        near = now.select("chain", F.col("node").alias("src"), F.col("time").alias("ts0"), F.col("new").alias("ts1"))
        rows = entered.join(own, ["chain", "x"], "left").join(arcs.withColumnRenamed("dst", "x"), "x", "left").join(near, ["chain", "src"], "left")
        both = rows.select("chain", "u", "x", "p", F.explode(F.array(F.struct(F.lit(-1.0).alias("sign"), F.col("own0").alias("own"), F.col("ts0").alias("ts")), F.struct(F.lit(1.0).alias("sign"), F.col("own1").alias("own"), F.col("ts1").alias("ts")))).alias("v")).select("chain", "u", "x", "p", "v.*")
        gain = log_terms(graph, both, ["chain", "u", "x", "sign"], horizon).groupBy("chain", "u").agg(F.sum(F.col("sign") * F.col("logp")).alias("delta"))
        accepted = gain.where(F.log(F.greatest(coin(F.col("u"), at, F.col("chain"), "split"), F.lit(CLIP))) < F.col("delta")).withColumnRenamed("u", "node")
        taken = written(accepted.join(moves, ["chain", "node"]).select("chain", "node", "new", "delta"), "taken")
        total = taken.groupBy("chain").agg(F.sum("delta").alias("gain"))
        moved = state.join(taken.select("chain", "node", "new"), ["chain", "node"], "left").join(total, "chain", "left").withColumn("time", F.coalesce("new", "time")).withColumn("score", F.col("score") + F.coalesce("gain", F.lit(0.0)))
        better = (F.col("score") > F.col("best_score")) & F.lit(sweep >= int(sweeps * burn_in))
        later = written(moved.select("chain", "node", "time", F.when(better, F.col("time")).otherwise(F.col("best")).alias("best"), "score", F.when(better, F.col("score")).otherwise(F.col("best_score")).alias("best_score")), "chains")
        for t in (state, moves, taken):
            drop_table(t)
        state = later
    return state


def mcmc_decode(graph: Graph, reports: DataFrame, horizon: int, chains: int = 16, sweeps: int = 24, burn_in: float = 0.25, seed: int = 0) -> DataFrame:
    """``node, time, parent``: the likeliest history that any chain met, started from the grown tree in order of time."""
    start = written(grown_tree(graph, reports, horizon, nearest=False).select("node", "time"), "start")
    found = written(chain_histories(graph, start, reports.where("time is not null"), horizon, chains, sweeps, burn_in, seed), "found")
    best = found.groupBy("chain").agg(F.max("best_score").alias("s")).orderBy(F.desc("s"), "chain").first()
    times = found.where(F.col("chain") == (best["chain"] if best else 0)).select("node", F.col("best").alias("time"))
    return explained(graph, said_times(times, reports, horizon), horizon)


# --- filtering


def forward_backward(graph: Graph, reports: DataFrame, horizon: int, particles: int = 24, seed: int = 0) -> DataFrame:
    """``node, time, parent``: forward filtering of the marginals, then steps given back under the reported ones.

    A step's marginals come from the last wave; a node joins the next wave if at least half of its
    particles catch it, and in any case if it is reported there. Backwards, nodes take the step of
    their wave, reported ones what the report says; nodes the filter never met keep their step in
    the grown tree, whose sources start the filter.
    """
    tree = written(grown_tree(graph, reports, horizon, nearest=False).select("node", "time"), "start")
    said = written(reports.where("time is not null").groupBy("node").agg(F.min("time").cast("int").alias("time")), "said")
    seen = written(tree.where("time = 0").select("node", F.lit(0).alias("time")), "seen")
    wave = seen
    for t in range(1, horizon + 1):
        if wave.isEmpty():
            break
        p = dynamics.ic_step_marginals(graph, seen, wave).join(seen.select("node"), "node", "left_anti").where("p > 0")
        drawn = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(particles - 1)))).groupBy("node").agg(F.avg((coin(F.col("node"), t, F.col("k") + particles * seed, "mask") < F.col("p")).cast("int")).alias("share"))
        met = drawn.where("share >= 0.5").select("node").unionByName(said.where(F.col("time") == t).select("node")).distinct()
        wave = written(met.join(seen.select("node"), "node", "left_anti").select("node", F.lit(t).alias("time")), "wave")
        seen = written(seen.unionByName(wave), "seen")
    times = seen.unionByName(tree.join(seen.select("node"), "node", "left_anti"))
    return explained(graph, said_times(times, reports, horizon), horizon)
