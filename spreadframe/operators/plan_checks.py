"""Action logs as tables: what is refused and why, what a bare action means, and what a selection becomes.

A log has ``plan, t, seq, op, target, destination, weight``; ``seq`` orders a step's actions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import undirected
from ..shared import written

#: Ops that name an arc.
ARC_OPS = ("add_edge", "remove_edge", "set_edge_weight")
KEY = ["plan", "op", "target", "destination"]
#: Neighbours in a list that travels as one row, about, and pairs that a task lays out.
LIST, ROWS = 4096, 500_000


def checked_actions(log: DataFrame, nodes: DataFrame, edges: DataFrame, allowed: list[str], budget_op: str, budget: int, protected: DataFrame) -> DataFrame:
    """Every action with ``reason`` (null: fine), ``spent`` and ``left`` (units of the budget after it).

    In this order: ``op`` (not allowed), ``range`` (no such node), ``protected`` (removal of a protected node),
    ``arc`` (no such arc to weaken), ``weight`` (raised above the arc's), ``repeat`` (a budgeted target that
    the plan acted on before) and ``budget``. The first of a target spends a unit whatever is wrong with it;
    a repeat spends none. A plan's log is ordered in one task.
    """
    arc = F.col("op").isin(*ARC_OPS)
    own = log.withColumn("destination", F.when(arc, F.col("destination"))).withColumn("paid", F.col("op") == budget_op)
    known = nodes.select(F.col("node").alias("target"), F.lit(True).alias("known"))
    guard = protected.select(F.col("node").alias("target"), F.lit(True).alias("guarded")).distinct()
    caps = edges.groupBy(F.col("src").alias("target"), F.col("dst").alias("destination")).agg(F.max("ic_p").alias("cap"))
    j = own.join(known, "target", "left").join(guard, "target", "left").join(caps, ["target", "destination"], "left")
    first = Window.partitionBy(*KEY).orderBy("t", "seq")
    j = j.withColumn("again", F.col("paid") & (F.row_number().over(first) > 1))
    order = Window.partitionBy("plan").orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("spent", F.sum((F.col("paid") & ~F.col("again")).cast("long")).over(order))
    weaken = F.col("op") == "set_edge_weight"
    reason = (
        F.when(~F.col("op").isin(*allowed), "op").when(F.col("known").isNull(), "range").when((F.col("op") == "remove_node") & F.col("guarded").isNotNull(), "protected")
        .when(weaken & F.col("cap").isNull(), "arc").when(weaken & (F.col("weight") > F.col("cap")), "weight").when(F.col("again"), "repeat").when(F.col("paid") & (F.col("spent") > budget), "budget")
    )
    return j.select(*log.columns, reason.alias("reason"), "spent", F.greatest(F.lit(0), budget - F.col("spent")).cast("long").alias("left"))


def plan_verdicts(checked: DataFrame) -> DataFrame:
    """``plan, valid, t, seq, reason, spent``: the first refusal of each plan, nulls if there is none."""
    bad = F.min(F.when(F.col("reason").isNotNull(), F.struct("t", "seq", "reason")))
    return checked.groupBy("plan").agg(bad.alias("b"), F.max("spent").alias("spent")).select("plan", F.col("b").isNull().alias("valid"), "b.t", "b.seq", "b.reason", "spent")


def expanded_actions(log: DataFrame, edges: DataFrame, isolate: bool = False) -> DataFrame:
    """``plan, t, seq, sub, op, target, destination``: each bare removal with the arcs that go with it, each action once a step.

    A removed node loses its arcs both ways; with ``isolate`` it stays and only they go. Other actions pass.
    Of equal actions of a step the first stays, so expanding again changes nothing.
    """
    removal, ends = F.col("op") == "remove_node", F.when(F.col("op").isin(*ARC_OPS), F.col("destination"))
    arc = (F.col("op") == "remove_edge") & F.col("destination").isNotNull() & (F.col("target") != F.col("destination"))
    others = log.where(~F.coalesce(arc, F.lit(False)) & (~removal if isolate else F.lit(True)))
    others = others.groupBy("plan", "t", "op", "target", ends.alias("destination")).agg(F.min("seq").alias("seq")).select("plan", "t", "seq", F.lit(0).cast("long").alias("sub"), "op", "target", "destination")

    # neighbours travel in lists, and are laid out only where their plan and step already are
    near = written(undirected(edges).select(F.col("src").alias("target"), F.col("dst").alias("near")), "near")
    degree = near.groupBy("target").agg(F.count("*").alias("degree"))
    dealt = F.pmod(F.xxhash64("near"), F.ceil(F.col("degree") / LIST))
    lists = near.join(degree, "target").groupBy("target", dealt.alias("part")).agg(F.collect_list("near").alias("near")).drop("part")
    removed = log.where(removal).groupBy("plan", "t", "target").agg(F.min("seq").alias("seq"))
    named = log.where(arc).groupBy("plan", "t", "target", "destination").agg(F.min("seq").alias("seq"))
    rows = removed.join(degree, "target").agg(F.sum("degree")).first()[0] or 0
    width = max(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // ROWS + 1)
    sent = removed.join(lists, "target").select("plan", "t", "seq", F.lit(False).alias("own"), "target", "near").unionByName(
        named.select("plan", "t", "seq", F.lit(True).alias("own"), "target", F.array("destination").alias("near"))
    ).repartition(width, "plan", "t")
    pairs = sent.withColumn("near", F.explode("near")).withColumn("lo", F.least("target", "near")).withColumn("hi", F.greatest("target", "near"))
    own, low = F.col("own"), F.col("target") == F.col("lo")
    least = lambda when, name: F.min(F.when(when, F.col("seq"))).alias(name)
    pairs = pairs.groupBy("plan", "t", "lo", "hi").agg(least(~own & low, "by_lo"), least(~own & ~low, "by_hi"), least(own & low, "up"), least(own & ~low, "down"))
    at = lambda seq, sub: F.when(F.col(seq).isNotNull(), F.struct(F.col(seq).alias("seq"), sub.cast("long").alias("sub")))
    lo, hi = F.col("lo"), F.col("hi")
    first_up, first_down = F.least(at("by_lo", 2 * hi + 1), at("by_hi", 2 * lo + 2), at("up", F.lit(0))), F.least(at("by_hi", 2 * lo + 1), at("by_lo", 2 * hi + 2), at("down", F.lit(0)))
    both = F.array(F.struct(lo.alias("target"), hi.alias("destination"), first_up.alias("m")), F.struct(hi.alias("target"), lo.alias("destination"), first_down.alias("m")))
    arcs = pairs.select("plan", "t", F.explode(both).alias("s")).where("s.m is not null")
    return others.unionByName(arcs.select("plan", "t", "s.m.seq", "s.m.sub", F.lit("remove_edge").alias("op"), "s.target", "s.destination"))


def filled_plans(picks: DataFrame, scores: DataFrame, budget: int, protected: DataFrame) -> DataFrame:
    """``plan, node, turn``: each plan's first picks that are not protected, each once, filled up to the budget by score.

    ``picks`` has plan, rank, node; ``scores`` node, score (ties to the smallest id). Twice the budget and as many more
    as are protected are enough of the best to fill any plan from.
    """
    guard = protected.select("node").distinct()
    own = picks.groupBy("plan", "node").agg(F.min("rank").alias("rank")).join(guard, "node", "left_anti")
    kept = own.withColumn("turn", F.row_number().over(Window.partitionBy("plan").orderBy("rank", "node"))).where(F.col("turn") <= budget).select("plan", "node", "turn")
    short = picks.select("plan").distinct().join(kept.groupBy("plan").agg(F.count("*").alias("n")), "plan", "left").select("plan", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < budget)
    best = scores.join(guard, "node", "left_anti").orderBy(F.desc("score"), "node").limit(2 * budget)
    more = short.crossJoin(F.broadcast(best)).join(kept, ["plan", "node"], "left_anti")
    more = more.withColumn("turn", F.col("n") + F.row_number().over(Window.partitionBy("plan").orderBy(F.desc("score"), "node"))).where(F.col("turn") <= budget)
    return kept.unionByName(more.select("plan", "node", "turn"))


def targets_in_order(log: DataFrame, op: str = "remove_node") -> DataFrame:
    """``plan, node, turn``: the distinct targets of an op in the order in which a finished log acts on them."""
    first = log.where(F.col("op") == op).groupBy("plan", F.col("target").alias("node")).agg(F.min(F.struct("t", "seq")).alias("at"))
    return first.select("plan", "node", F.row_number().over(Window.partitionBy("plan").orderBy("at", "node")).alias("turn"))


def weak_runs(coverage: DataFrame) -> DataFrame:
    """``region, first, last, turns, max_coverage``: unbroken runs of turns in which a region is weak.

    ``coverage`` has region, turn (whole numbers, one row each) and coverage, weak. A turn's number less its place
    among the region's weak turns is the same within a run.
    """
    weak = coverage.where("weak").withColumn("island", F.col("turn") - F.row_number().over(Window.partitionBy("region").orderBy("turn")))
    return weak.groupBy("region", "island").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count("*").alias("turns"), F.max("coverage").alias("max_coverage")).drop("island")


def persistent_weakness(coverage: DataFrame, window: int) -> DataFrame:
    """``region, turns, max_coverage``: regions that were weak in each of the last ``window`` turns of the history.

    Nothing if the history is shorter. max_coverage is the best of those turns.
    """
    ends = coverage.agg(F.max("turn").alias("end"), F.count_distinct("turn").alias("have"))
    inside = coverage.crossJoin(F.broadcast(ends)).where((F.col("turn") > F.col("end") - window) & (F.col("have") >= window))
    return inside.where("weak").groupBy("region").agg(F.count("*").alias("turns"), F.max("coverage").alias("max_coverage")).where(F.col("turns") == window)
