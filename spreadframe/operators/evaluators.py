"""Evaluation of localisers, decoders and forecasts over many instances at once: refusals, scores per instance, rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .metrics import _f1, _n

#: Residuals from here on are named over or under.
RESIDUAL = 0.25
#: Share of the tree in the reward of a reconstruction.
TREE = 0.6
#: Relative error from which a forecast counts as wrong.
WRONG = 0.5


# --- localisation


def source_refusals(named: DataFrame, nodes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``named(instance, rank, node)`` with ``reason``, null if legal: out of range, a duplicate, or over the budget.

    The first reason of these counts; of repeated nodes the first keeps its place. ``budgets(instance, budget)``;
    an instance without a budget may name nothing.
    """
    again = F.row_number().over(Window.partitionBy("instance", "node").orderBy("rank")) > 1
    placed = F.row_number().over(Window.partitionBy("instance").orderBy("rank", "node"))
    j = named.withColumns({"_again": again, "_place": placed}).join(nodes.select("node", F.lit(True).alias("_known")), "node", "left").join(budgets, "instance", "left")
    reason = F.when(F.col("_known").isNull(), "range").when(F.col("_again"), "duplicate").when(F.col("_place") > F.coalesce("budget", F.lit(0)), "budget")
    return j.select("instance", "rank", "node", reason.alias("reason"))


def consistency(named: DataFrame, observation: DataFrame, simulated: DataFrame, threshold: float = RESIDUAL) -> DataFrame:
    """Per instance, how well the named sources' cascade explains what was seen; no label is read.

    ``observation(instance, node, y)`` holds every node, ``simulated(instance, node, p)`` those that the named
    sources may reach. Gives consistency (minus the mean squared error), resim_error, n_named, n_over, n_under.
    """
    gap = F.coalesce("p", F.lit(0.0)) - F.col("y")
    seen = observation.join(simulated, ["instance", "node"], "left").withColumn("_gap", F.round(gap, 9))
    per = seen.groupBy("instance").agg(F.avg(F.col("_gap") * F.col("_gap")).alias("resim_error"), F.count_if(F.col("_gap") >= threshold).alias("n_over"), F.count_if(F.col("_gap") <= -threshold).alias("n_under"))
    n = named.groupBy("instance").agg(F.count("*").alias("n_named"))
    return per.join(n, "instance", "left").select("instance", (-F.col("resim_error")).alias("consistency"), "resim_error", F.coalesce("n_named", F.lit(0)).alias("n_named"), "n_over", "n_under")


def localization_labels(named: DataFrame, truth: DataFrame, totals: DataFrame) -> DataFrame:
    """Per instance: precision, recall, f1, accuracy and auc of named against true sources, and their numbers.

    ``named(instance, rank, node)``, ``truth(instance, node)``, ``totals(instance, n_nodes)``. The score of a named node falls with
    its rank, all others tie below; auc is null if all nodes or none are sources.
    """
    hits = named.join(truth.withColumn("_true", F.lit(1)), ["instance", "node"], "left").withColumn("_true", F.coalesce("_true", F.lit(0)))
    before = F.coalesce(F.sum(1 - F.col("_true")).over(Window.partitionBy("instance").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = hits.withColumn("_before", before).groupBy("instance").agg(F.count("*").alias("n_predicted"), F.sum("_true").alias("true_positive"), F.sum(F.col("_true") * F.col("_before")).alias("_passed"))
    sources = truth.groupBy("instance").agg(F.count("*").alias("n_sources"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    j = totals.join(sources, "instance", "left").join(per, "instance", "left").select("instance", "n_nodes", *(zero(F.col(c)).alias(c) for c in ("n_sources", "n_predicted", "true_positive", "_passed")))
    tp, named_n, src, n = F.col("true_positive"), F.col("n_predicted"), F.col("n_sources"), F.col("n_nodes")
    others, wrong = n - src, named_n - tp
    # named sources beat the others not named before them; sources not named tie with all others not named
    wins = tp * others - F.col("_passed") + (src - tp) * (others - wrong) / 2
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return j.select("instance", ratio(tp, named_n).alias("precision"), ratio(tp, src).alias("recall"), ratio(2.0 * tp, named_n + src).alias("f1"), ((n - wrong - (src - tp)) / n).alias("accuracy"), F.try_divide(wins, F.nullif(src * others, F.lit(0))).alias("auc"), "n_predicted", "n_sources", "true_positive")


def means(per_instance: DataFrame, values: list[str]) -> DataFrame:
    """One row: the number of instances and the mean of each value over those that have it."""
    return per_instance.agg(F.count("*").alias("instances"), *(F.avg(F.when(~F.isnan(F.col(v).cast("double")), F.col(v))).alias(v) for v in values))


# --- reconstruction


def decoded_refusals(decoded: DataFrame, nodes: DataFrame, edges: DataFrame, horizon: int, hidden: DataFrame | None = None) -> DataFrame:
    """``decoded(instance, node, time, parent)`` with ``reason``, null if the row is coherent; the first that holds counts.

    range: no such node; hidden; horizon: a time outside 0 to the horizon, or none; orphan: no parent after step 0; early: a parent at step 0;
    parent: no such parent; arc: no arc from the parent; hidden_parent. ``hidden(instance, node)``.
    """
    known = nodes.select("node")
    j = decoded.join(known.withColumn("_node", F.lit(True)), "node", "left").join(known.select(F.col("node").alias("parent"), F.lit(True).alias("_parent")), "parent", "left")
    j = j.join(edges.select(F.col("src").alias("parent"), F.col("dst").alias("node"), F.lit(True).alias("_arc")).distinct(), ["parent", "node"], "left")
    no = F.lit(False)
    veiled, veiled_parent = no, no
    if hidden is not None:
        h = hidden.select("instance", "node").distinct()
        j = j.join(h.withColumn("_hidden", F.lit(True)), ["instance", "node"], "left").join(h.select("instance", F.col("node").alias("parent"), F.lit(True).alias("_veiled")), ["instance", "parent"], "left")
        veiled, veiled_parent = F.col("_hidden").isNotNull(), F.col("_veiled").isNotNull()
    t, p = F.col("time"), F.col("parent")
    reason = (
        F.when(F.col("_node").isNull(), "range").when(veiled, "hidden").when(t.isNull() | (t < 0) | (t > horizon), "horizon").when(p.isNull() & (t > 0), "orphan").when(p.isNotNull() & (t == 0), "early")
        .when(p.isNotNull() & F.col("_parent").isNull(), "parent").when(p.isNotNull() & F.col("_arc").isNull(), "arc").when(veiled_parent, "hidden_parent")
    )
    return j.select("instance", "node", "time", "parent", reason.alias("reason"))


def reconstruction_rewards(decoded: DataFrame, truth: DataFrame, tree_weight: float = TREE) -> DataFrame:
    """Per instance: event f1, path precision, path recall, order accuracy and the tree-weighted reward, from ``instance, node, time, parent``.

    An event is a node at its time. The tree is scored by the precision of its arcs; where the truth has no
    arcs, the reward is the event f1 alone.
    """
    on = ["instance", "node"]
    a = decoded.select(*on, F.col("time").alias("pt"), F.col("parent").alias("pp"))
    j = a.join(truth.select(*on, F.col("time").alias("tt"), F.col("parent").alias("tp")), on, "full_outer")
    j = j.join(decoded.select("instance", F.col("node").alias("pp"), F.col("time").alias("_before")), ["instance", "pp"], "left")
    event, path = F.col("pt") == F.col("tt"), F.col("pp") == F.col("tp")
    events, had, has = _n(event), F.count("pt"), F.count("tt")
    paths, ours, theirs = _n(path), F.count("pp"), F.count("tp")
    got = j.groupBy("instance").agg(
        _f1(events, had - events, has - events).alias("event_f1"), F.when(theirs > 0, F.coalesce(F.try_divide(paths, ours), F.lit(0.0))).alias("path_precision"), F.try_divide(paths, theirs).alias("path_recall"),
        F.coalesce(F.try_divide(_n(F.col("_before") <= F.col("pt")), ours), F.lit(0.0)).alias("order_accuracy"),
    )
    return got.withColumn("reward", F.coalesce(tree_weight * F.col("path_precision") + (1 - tree_weight) * F.col("event_f1"), F.col("event_f1")))


# --- forecasts


def _log(x: Column) -> Column:
    return F.log2(F.greatest(x, F.lit(1.0)))


#: The error of one forecast ``p`` of a size ``a`` of which ``o`` was seen; each metric is a mean of these.
TERMS = {
    "msle": lambda p, a, o: F.pow(_log(p) - _log(a), F.lit(2.0)),
    "male": lambda p, a, o: F.abs(_log(p) - _log(a)),
    "msle_offset": lambda p, a, o: F.pow(F.log2(p + 1) - F.log2(a + 1), F.lit(2.0)),
    "msle_natural": lambda p, a, o: F.pow(F.log(F.greatest(p, F.lit(1.0))) - F.log(F.greatest(a, F.lit(1.0))), F.lit(2.0)),
    "msle_increment": lambda p, a, o: F.pow(_log(F.greatest(p - o, F.lit(0.0)) + 1) - _log(F.greatest(a - o, F.lit(0.0)) + 1), F.lit(2.0)),
    "male_increment": lambda p, a, o: F.abs(_log(F.greatest(p - o, F.lit(0.0)) + 1) - _log(F.greatest(a - o, F.lit(0.0)) + 1)),
    "mape": lambda p, a, o: F.abs(F.log2(p + 1) - F.log2(a + 1)) / F.log2(a + 2),
    "mrse": lambda p, a, o: F.pow((p - a) / F.greatest(a, F.lit(1.0)), F.lit(2.0)),
    "wroperc": lambda p, a, o: (F.abs(p - a) / F.greatest(a, F.lit(1.0)) >= WRONG).cast("double"),
}


def forecast_terms(forecasts: DataFrame, metric: str = "msle") -> DataFrame:
    """``forecasts(predicted, actual, observed, ...)`` with ``error``, null where the forecast was declined (null or not a number)."""
    if metric not in TERMS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(TERMS)}")
    p, a, o = (F.col(c).cast("double") for c in ("predicted", "actual", "observed"))
    return forecasts.withColumn("error", F.when(p.isNotNull() & ~F.isnan(p), TERMS[metric](p, a, o)))


def forecast_rewards(forecasts: DataFrame, metrics: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """``by, metric, reward, se, n_scored, n_failed``: mean error over scored rows, infinite where every one was declined."""
    names = metrics or list(TERMS)
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"_{m}").alias("error")) for m in names))
    terms = forecasts
    for m in names:
        terms = forecast_terms(terms, m).withColumnRenamed("error", f"_{m}")
    long = terms.select(*(by or []), F.inline(each))
    n = F.count("error")
    return long.groupBy(*(by or []), "metric").agg(F.coalesce(F.avg("error"), F.lit(float("inf"))).alias("reward"), F.coalesce(F.try_divide(F.stddev_samp("error"), F.sqrt(n.cast("double"))), F.lit(0.0)).alias("se"), n.alias("n_scored"), (F.count("*") - n).alias("n_failed"))
