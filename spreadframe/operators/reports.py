"""Report relations over candidates and search histories: orders, regrets under a budget, fronts, bands and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import pareto_front

ORDERS = ("model", "oracle", "degree", "random")


def ranking_orders(candidates: DataFrame, by: list[str]) -> DataFrame:
    """``order, place`` of each candidate (``cand_id, predicted, actual, degree``) in its group, in four orders.

    By prediction, by true value, by degree and by a hash of the id; ties to the smaller id.
    """
    keys = (F.desc("predicted"), F.desc("actual"), F.desc("degree"), F.md5(F.col("cand_id").cast("string")))
    placed = candidates.withColumns({f"_{name}": F.row_number().over(Window.partitionBy(*by).orderBy(key, "cand_id")).cast("long") for name, key in zip(ORDERS, keys)})
    orders = F.array(*(F.struct(F.lit(name).alias("order"), F.col(f"_{name}").alias("place")) for name in ORDERS))
    return placed.select(*by, "cand_id", "actual", F.inline(orders))


def order_report(orders: DataFrame, by: list[str], threshold: float, reference: str = "random") -> DataFrame:
    """For each group and order the calls to the first value at the threshold, the calls saved against the reference order, and the regret of the first candidate."""
    n = F.count("*")
    calls = orders.groupBy(*by, "order").agg(F.coalesce(F.min(F.when(F.col("actual") >= threshold, F.col("place"))), n + 1).alias("calls"), (F.max("actual") - F.max(F.when(F.col("place") == 1, F.col("actual")))).alias("regret"))
    base = calls.where(F.col("order") == reference).select(*by, F.col("calls").alias("base"))
    return calls.join(base, by).select(*by, "order", "calls", "regret", (1 - F.col("calls") / F.col("base")).alias("reduction"))


def budget_regret(candidates: DataFrame, by: list[str], k: int, sense: str = "max") -> DataFrame:
    """Summed true value of the ``k`` best predicted and of the ``k`` truly best, the regret over the latter, and the share of common picks.

    ``sense`` min is for values that a plan lowers (spread under blocking or doses).
    """
    key = F.desc if sense == "max" else F.asc
    place = lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(key(c), "cand_id"))
    ranked = candidates.select(*by, "cand_id", "actual", place("predicted").alias("p"), place("actual").alias("t"))
    sums = ranked.groupBy(*by).agg(F.sum(F.when(F.col("t") <= k, F.col("actual"))).alias("best"), F.sum(F.when(F.col("p") <= k, F.col("actual"))).alias("chosen"), (F.count_if((F.col("p") <= k) & (F.col("t") <= k)) / F.least(F.lit(k), F.count("*"))).alias("overlap"))
    return sums.withColumn("regret", F.coalesce(F.try_divide(F.abs(F.col("best") - F.col("chosen")), F.nullif(F.abs("best"), F.lit(0.0))), F.lit(0.0)))


def fidelity_cost_front(points: DataFrame, fidelity: str, cost: str) -> DataFrame:
    """The points that no other beats in fidelity without costing more; points that lack either value are out."""
    both = points.where(F.col(fidelity).isNotNull() & F.col(cost).isNotNull())
    return pareto_front(both, {fidelity: "max", cost: "min"}).where("dominated_by = 0").drop("dominated_by")


def paired_delta(results: DataFrame, incumbent: DataFrame, by: list[str], sense: str = "max") -> DataFrame:
    """Signed mean change of ``reward`` over the incumbent's on common units, and its standard error; positive is better."""
    sign = 1 if sense == "max" else -1
    j = results.join(incumbent.withColumnRenamed("reward", "was"), [*by, "unit"])
    d = F.lit(sign) * (F.col("reward") - F.col("was"))
    return j.groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("delta"), (F.coalesce(F.stddev_samp(d), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("se"))


def miscalibrated(history: DataFrame, by: list[str], window: int) -> DataFrame:
    """Whether most of a search's last ``window`` forecasts (``step, expected, delta``) had the wrong sign; false with fewer forecasts."""
    last = history.withColumn("_back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("step")))).where(F.col("_back") <= window)
    wrong = F.count_if(F.signum("expected") != F.signum("delta"))
    return last.groupBy(*by).agg(wrong.alias("wrong"), ((F.count("*") == window) & (2 * wrong > window)).alias("miscalibrated"))


def optimism_summary(history: DataFrame, by: list[str]) -> DataFrame:
    """How far a search's scores (``step, score``) fall when scored again in the next step: number, mean drop and share of drops."""
    drop = F.col("score") - F.lead("score").over(Window.partitionBy(*by).orderBy("step"))
    again = history.withColumn("_drop", drop).where("_drop is not null")
    return again.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_drop").alias("drop"), F.avg((F.col("_drop") > 0).cast("double")).alias("share"))


def blocking_metrics(plans: DataFrame, actions: str = "actions") -> DataFrame:
    """Influence that plans (``spread, unopposed``) prevent: in all, as a share, and for each action."""
    prevented = F.col("unopposed") - F.col("spread")
    return plans.select("*", prevented.alias("prevented"), F.coalesce(F.try_divide(prevented, F.nullif("unopposed", F.lit(0.0))), F.lit(0.0)).alias("share"), F.coalesce(F.try_divide(prevented, F.nullif(F.col(actions).cast("double"), F.lit(0.0))), F.lit(0.0)).alias("per_action"))


def random_edges(edges: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` arcs in the order of a hash of their ends and the seed, with rank from 1."""
    drawn = edges.select("src", "dst", F.md5(F.concat_ws("-", "src", "dst", F.lit(seed))).alias("draw")).orderBy("draw", "src", "dst").limit(k)
    # at most k rows
    return drawn.select("src", "dst", F.row_number().over(Window.orderBy("draw", "src", "dst")).cast("long").alias("rank"))
