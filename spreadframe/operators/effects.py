"""What an action changes: predicted against true effects of swapping actions in a state, and corrupted actions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written

#: Effects up to this size are taken for noise.
NOISE = 1e-3
#: Buckets of a group's random order.
BUCKETS = 64


def _dominated(points: DataFrame, noise: float) -> DataFrame:
    """``real, agree``: pairs of a group whose true values are more than ``noise`` apart, and those predicted in that order.

    ``points`` has ``g`` (the group), ``predicted``, ``true``. Each row is a point and a question: how
    many points lie more than ``noise`` below it, and how many of those are predicted below it. Points
    and questions are numbered by true value; for every binary digit, points with digit 0 are counted
    for the questions with digit 1 and the same digits before, in order of prediction. So the work
    is rows times the logarithm of a group, and no pairs are made.
    """
    both = points.select("g", "predicted", F.explode(F.array(F.struct(F.lit(1).alias("point"), F.col("true").alias("at")), F.struct(F.lit(0).alias("point"), (F.col("true") - noise).alias("at")))).alias("s")).select("g", "predicted", "s.*")
    by_true = Window.partitionBy("g").orderBy("at", "point")
    placed = written(both.withColumn("r", F.row_number().over(by_true) - 1).withColumn("below", F.sum("point").over(by_true.rowsBetween(Window.unboundedPreceding, -1))), "placed")
    digits = int(placed.agg(F.max("r")).first()[0] or 0).bit_length()
    real = placed.where("point = 0").agg(F.coalesce(F.sum("below"), F.lit(0)).alias("real"))
    level = placed.withColumn("digit", F.explode(F.sequence(F.lit(0), F.lit(max(0, digits - 1)))))
    prefix, one = F.call_function("shiftright", "r", F.col("digit") + 1), F.call_function("shiftright", "r", F.col("digit")).bitwiseAND(F.lit(1))
    level = level.withColumn("prefix", prefix).withColumn("one", one).where("one <> point")
    order = Window.partitionBy("g", "digit", "prefix").orderBy("predicted", "point").rowsBetween(Window.unboundedPreceding, -1)
    agree = level.withColumn("n", F.sum("point").over(order)).where("point = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("agree"))
    return real.crossJoin(F.broadcast(agree))


def counterfactual_effect(rows: DataFrame, noise: float = NOISE) -> DataFrame:
    """One row of scores over all pairs of actions in a state: predicted against true difference at every node.

    ``rows`` has state, action, node, predicted, true; a state is everything an action branches from. Returns
    pairs (of actions), scored (pairs at nodes), pearson, mae, mae_norm (mae over the mean true difference:
    1 for predictions that ignore the action), magnitude_ratio and sign_agree (true differences above ``noise``
    whose direction is right). Sums over pairs come from sums over rows: products from moments, absolute
    differences from rows in order. Null where there is nothing to divide by; rows with nulls are left out.
    """
    clean = written(rows.select("state", "action", "node", "predicted", "true").dropna(), "effects")
    per = Window.partitionBy("state", "node")
    error = F.col("predicted") - F.col("true")
    n = F.count("*").over(per)
    ordered = lambda c: c * (2 * (F.row_number().over(per.orderBy(c)) - 1) - n + 1)
    turn = n - 1 - 2 * (F.row_number().over(per.orderBy("action")) - 1)
    parts = clean.select(
        "state", "node", "action", "predicted", "true", (F.col("predicted") * turn).alias("dp"), (F.col("true") * turn).alias("dt"),
        ordered(F.col("predicted")).alias("ap"), ordered(F.col("true")).alias("at"), ordered(error).alias("ae"),
    )
    x, y = F.col("predicted"), F.col("true")
    cross = lambda a, b: F.count("*") * F.sum(a * b) - F.sum(a) * F.sum(b)
    group = parts.groupBy("state", "node").agg(F.count("*").alias("n"), cross(x, x).alias("xx"), cross(y, y).alias("yy"), cross(x, y).alias("xy"), *(F.sum(c).alias(c) for c in ("dp", "dt", "ap", "at", "ae")))
    total = group.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("scored"), *(F.sum(c).alias(c) for c in ("xx", "yy", "xy", "dp", "dt", "ap", "at", "ae")))
    pairs = clean.groupBy("state").agg(F.count_distinct("action").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("pairs"))
    signs = _dominated(clean.select(F.struct("state", "node").alias("g"), "predicted", "true"), noise)
    s = F.nullif(F.col("scored"), F.lit(0))
    centred = lambda c, a, b: F.col(c) - F.col(a) * F.col(b) / s
    mean_true = F.nullif(F.col("at"), F.lit(0.0))
    return total.crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(signs)).select(
        "pairs", F.coalesce("scored", F.lit(0)).alias("scored"), F.try_divide(centred("xy", "dp", "dt"), F.sqrt(centred("xx", "dp", "dp") * centred("yy", "dt", "dt"))).alias("pearson"),
        (F.col("ae") / s).alias("mae"), F.try_divide(F.col("ae"), mean_true).alias("mae_norm"), F.try_divide(F.col("ap"), mean_true).alias("magnitude_ratio"), F.try_divide(F.col("agree"), F.col("real")).alias("sign_agree"),
    )


def deranged(records: DataFrame, draw: Column, keys: list[str], column: str = "action", by: list[str] | None = None) -> DataFrame:
    """``records`` with ``swapped``: the value of ``column`` of another record of the group, each given away once.

    Records stand in a ring in the order of ``draw`` in [0, 1) and ``keys`` (which tell them apart) and take from the
    next one, so that nobody keeps its own; alone in its group a record has null. A group is cut into buckets
    of the draw, whose last record takes from the first of the next bucket, so a large group is not one task.
    """
    by = by or []
    r = written(records.withColumn("_d", draw).withColumn("_b", F.floor(F.col("_d") * BUCKETS).cast("int")), "records")
    order = Window.partitionBy(*by, "_b").orderBy("_d", *keys)
    own = F.struct(F.col(column).alias("v"))
    firsts = r.groupBy(*by, "_b").agg(F.min_by(own, F.struct("_d", *keys)).alias("first"))
    ring = Window.partitionBy(*by).orderBy("_b")
    after = firsts.select(*by, "_b", F.coalesce(F.lead("first").over(ring), F.first("first").over(ring)).alias("_next"), F.count("*").over(Window.partitionBy(*by)).alias("_n"))
    inside = r.withColumn("_then", F.lead(own).over(order)).withColumn("_m", F.count("*").over(Window.partitionBy(*by, "_b")))
    alone = (F.col("_n") == 1) & (F.col("_m") == 1)
    taken = F.when(alone, None).otherwise(F.coalesce("_then", "_next"))
    return inside.join(after, [*by, "_b"]).withColumn("swapped", taken["v"]).select(*records.columns, "swapped")


def action_ablation(records: DataFrame, predict: Callable[[DataFrame], DataFrame], draw: Column, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """``arm, n, brier, brier_rise, rise_se, f1, f1_drop`` when actions are dropped (null) or dealt anew (shuffle).

    ``records`` has ``keys``, ``action`` and ``y`` (0 or 1); ``predict`` adds ``p`` to such rows, with a null action
    where there is none. Rises and drops are against the same records with their own actions, record by
    record: rise_se is the standard error of the paired difference. Records without an action, and those
    alone in their group, are left out of both arms. A model that does not read the action has 0 everywhere.
    """
    acting = written(deranged(records.where("action is not null"), draw, keys, "action", by).where("swapped is not null"), "acting")
    arms = {"own": F.col("action"), "null": F.lit(None).cast(records.schema["action"].dataType), "shuffle": F.col("swapped")}
    scored = {arm: predict(acting.withColumn("action", a).drop("swapped")).select(*keys, "y", F.col("p").alias(arm)) for arm, a in arms.items()}
    rows = scored["own"].join(scored["null"].drop("y"), keys).join(scored["shuffle"].drop("y"), keys)
    long = rows.select("y", "own", F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.col(a).alias("p")) for a in ("null", "shuffle")))).alias("s")).select("y", "own", "s.*")
    loss = lambda c: F.pow(F.col(c) - F.col("y"), F.lit(2.0))
    f1 = lambda c: F.coalesce(F.try_divide(2 * F.sum(((F.col(c) >= 0.5) & (F.col("y") == 1)).cast("double")), F.sum((F.col(c) >= 0.5).cast("double") + F.col("y"))), F.lit(0.0))
    rise = loss("p") - loss("own")
    return long.groupBy("arm").agg(F.count("*").alias("n"), F.avg(loss("p")).alias("brier"), F.avg(rise).alias("brier_rise"), (F.stddev_samp(rise) / F.sqrt(F.count("*"))).alias("rise_se"), f1("p").alias("f1"), (f1("own") - f1("p")).alias("f1_drop"))
