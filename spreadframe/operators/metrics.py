"""Metric relations. Undefined values are null unless a default is stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import numbered, over_earlier


def _n(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("int")), F.lit(0))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp + fn == 0, 1.0).otherwise(2.0 * tp / F.greatest(2 * tp + fp + fn, F.lit(1)))


def binary_f1(df: DataFrame, pred: str, target: str, by: list[str] | None = None) -> DataFrame:
    """F1 of two booleans; 1 where neither is ever true."""
    p, t = F.col(pred), F.col(target)
    return df.groupBy(*(by or [])).agg(_f1(_n(p & t), _n(p & ~t), _n(~p & t)).alias("f1"))


def prediction_scores(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """F1 of infection, of new infections and of changes, accuracy and Brier score from ``p, y, was``."""
    pred, y, was, p = F.col("p") >= 0.5, F.col("y"), F.col("was"), F.col("p")
    new = ~was
    change, moved = pred != was, y != was
    return df.groupBy(*(by or [])).agg(
        _f1(_n(pred & y), _n(pred & ~y), _n(~pred & y)).alias("infected_f1"), _f1(_n(new & pred & y), _n(new & pred & ~y), _n(new & ~pred & y)).alias("new_f1"),
        _f1(_n(change & moved), _n(change & ~moved), _n(~change & moved)).alias("delta_f1"), F.avg((pred == y).cast("double")).alias("accuracy"), F.avg(F.pow(p - y.cast("double"), F.lit(2.0))).alias("brier"),
    )


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """``bin, n, mean_p, mean_y`` for every bin, empty ones too; the top edge belongs to the last."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    got = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("mean_y"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "mean_y")


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    return reliability(df, bins).agg(F.coalesce(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n"), F.lit(0.0)).alias("ece"))


def average_rank(value: str, by: list[str] | None = None) -> Column:
    """Rank from 1 with ties at their mean."""
    order = Window.partitionBy(*(by or [])).orderBy(value)
    ties = Window.partitionBy(*(by or []), value)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / 2


def roc_auc(df: DataFrame, score: str = "score", target: str = "y", by: list[str] | None = None) -> DataFrame:
    """Mann-Whitney with average ranks; null if a class is missing. Scores are counted first, so ranks are over distinct ones."""
    keys = by or []
    per = df.groupBy(*keys, score).agg(F.count("*").alias("n"), _n(F.col(target)).alias("pos"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = per.withColumn("rank", below + (F.col("n") + 1) / 2)
    pos, n = F.sum("pos"), F.sum("n")
    return r.groupBy(*keys).agg(F.when((pos > 0) & (pos < n), (F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2) / F.nullif(pos * (n - pos), F.lit(0))).alias("auc"))


def matthews(df: DataFrame, pred: str, target: str, by: list[str] | None = None) -> DataFrame:
    """Matthews correlation; 0 where undefined."""
    p, t = F.col(pred), F.col(target)
    tp, fp, fn, tn = (x.cast("double") for x in (_n(p & t), _n(p & ~t), _n(~p & t), _n(~p & ~t)))
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return df.groupBy(*(by or [])).agg(F.coalesce(F.try_divide(tp * tn - fp * fn, F.nullif(below, F.lit(0.0))), F.lit(0.0)).alias("mcc"))


def set_scores(predicted: DataFrame, truth: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and Jaccard of two sets of rows."""
    keys = by or []
    on = [*keys, *key]
    j = predicted.select(*on).distinct().withColumn("p", F.lit(1)).join(truth.select(*on).distinct().withColumn("t", F.lit(1)), on, "full_outer")
    tp, p, t = F.count(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1)), F.count("p"), F.count("t")
    return j.groupBy(*keys).agg(F.try_divide(tp, p).alias("precision"), F.try_divide(tp, t).alias("recall"), F.coalesce(F.try_divide(2.0 * tp, p + t), F.lit(1.0)).alias("f1"), F.try_divide(tp, p + t - tp).alias("jaccard"))


def reconstruction_scores(predicted: DataFrame, truth: DataFrame, n_nodes: int, horizon: int) -> DataFrame:
    """One row from ``node, time, parent`` tables: node, event and source F1, MCC, time errors, path precision and recall."""
    a = predicted.select("node", F.col("time").alias("pt"), F.col("parent").alias("pp"))
    b = truth.select("node", F.col("time").alias("tt"), F.col("parent").alias("tp"))
    j = a.join(b, "node", "full_outer")
    has_p, has_t = F.col("pt").isNotNull(), F.col("tt").isNotNull()
    both = has_p & has_t
    event, path = both & (F.col("pt") == F.col("tt")), both & F.col("pp").eqNullSafe(F.col("tp")) & F.col("tp").isNotNull()
    sp, st = has_p & (F.col("pt") == 0), has_t & (F.col("tt") == 0)
    tp, np_, nt = _n(both), _n(has_p), _n(has_t)
    fp, fn = np_ - tp, nt - tp
    tn = F.lit(n_nodes) - tp - fp - fn
    below = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    late = F.lit(horizon + 1)
    gap = F.coalesce("pt", late) - F.coalesce("tt", late)
    return j.agg(
        _f1(tp, fp, fn).alias("node_f1"), _f1(_n(event), np_ - _n(event), nt - _n(event)).alias("event_f1"), _f1(_n(sp & st), _n(sp & ~st), _n(~sp & st)).alias("source_f1"),
        F.coalesce(F.try_divide((tp * tn - fp * fn).cast("double"), F.nullif(below, F.lit(0.0))), F.lit(0.0)).alias("mcc"), F.avg(F.when(both, F.abs(F.col("pt") - F.col("tt")))).alias("time_mae"),
        F.sqrt(F.coalesce(F.sum(gap * gap), F.lit(0)) / F.lit(2.0 * n_nodes * (horizon + 1) ** 2)).alias("nrmse"),
        F.try_divide(_n(path), _n(F.col("pp").isNotNull())).alias("path_precision"), F.try_divide(_n(path), _n(F.col("tp").isNotNull())).alias("path_recall"), F.try_divide(tp, np_ + nt - tp).alias("jaccard"),
    )


def order_agreement(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of node pairs with different true times that are put in the same order, from counts per pair of times."""
    j = predicted.select("node", F.col("time").alias("p")).join(truth.select("node", F.col("time").alias("t")), "node").groupBy("p", "t").agg(F.count("*").alias("n"))
    a, b = j.alias("a"), j.alias("b")
    pairs = a.join(b, F.col("a.t") < F.col("b.t")).select((F.col("a.n") * F.col("b.n")).alias("w"), (F.col("a.p") < F.col("b.p")).alias("same"))
    return pairs.agg(F.try_divide(F.sum(F.when(F.col("same"), F.col("w")).otherwise(0)), F.sum("w")).alias("order_accuracy"))


def popularity(df: DataFrame) -> DataFrame:
    """One row of forecast errors from ``predicted`` (null: declined), ``actual`` and ``observed``."""
    p, a, o = (F.col(c).cast("double") for c in ("predicted", "actual", "observed"))
    given = F.col("predicted").isNotNull()
    at1 = lambda x: F.greatest(x, F.lit(1.0))
    e2 = F.log2(at1(p)) - F.log2(at1(a))
    en = F.log(at1(p)) - F.log(at1(a))
    off = F.log2(1 + F.greatest(p, F.lit(0.0))) - F.log2(1 + a)
    ape = F.abs(p - a) / at1(a)
    rse = F.pow((p - a) / at1(a), F.lit(2.0))
    only = lambda x: F.when(given, x)
    inc = F.abs(F.log2(1 + F.greatest(p - o, F.lit(0.0))) - F.log2(1 + (a - o)))
    mean_a = F.avg(only(a))
    return df.agg(
        F.count("*").alias("n"), F.avg((~given).cast("double")).alias("decline_rate"), F.avg(only(e2 * e2)).alias("msle"), F.avg(only(F.abs(e2))).alias("male"), F.avg(only(en * en)).alias("msle_natural"), F.avg(only(off * off)).alias("msle_offset"),
        F.avg(only(ape)).alias("mape"), F.avg(only(rse)).alias("mrse"), F.expr("percentile(CASE WHEN predicted IS NOT NULL THEN pow((predicted - actual) / greatest(actual, 1.0D), 2.0D) END, 0.5)").alias("mrse_median"),
        F.avg(only((ape >= 0.5).cast("double"))).alias("wrong"), F.avg(only(inc * inc)).alias("msle_increment"), F.corr(only(p), only(a)).alias("pcc"),
        F.try_divide(F.sum(only(F.pow(p - a, F.lit(2.0)))), F.nullif(F.var_pop(only(a)) * F.count(only(a)), F.lit(0.0))).alias("one_minus_r2"), (mean_a).alias("mean_actual"),
        F.avg(only(((p >= 2 * o) == (a >= 2 * o)).cast("double"))).alias("doubling"),
    )


def coverage_at_k(df: DataFrame) -> DataFrame:
    """Overlap of the top tenths by prediction and by truth; null under ten rows."""
    k = df.count() // 10
    r = numbered(numbered(df, [F.desc("predicted"), F.asc("id")], "_a"), [F.desc("actual"), F.asc("id")], "_b")
    return r.agg(F.try_divide(_n((F.col("_a") < k) & (F.col("_b") < k)), F.nullif(F.lit(k), F.lit(0))).alias("coverage"))


def spearman(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Correlation of average ranks; 0 where undefined."""
    if by:
        r = df.select(*by, average_rank(a, by).alias("ra"), average_rank(b, by).alias("rb"))
    else:
        r = df.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
        for c, name in (("_a", "ra"), ("_b", "rb")):
            # ranks of the distinct values, counted first
            per = over_earlier(r.groupBy(c).agg(F.count("*").alias("_n")), [F.asc(c)], F.col("_n"), "_below")
            ranks = per.select(F.col(c).alias("_v"), (F.coalesce("_below", F.lit(0)) + (F.col("_n") + 1) / 2).alias(name))
            r = r.join(ranks, F.col(c).eqNullSafe(F.col("_v"))).drop("_v")
    return r.groupBy(*(by or [])).agg(F.when((F.var_pop("ra") > 0) & (F.var_pop("rb") > 0), F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb"))).otherwise(0.0).alias("rho"))


def epidemic_curve(curve: DataFrame, burn_in: float = 0.5) -> DataFrame:
    """Peak, first time of it, area and mean after the burn-in share of ``curve(t, value)``."""
    n = curve.agg((F.max("t") + 1).alias("n"))
    j = curve.join(F.broadcast(n))
    return j.agg(F.max("value").alias("peak"), F.min(F.struct((-F.col("value")).alias("v"), "t"))["t"].alias("time_to_peak"), F.sum("value").alias("area"), F.avg(F.when(F.col("t") >= F.floor(F.col("n") * burn_in), F.col("value"))).alias("endemic"))


def dismantling_scores(curve: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Robustness (sum of shares after the first removal over N, times N taken as q's), and the first q at the threshold."""
    return curve.agg(F.sum(F.when(F.col("q") > 0, F.col("share"))).alias("area"), F.avg("share").alias("mean_share"), F.min(F.when(F.col("share") <= threshold, F.col("q"))).alias("set_size"))


def mean_squared(df: DataFrame, a: str = "predicted", b: str = "observed") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(a) - F.col(b), F.lit(2.0))).alias("mse"))


def wasserstein(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean gap of sorted samples of equal number."""
    ra = numbered(df.select(F.col(a).alias("x")), [F.asc("x")], "r")
    rb = numbered(df.select(F.col(b).alias("y")), [F.asc("y")], "r")
    return ra.join(rb, "r").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("w1"))


def transition_logprob(df: DataFrame) -> DataFrame:
    """Sum of log p over new nodes and log(1 - p) over those that stayed, from ``p, new``; p kept off 0 and 1 by 1e-9."""
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("p")))
    return df.agg(F.sum(F.when(F.col("new"), F.log(p)).otherwise(F.log1p(-p))).alias("logprob"))
