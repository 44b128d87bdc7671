"""Rankings of candidates, Pareto fronts, and statistics over repeated runs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import over_earlier
from ..shared import written
from .metrics import average_rank


def _order(score: str, by: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "cand_id"))


def pair_order(df: DataFrame, by: list[str] | None = None, tie: float = 1e-9) -> DataFrame:
    """Pairs of candidates in a group with different true values: agreement of the predicted order, overall and by margin.

    Predicted ties count as wrong. Groups are one graph's candidates, some hundreds.
    """
    keys = by or ["graph_id"]
    a, b = df.alias("a"), df.alias("b")
    j = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.cand_id") < F.col("b.cand_id")])
    gap = F.col("a.actual") - F.col("b.actual")
    right = (F.signum(gap) == F.signum(F.col("a.predicted") - F.col("b.predicted"))).cast("double")
    m = F.abs(gap)
    bucket = F.when(m < 0.5, "[0,0.5)").when(m < 1, "[0.5,1)").when(m < 2, "[1,2)").otherwise("[2,inf)")
    return j.where(m > tie).groupBy(*(F.col(f"a.{k}").alias(k) for k in keys), bucket.alias("margin")).agg(F.count("*").alias("pairs"), F.avg(right).alias("accuracy"))


def kendall_tau(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tau-b of predicted and actual in each group."""
    keys = by or ["graph_id"]
    a, b = df.alias("a"), df.alias("b")
    j = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.cand_id") < F.col("b.cand_id")])
    x, y = F.signum(F.col("a.predicted") - F.col("b.predicted")), F.signum(F.col("a.actual") - F.col("b.actual"))
    return j.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys)).agg(F.coalesce(F.try_divide(F.sum(x * y), F.nullif(F.sqrt(F.sum(x * x) * F.sum(y * y)), F.lit(0.0))), F.lit(0.0)).alias("tau"))


def top_k_scores(df: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """``overlap`` (precision and recall at k) and the best true value among the predicted top k, with the regret to the best."""
    keys = by or ["graph_id"]
    r = df.withColumn("p", _order("predicted", keys)).withColumn("t", _order("actual", keys))
    return r.groupBy(*keys).agg((F.sum(((F.col("p") <= k) & (F.col("t") <= k)).cast("int")) / F.least(F.lit(k), F.count("*"))).alias("overlap"), F.max(F.when(F.col("p") <= k, F.col("actual"))).alias("best_found"), (F.max("actual") - F.max(F.when(F.col("p") <= k, F.col("actual")))).alias("regret"))


def calls_to_first_win(df: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Place of the first candidate in predicted order whose true value reaches the threshold, or their number plus one."""
    keys = by or ["graph_id"]
    r = df.withColumn("p", _order("predicted", keys))
    return r.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("actual") >= threshold, F.col("p"))), F.count("*") + 1).cast("long").alias("calls"))


def planning_regret(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """True value of the best candidate, of the chosen one (best predicted), and the gap."""
    keys = by or ["graph_id"]
    r = df.withColumn("p", _order("predicted", keys))
    got = r.groupBy(*keys).agg(F.max("actual").alias("best"), F.max(F.when(F.col("p") == 1, F.col("actual"))).alias("chosen"))
    return got.withColumn("regret", F.col("best") - F.col("chosen"))


def summary(df: DataFrame, values: list[str], by: list[str] | None = None, ddof: int = 1) -> DataFrame:
    """``metric, mean, std, n, least, most`` over finite values; std is 0 for one value."""
    long = df.select(*(by or []), F.explode(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*(F.col(v).cast("double") for v in values)))).alias("metric", "value"))
    ok = long.where("value is not null and not isnan(value) and abs(value) < double('inf')")
    std = F.coalesce(F.stddev_samp("value"), F.lit(0.0)) if ddof else F.stddev_pop("value")
    return ok.groupBy(*(by or []), "metric").agg(F.avg("value").alias("mean"), std.alias("std"), F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


def separated(df: DataFrame, first: str, second: str) -> DataFrame:
    """Gap of two arms' means in pooled standard errors (``arm, metric, mean, std, n``); separated beyond 2."""
    a, b = df.where(F.col("arm") == first).alias("a"), df.where(F.col("arm") == second).alias("b")
    se = F.sqrt(F.pow(F.col("a.std"), F.lit(2.0)) / F.col("a.n") + F.pow(F.col("b.std"), F.lit(2.0)) / F.col("b.n"))
    gap = F.col("a.mean") - F.col("b.mean")
    return a.join(b, F.col("a.metric") == F.col("b.metric")).select(F.col("a.metric").alias("metric"), gap.alias("gap"), se.alias("se"), F.coalesce(F.abs(gap) > 2 * se, F.lit(False)).alias("separated"))


#: Distinct points, about, whose dominators are counted together, and ranges of a value at most.
GROUP, RANGES = 1 << 17, 512


def _dominance(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each of some distinct points the sum of ``n`` over those at least as good in both values, itself among them; nan is above all."""
    x, y = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    order = np.lexsort((-y, -x))
    k, m = int(y.max(initial=0)) + 1, len(order)
    down, w, at = k - 1 - y[order], n[order].astype(np.int64), np.arange(m)
    out = w.copy()
    # all that beat a point come before it: halves of ever larger runs are counted against each other
    for bit in range(max(0, m - 1).bit_length()):
        left, key = (at >> bit) % 2 == 0, (at >> (bit + 1)) * k + down
        held = np.sort(key[left], kind="stable")
        until = np.concatenate([[0], np.cumsum(w[left][np.argsort(key[left], kind="stable")])])
        right = ~left
        out[right] += until[np.searchsorted(held, key[right], "right")] - until[np.searchsorted(held, (at[right] >> (bit + 1)) * k, "left")]
    back = np.empty(m, np.int64)
    back[order] = out
    return back


def _dominators(points: DataFrame, group: int | None = None) -> DataFrame:
    """``_0, _1, dominated_by`` of distinct points ``_0, _1, _n`` without nulls.

    Points lie in ranges of either value. Those that beat one are in its own range of the first, or in a higher one: then in its
    own range of the second, or in cells higher in both, which are counted whole.
    """
    held = written(points, "points")
    parts = min(RANGES, held.count() // (group or GROUP) + 1)
    cuts = [sorted(set(held.approxQuantile(c, [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else [] for c in ("_0", "_1")]
    place = lambda c, at: F.pandas_udf(lambda v: pd.Series(np.searchsorted(at, v.to_numpy(float), "right"), dtype="int32"), "int")(c)
    placed = written(held.select(F.monotonically_increasing_id().alias("at"), "_0", "_1", "_n", place("_0", cuts[0]).alias("i"), place("_1", cuts[1]).alias("j")), "placed")
    cells = np.zeros((len(cuts[0]) + 2, len(cuts[1]) + 2), np.int64)
    for r in placed.groupBy("i", "j").agg(F.sum("_n").alias("n")).collect():
        cells[r["i"], r["j"]] = r["n"]
    above = cells[::-1, ::-1].cumsum(0).cumsum(1)[::-1, ::-1]

    def within(g: pd.DataFrame) -> pd.DataFrame:
        n = _dominance(g["_0"].to_numpy(), g["_1"].to_numpy(), g["_n"].to_numpy()) - g["_n"].to_numpy()
        return g[["at"]].assign(c=n)

    def higher(g: pd.DataFrame) -> pd.DataFrame:
        # points of one range and value are one point here, at the range's place and just above it
        i, y = g["i"].to_numpy(), g["_1"].to_numpy()
        rank = np.unique(y, return_inverse=True)[1]
        spots, at = np.unique(np.column_stack([2 * i, rank]), axis=0, return_inverse=True)
        own = np.bincount(at.ravel(), g["_n"].to_numpy(float)).astype(np.int64)
        both = np.concatenate([spots, spots + [1, 0]])
        n = _dominance(both[:, 0], both[:, 1], np.concatenate([own, np.zeros_like(own)]))[len(spots) :][at.ravel()]
        return g[["at"]].assign(c=n + above[i + 1, g["j"].to_numpy() + 1])

    # a point goes by its number, as pandas would hand a nan back as null
    counted = placed.groupBy("i").applyInPandas(within, "at long, c long").unionByName(placed.groupBy("j").applyInPandas(higher, "at long, c long"))
    return placed.join(counted.groupBy("at").agg(F.sum("c").alias("dominated_by")), "at").where("dominated_by > 0").select("_0", "_1", "dominated_by")


def pareto_front(points: DataFrame, objectives: dict[str, str], name: str = "name", group: int | None = None) -> DataFrame:
    """``points`` with dominated_by, the number of points at least as good everywhere and better somewhere.

    ``objectives`` maps columns to max or min; a missing value neither dominates nor is
    compared. Distinct objective vectors are compared, so repeated points cost nothing; two objectives are counted
    by their order, more by all pairs.
    """
    signed = [(F.col(c) if s == "max" else -F.col(c)).alias(f"_{i}") for i, (c, s) in enumerate(objectives.items())]
    v = points.select(*signed).distinct()
    ids = [f"_{i}" for i in range(len(objectives))]
    counted = points.select(*signed).groupBy(*ids).agg(F.count("*").alias("_n"))
    a, b = v.alias("a"), counted.alias("b")
    ge, gt = F.lit(True), F.lit(False)
    for i in ids:
        ge, gt = ge & (F.col(f"b.{i}") >= F.col(f"a.{i}")), gt | (F.col(f"b.{i}") > F.col(f"a.{i}"))
    if len(ids) == 2 and all(t in ("double", "float", "bigint", "int", "smallint", "tinyint") for _, t in counted.select(*ids).dtypes):
        beaten = _dominators(counted.where("_0 is not null and _1 is not null"), group)
    else:
        beaten = a.join(b, ge & gt).groupBy(*(F.col(f"a.{i}").alias(i) for i in ids)).agg(F.sum("_n").alias("dominated_by"))
    p = points.select("*", *signed).alias("p")
    cond = [F.col(f"p.{i}").eqNullSafe(F.col(f"d.{i}")) for i in ids]
    return p.join(beaten.alias("d"), cond, "left").select(*(F.col(f"p.{c}") for c in points.columns), F.coalesce("dominated_by", F.lit(0)).alias("dominated_by"))


def hypervolume(points: DataFrame, first: str, second: str, reference: tuple[float, float]) -> DataFrame:
    """Area that two maximised objectives dominate above the reference point."""
    p = points.where((F.col(first) > reference[0]) & (F.col(second) > reference[1])).groupBy(F.col(first).alias("x")).agg(F.max(second).alias("y"))
    p = over_earlier(p, [F.desc("x")], F.col("y"), "above", F.max)
    best = F.coalesce("above", F.lit(reference[1]))
    return p.select("x", (F.greatest(F.lit(0.0), F.col("y") - best) * (F.col("x") - reference[0])).alias("part")).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("hypervolume"))


# --- search histories


def paired_band(df: DataFrame) -> DataFrame:
    """Mean and standard error of per-sample differences of ``candidate`` and ``incumbent``."""
    d = F.col("candidate") - F.col("incumbent")
    return df.agg(F.avg(d).alias("delta"), (F.coalesce(F.stddev_samp(d), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("se"), F.avg((d < 0).cast("double")).alias("realization_gap"))


def acceptance_ledger(history: DataFrame) -> DataFrame:
    """Accepted steps by sign alone and by a band of one standard error, from ``delta, se``."""
    return history.agg(F.count("*").alias("steps"), F.sum((F.col("delta") > 0).cast("int")).alias("naive"), F.sum((F.col("delta") > F.col("se")).cast("int")).alias("banded"))


def calibration(history: DataFrame) -> DataFrame:
    """How forecast changes match measured ones, from ``expected, delta, p``."""
    e, d = F.col("expected"), F.col("delta")
    r = history.select("*", average_rank("expected").alias("re"), average_rank("delta").alias("rd"))
    return r.agg(F.corr(e, d).alias("pearson"), F.corr("re", "rd").alias("spearman"), F.avg((F.signum(e) == F.signum(d)).cast("double")).alias("sign_accuracy"), F.avg(F.abs(e - d)).alias("mae"), F.avg(e - d).alias("bias"), F.avg(F.pow(F.col("p") - (d > 0).cast("double"), F.lit(2.0))).alias("brier"))


def flat_generations(history: DataFrame) -> DataFrame:
    """Trailing steps of ``step, best`` since the best value last rose."""
    so_far = over_earlier(history, [F.asc("step")], F.col("best"), "_top", F.max)
    up = so_far.select("step", (F.col("best") > F.coalesce("_top", F.lit(float("-inf")))).alias("up"))
    return up.agg((F.max("step") - F.max(F.when(F.col("up"), F.col("step")))).alias("flat"))


def stagnation(history: DataFrame, window: int, epsilon: float = 1e-9) -> DataFrame:
    """``step, status``: WARMING_UP, STAGNANT where the last window's best is not above the value before it, else IMPROVING."""
    w = Window.orderBy("step")
    top = F.max("best").over(w.rowsBetween(-window, 0))
    was = F.lag("best", window).over(w)
    return history.select("step", F.when(was.isNull(), "WARMING_UP").when(top - was < epsilon, "STAGNANT").otherwise("IMPROVING").alias("status"))


def redundancy(solo: DataFrame) -> DataFrame:
    """``a, b, overlap``: sum of the smaller marginal over nodes, over the smaller mass, from ``seed, node, p``."""
    mass = solo.groupBy("seed").agg(F.sum("p").alias("m"))
    x, y = solo.alias("x"), solo.alias("y")
    both = x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.seed") < F.col("y.seed"))).groupBy(F.col("x.seed").alias("a"), F.col("y.seed").alias("b")).agg(F.sum(F.least("x.p", "y.p")).alias("s"))
    m = lambda c: mass.select(F.col("seed").alias(c), F.col("m").alias(f"m{c}"))
    return both.join(m("a"), "a").join(m("b"), "b").select("a", "b", F.try_divide(F.col("s"), F.least("ma", "mb")).alias("overlap"))


def basins(solo: DataFrame, nodes: DataFrame, floor: float = 0.05) -> DataFrame:
    """``node, region``: the seed with the highest marginal above the floor, or -1."""
    best = solo.where(F.col("p") > floor).groupBy("node").agg(F.max(F.struct("p", (-F.col("seed")).alias("s"))).alias("b"))
    return nodes.join(best, "node", "left").select("node", F.coalesce(-F.col("b.s"), F.lit(-1)).alias("region"))


def region_coverage(marginals: DataFrame, regions: DataFrame) -> DataFrame:
    return regions.join(marginals, "node", "left").groupBy("region").agg(F.count("*").alias("nodes"), F.sum(F.coalesce("p", F.lit(0.0))).alias("mass"), F.avg(F.coalesce("p", F.lit(0.0))).alias("mean"))


def leaderboard(results: DataFrame, by: list[str]) -> DataFrame:
    """``results`` (arm, reward) with rank and the gap to the best in each group."""
    w = Window.partitionBy(*by)
    return results.select("*", F.rank().over(w.orderBy(F.desc("reward"))).alias("rank"), (F.max("reward").over(w) - F.col("reward")).alias("gap"))


def adaptivity_gap(results: DataFrame) -> DataFrame:
    """``budget, arm, gap``: each adaptive arm's reward over the best static one's at the same budget."""
    static = results.where(~F.col("adaptive")).groupBy("budget").agg(F.max("reward").alias("s"))
    return results.where("adaptive").join(static, "budget").select("budget", "arm", F.try_divide("reward", "s").alias("gap"))
