"""Observed cascades: cleaning, binning, splits, features and size forecasts.

A cascade is a header (``cascade_id, root, publish_time``) and adoptions
(``cascade_id, adopter, elapsed, parent``); a forecast is a size, or null where declined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import Graph, numbered
from ..functions.coins import coin
from ..shared import drop_table, written
from . import dynamics, structure


def from_events(events: DataFrame) -> DataFrame:
    """Star cascades from ``cascade_id, user, elapsed``: first adoption of a user wins, rooted at the first adopter."""
    first = events.groupBy("cascade_id", F.col("user").alias("adopter")).agg(F.min("elapsed").alias("elapsed"))
    w = Window.partitionBy("cascade_id").orderBy("elapsed", "adopter")
    s = first.withColumn("seq", F.row_number().over(w) - 1).withColumn("root", F.first("adopter").over(w))
    return s.select("cascade_id", "seq", "adopter", "elapsed", F.when(F.col("seq") > 0, F.col("root")).alias("parent"))


def popularity_at(adoptions: DataFrame, elapsed: int | Column) -> DataFrame:
    """``cascade_id, n``: adopters up to a time."""
    return adoptions.groupBy("cascade_id").agg(F.sum((F.col("elapsed") <= elapsed).cast("long")).alias("n"))


def prefix(adoptions: DataFrame, elapsed: int) -> DataFrame:
    return adoptions.where(F.col("elapsed") <= elapsed)


def filter_observed(adoptions: DataFrame, window: int, least: int = 10, truncate: int = 100) -> DataFrame:
    """Cascades with at least ``least`` adopters within the window; only that prefix is cut to ``truncate``."""
    seen = F.sum((F.col("elapsed") <= window).cast("int")).over(Window.partitionBy("cascade_id"))
    place = F.row_number().over(Window.partitionBy("cascade_id").orderBy("elapsed", "adopter"))
    kept = adoptions.withColumn("_seen", seen).withColumn("_place", place).where(F.col("_seen") >= least)
    return kept.where((F.col("_place") <= truncate) | (F.col("elapsed") > window)).drop("_seen", "_place")


def relabel(adoptions: DataFrame, max_nodes: int) -> DataFrame:
    """Keep the busiest ``max_nodes`` adopters, renumber them, null lost parents, drop cascades without root or under 2 events."""
    busy = adoptions.groupBy("adopter").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "adopter").limit(max_nodes)
    ids = busy.select("adopter", (F.row_number().over(Window.orderBy("adopter")) - 1).cast("long").alias("node"))
    kept = adoptions.join(ids, "adopter").join(ids.select(F.col("adopter").alias("parent"), F.col("node").alias("p")), "parent", "left")
    per = Window.partitionBy("cascade_id")
    ok = (F.count("*").over(per) >= 2) & (F.min("seq").over(per) == 0)
    return kept.withColumn("_ok", ok).where("_ok").select("cascade_id", "seq", F.col("node").alias("adopter"), "elapsed", F.col("p").alias("parent"))


def adoption_arcs(adoptions: DataFrame) -> DataFrame:
    """Distinct arcs between parents and adopters, both ways."""
    a = adoptions.where("parent is not null and parent <> adopter").select(F.col("parent").alias("src"), F.col("adopter").alias("dst"))
    return a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def corpus_statistics(adoptions: DataFrame) -> DataFrame:
    sizes = adoptions.groupBy("cascade_id").agg(F.count("*").alias("size"))
    users = adoptions.agg(F.count_distinct("adopter").alias("adopters"))
    return sizes.agg(F.count("*").alias("cascades"), F.sum("size").alias("adoptions"), F.min("size").alias("least"), F.avg("size").alias("mean"), F.expr("percentile(size, 0.5)").alias("median"), F.max("size").alias("most")).join(users)


def bin_events(adoptions: DataFrame, step: int, horizon: int) -> DataFrame:
    """``cascade_id, node, t``: elapsed // step, the root at 0, nothing from the horizon on, a node's first bin."""
    t = F.when(F.col("parent").isNull() & (F.col("seq") == 0), 0).otherwise(F.floor(F.col("elapsed") / step))
    return adoptions.select("cascade_id", F.col("adopter").alias("node"), t.cast("long").alias("t")).where(F.col("t") < horizon).groupBy("cascade_id", "node").agg(F.min("t").alias("t"))


def replay(binned: DataFrame) -> DataFrame:
    """``cascade_id, t, infected, frontier``: running and new counts at every step up to the last one with events."""
    last = binned.groupBy("cascade_id").agg(F.max("t").alias("last"))
    steps = last.select("cascade_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("t"))
    new = binned.groupBy("cascade_id", "t").agg(F.count("*").alias("n"))
    j = steps.join(new, ["cascade_id", "t"], "left").withColumn("frontier", F.coalesce("n", F.lit(0)))
    run = Window.partitionBy("cascade_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return j.select("cascade_id", "t", F.sum("frontier").over(run).alias("infected"), "frontier")


def assign_splits(headers: DataFrame, window: int, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """``cascade_id, publish_time, split``: chronological; training rows whose window reaches the first test row go."""
    n = headers.count()
    place = F.col("_place")
    a, b = int(n * train), int(n * train) + int(n * valid)
    split = numbered(headers, [F.asc("publish_time"), F.asc("cascade_id")], "_place").select("cascade_id", "publish_time", F.when(place < a, "train").when(place < b, "valid").otherwise("test").alias("split"))
    first = split.where("split = 'test'").agg(F.min("publish_time").alias("first"))
    return split.join(F.broadcast(first)).where((F.col("split") != "train") | F.col("first").isNull() | (F.col("publish_time") + window <= F.col("first"))).drop("first")


def random_splits(headers: DataFrame, key: str, train: float = 0.7, valid: float = 0.15, seed: int = 0) -> DataFrame:
    """Exact shares after a seeded shuffle of integer keys."""
    n = headers.count()
    place = F.col("_place")
    a, b = int(n * train), int(n * train) + int(n * valid)
    shuffled = numbered(headers, [coin(F.col(key), 9, seed, "split").asc(), F.asc(key)], "_place")
    return shuffled.withColumn("split", F.when(place < a, "train").when(place < b, "valid").otherwise("test")).drop("_place")


# --- features and forecasts


def observed_waves(binned: DataFrame, window: int) -> DataFrame:
    """``cascade_id, t, n``: new adopters in each step before ``window``, zeros included."""
    ids = binned.select("cascade_id").distinct().select("cascade_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(window - 1).cast("long"))).alias("t"))
    n = binned.where(F.col("t") < window).groupBy("cascade_id", "t").agg(F.count("*").alias("n"))
    return ids.join(n, ["cascade_id", "t"], "left").select("cascade_id", "t", F.coalesce("n", F.lit(0)).alias("n"))


FEATURES = ["observed", "first_half", "second_half", "acceleration", "half_time", "waves", "peak", "peak_time", "last_wave", "mean_degree", "max_degree", "sum_degree", "root_degree", "exposed", "frontier_exposed", "roots"]


def features(graph: Graph, binned: DataFrame, window: int) -> DataFrame:
    """``cascade_id`` and the ordered FEATURES of the first ``window`` steps."""
    seen = written(binned.where(F.col("t") < window), "seen")
    waves = observed_waves(binned, window)
    half = window // 2
    run = Window.partitionBy("cascade_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("cascade_id")
    w = waves.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(total))
    shape = w.groupBy("cascade_id").agg(
        F.sum("n").alias("observed"), F.sum(F.when(F.col("t") < half, F.col("n")).otherwise(0)).alias("first_half"), F.sum(F.when(F.col("t") >= half, F.col("n")).otherwise(0)).alias("second_half"),
        F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("t"))).alias("half_time"), F.sum((F.col("n") > 0).cast("long")).alias("waves"), F.max("n").alias("peak"),
        F.min(F.struct((-F.col("n")).alias("m"), "t"))["t"].alias("peak_time"), F.max(F.when(F.col("t") == window - 1, F.col("n"))).alias("last_wave"),
    ).withColumn("acceleration", F.col("second_half") - F.col("first_half"))
    d = seen.join(structure.degree(graph), "node").groupBy("cascade_id").agg(F.avg("score").alias("mean_degree"), F.max("score").alias("max_degree"), F.sum("score").alias("sum_degree"), F.sum(F.when(F.col("t") == 0, F.col("score")).otherwise(0.0)).alias("root_degree"), F.sum((F.col("t") == 0).cast("long")).alias("roots"))
    arcs = seen.join(graph.edges, F.col("node") == F.col("src")).select("cascade_id", F.col("dst").alias("node"), F.when(F.col("t") == window - 1, 1).otherwise(0).alias("late"))
    out = arcs.groupBy("cascade_id", "node").agg(F.max("late").alias("late")).join(seen, ["cascade_id", "node"], "left_anti").groupBy("cascade_id").agg(F.count("*").alias("exposed"), F.sum("late").alias("frontier_exposed"))
    j = shape.join(d, "cascade_id", "left").join(out, "cascade_id", "left")
    return j.select("cascade_id", *(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in FEATURES))


def persistence(observed: DataFrame) -> DataFrame:
    return observed.select("cascade_id", F.col("observed").cast("double").alias("predicted"))


def mean_size(observed: DataFrame, examples: DataFrame) -> DataFrame:
    """exp of the mean log final size of ``examples(observed, final)``, at least what is observed."""
    m = examples.agg(F.exp(F.avg(F.log("final"))).alias("m"))
    return observed.join(F.broadcast(m)).select("cascade_id", F.greatest(F.col("observed"), F.coalesce("m", F.lit(0.0))).alias("predicted"))


def log_log_regression(observed: DataFrame, examples: DataFrame) -> DataFrame:
    """Least squares of log final on log observed; at least what is observed."""
    fit = examples.agg(F.regr_slope(F.log("final"), F.log("observed")).alias("a"), F.regr_intercept(F.log("final"), F.log("observed")).alias("b"))
    return observed.join(F.broadcast(fit)).select("cascade_id", F.greatest(F.col("observed").cast("double"), F.coalesce(F.exp(F.col("a") * F.log("observed") + F.col("b")), F.lit(0.0))).alias("predicted"))


def ridge_weights(examples: DataFrame, names: list[str], target: str, penalty: float = 1.0) -> list[float]:
    """Weights (intercept first, not penalised) by normal equations; one small row of sums reaches the driver."""
    import numpy as np

    x = [F.lit(1.0), *(F.col(n).cast("double") for n in names)]
    y = F.col(target)
    k = len(x)
    sums = examples.agg(*(F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)), *(F.sum(x[i] * y).alias(f"b{i}") for i in range(k))).first()
    a, b = np.zeros((k, k)), np.zeros(k)
    for i in range(k):
        b[i] = sums[f"b{i}"] or 0.0
        for j in range(i, k):
            a[i, j] = a[j, i] = sums[f"a{i}_{j}"] or 0.0
    return np.linalg.lstsq(a + penalty * np.diag([0.0] + [1.0] * (k - 1)), b, rcond=None)[0].tolist()


def feature_regression(feats: DataFrame, examples: DataFrame, penalty: float = 1.0) -> DataFrame:
    """Ridge of log final on the features (``examples`` has them and final); exponent at most 30, size at least observed."""
    w = ridge_weights(examples.withColumn("_y", F.log("final")), FEATURES, "_y", penalty)
    z = F.lit(w[0])
    for n, v in zip(FEATURES, w[1:]):
        z = z + F.lit(v) * F.col(n)
    return feats.select("cascade_id", F.greatest("observed", F.exp(F.least(F.lit(30.0), z))).alias("predicted"))


def feature_trees(feats: DataFrame, examples: DataFrame, trees: int = 120, depth: int = 3) -> DataFrame:
    """Gradient-boosted trees on the same features and target."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    va = VectorAssembler(inputCols=FEATURES, outputCol="_x")
    model = GBTRegressor(featuresCol="_x", labelCol="_y", maxIter=trees, maxDepth=depth, seed=1).fit(va.transform(examples.withColumn("_y", F.log("final"))))
    return model.transform(va.transform(feats)).select("cascade_id", F.greatest("observed", F.exp("prediction")).alias("predicted"))


def wave_ratios(waves: DataFrame) -> DataFrame:
    w = Window.partitionBy("cascade_id").orderBy("t")
    r = waves.where("n > 0").withColumn("was", F.lag("n").over(w)).where("was is not null")
    return r.select("cascade_id", "t", (F.col("n") / F.col("was")).alias("ratio"))


def branching_factor(waves: DataFrame) -> DataFrame:
    """observed + last R / (1 - R), R the mean of the last three wave ratios; declined from 1 on."""
    late = wave_ratios(waves).withColumn("r", F.row_number().over(Window.partitionBy("cascade_id").orderBy(F.desc("t")))).where("r <= 3").groupBy("cascade_id").agg(F.avg("ratio").alias("ratio"))
    return _tail(waves, late, "ratio", 1.0)


def _tail(waves: DataFrame, rates: DataFrame, rate: str, cut: float) -> DataFrame:
    base = waves.groupBy("cascade_id").agg(F.sum("n").alias("observed"), F.max_by("n", "t").alias("last"))
    b = F.coalesce(F.col(rate), F.lit(0.0))
    return base.join(rates, "cascade_id", "left").select("cascade_id", F.when(b < cut, F.col("observed") + F.col("last") * b / (1 - b)).alias("predicted"))


def hawkes(waves: DataFrame) -> DataFrame:
    """observed + last / (1 - b) for the mean wave ratio b; declined from 1 on."""
    mean = wave_ratios(waves).groupBy("cascade_id").agg(F.avg("ratio").alias("b"))
    base = waves.groupBy("cascade_id").agg(F.sum("n").alias("observed"), F.max_by("n", "t").alias("last"))
    b = F.coalesce("b", F.lit(0.0))
    return base.join(mean, "cascade_id", "left").select("cascade_id", F.when(b < 0.999, F.col("observed") + F.col("last") / (1 - b)).alias("predicted"))


def hawkes_decay(waves: DataFrame) -> DataFrame:
    """``cascade_id, ratio, decay``: the mean wave ratio, and minus the slope of log waves, at least 0.05."""
    slope = waves.where("n > 0").groupBy("cascade_id").agg(F.greatest(F.lit(0.05), F.coalesce(-F.regr_slope(F.log("n"), F.col("t")), F.lit(0.05))).alias("decay"))
    return slope.join(wave_ratios(waves).groupBy("cascade_id").agg(F.avg("ratio").alias("ratio")), "cascade_id", "left")


HYBRID = [*FEATURES, "ratio", "decay", "log_core"]


def hawkes_hybrid(feats: DataFrame, waves: DataFrame, finals: DataFrame, folds: int = 5, penalty: float = 1.0, least: int = 4) -> DataFrame:
    """``cascade_id, predicted``: the ``hawkes`` forecast times a fitted correction that has not seen the cascade.

    The correction is a ridge of log(final / forecast) on FEATURES, wave ratio, decay and log
    forecast (intercept not penalised). ``finals(cascade_id, final)`` are the known sizes;
    a cascade, known or not, is in the fold of its id's crc32, and is corrected by the fit
    of all other folds: one aggregation takes each fold's sums, and a fold's fit is that of
    all sums less its own. Only these sums reach the driver (a row a fold). The exponent
    stays within 5, the size at least at what is observed; with fewer than ``least`` known
    cascades in the other folds the forecast stands. Declined where the forecast is, or
    without features. Known sizes that are null or below 1 are not fitted to.
    """
    import numpy as np

    spark = feats.sparkSession
    core = hawkes(waves).withColumnRenamed("predicted", "core").join(hawkes_decay(waves), "cascade_id", "left")
    shape = core.select("cascade_id", "core", F.coalesce("ratio", F.lit(0.0)).alias("ratio"), F.coalesce("decay", F.lit(0.05)).alias("decay"), F.log(F.greatest("core", F.lit(1.0))).alias("log_core"))
    known = finals.select("cascade_id", F.col("final").cast("double").alias("final"))
    rows = feats.join(shape, "cascade_id", "left").join(known, "cascade_id", "left")
    fold = F.pmod(F.crc32(F.col("cascade_id").cast("string").cast("binary")), F.lit(folds)).cast("int")
    rows = written(rows.withColumn("fold", fold), "hybrid")
    x, k = [F.lit(1.0), *map(F.col, HYBRID)], len(HYBRID) + 1
    y = F.log("final") - F.col("log_core")
    sums = rows.where("core is not null and final >= 1").groupBy("fold").agg(F.count("*").alias("n"), F.array(*(F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k))).alias("xx"), F.array(*(F.sum(c * y) for c in x)).alias("xy")).collect()
    n = sum(r["n"] for r in sums)
    upper = np.triu_indices(k)

    def weights(rest: list) -> list[float]:
        a = np.zeros((k, k))
        a[upper] = np.sum([r["xx"] for r in rest], axis=0)
        a = np.triu(a) + np.triu(a, 1).T + penalty * np.diag([0.0] + [1.0] * (k - 1))
        return np.linalg.lstsq(a, np.sum([r["xy"] for r in rest], axis=0), rcond=None)[0].tolist()

    own = {r["fold"]: r["n"] for r in sums}
    fits = [(f, weights([r for r in sums if r["fold"] != f]) if n - own.get(f, 0) >= least else None) for f in range(folds)]
    fitted = rows.join(F.broadcast(spark.createDataFrame(fits, "fold int, w array<double>")), "fold")
    z = sum((F.element_at("w", i + 2) * F.col(c) for i, c in enumerate(HYBRID)), F.element_at("w", 1))
    corrected = F.greatest("observed", F.col("core") * F.exp(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), z))))
    return fitted.select("cascade_id", F.when(F.col("w").isNull(), F.col("core")).when(F.col("core").isNotNull(), corrected).alias("predicted"))


def self_exciting(graph: Graph, binned: DataFrame, window: int) -> DataFrame:
    """n + n b / (1 - b) with b the mean arc probability times the mean out-degree of adopters; declined from 1 on."""
    p = graph.edges.agg(F.avg("ic_p").alias("p"))
    n = binned.where(F.col("t") < window).join(structure.out_degree(graph), "node").groupBy("cascade_id").agg(F.count("*").alias("n"), F.avg("score").alias("d")).join(F.broadcast(p))
    b = F.col("p") * F.col("d")
    return n.select("cascade_id", F.when(b < 0.999, F.col("n") + F.col("n") * b / (1 - b)).alias("predicted"))


def reinforced(waves: DataFrame, window: int, horizon: int, decay: float = 0.6) -> DataFrame:
    """Reinforced Poisson: every further step adds the last rate, falling by ``decay`` and growing with the size."""
    base = waves.groupBy("cascade_id").agg(F.sum("n").cast("double").alias("observed"), F.max_by("n", "t").cast("double").alias("last"))
    rate = F.col("last") / F.greatest(F.col("observed"), F.lit(1.0))
    size = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, horizon - window))), F.col("observed"), lambda acc, i: acc + acc * rate * F.pow(F.lit(decay), i.cast("double")))
    return base.select("cascade_id", size.alias("predicted"))


def power_memory(waves: DataFrame, window: int, horizon: int, theta: float = 1.5) -> DataFrame:
    """Each further wave is the sum of all earlier ones by age ** -theta, scaled by the observed growth."""
    hist = waves.groupBy("cascade_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "n"))), lambda x: x["n"].cast("double")).alias("h"))
    recall = lambda h, upto: F.aggregate(F.sequence(F.lit(1), upto), F.lit(0.0), lambda a, j: a + F.element_at(h, j) * F.pow((upto + 1 - j).cast("double"), F.lit(-theta)))
    scale = F.element_at("h", window) / F.greatest(recall(F.col("h"), F.lit(window - 1)), F.lit(1.0)) if window > 1 else F.lit(0.0)
    scaled = hist.withColumn("c", F.least(F.lit(1.0), scale))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, horizon - window))), F.col("h"), lambda h, i: F.concat(h, F.array(F.col("c") * recall(h, F.size(h)))))
    return scaled.select("cascade_id", F.aggregate(grown, F.lit(0.0), lambda a, x: a + x).alias("predicted"))


def neighbourhood_size(graph: Graph, binned: DataFrame, window: int) -> DataFrame:
    """observed + unreached out-neighbours of the last wave."""
    f = features(graph, binned, window)
    return f.select("cascade_id", (F.col("observed") + F.col("frontier_exposed")).alias("predicted"))


def reachable_size(graph: Graph, binned: DataFrame, window: int, hops: int) -> DataFrame:
    """observed + nodes within ``hops`` of any adopter.

    The cascades that have reached a node are bits of a few longs of its row, so an arc carries all of them at once.
    """
    arcs = written(graph.edges.select("src", "dst").distinct(), "arcs")
    early = binned.where(F.col("t") < window).select("cascade_id", "node")
    ids = written(numbered(early.select("cascade_id").distinct(), [F.asc("cascade_id")], "q"), "cascades")
    bit = F.expr("shiftleft(1L, cast(q % 64 as int))")
    seen = written(early.join(F.broadcast(ids), "cascade_id").groupBy("node", F.floor(F.col("q") / 64).alias("block")).agg(F.bit_or(bit).alias("bits")).withColumn("new", F.col("bits")), "seen")
    none = F.lit(0).cast("long")
    for _ in range(hops):
        got = seen.where("new <> 0").join(arcs, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node"), "block").agg(F.bit_or("new").alias("got"))
        both = seen.select("node", "block", "bits").join(got, ["node", "block"], "full_outer").select("node", "block", F.coalesce("bits", none).alias("bits"), F.coalesce("got", none).alias("got"))
        more = written(both.select("node", "block", F.col("bits").bitwiseOR(F.col("got")).alias("bits"), F.col("got").bitwiseAND(F.bitwise_not("bits")).alias("new")), "seen")
        drop_table(seen)
        seen = more
    counts = seen.groupBy("block").agg(F.array(*(F.sum(F.expr(f"shiftright(bits, {i}) & 1L")) for i in range(64))).alias("n"))
    each = counts.select("block", F.posexplode("n").alias("at", "n")).select((F.col("block") * 64 + F.col("at")).alias("q"), "n")
    return ids.join(each, "q").select("cascade_id", F.col("n").cast("double").alias("predicted"))


def degree_scaled(graph: Graph, binned: DataFrame, window: int, horizon: int) -> DataFrame:
    """observed (1 + ratio remaining / horizon), ratio the adopters' mean degree over the graph's."""
    mean = structure.degree(graph).agg(F.avg("score").alias("all"))
    d = binned.where(F.col("t") < window).join(structure.degree(graph), "node").groupBy("cascade_id").agg(F.count("*").alias("n"), F.avg("score").alias("d")).join(F.broadcast(mean))
    return d.select("cascade_id", (F.col("n") * (1 + F.col("d") / F.greatest(F.col("all"), F.lit(1e-9)) * (horizon - window) / horizon)).alias("predicted"))


def community_spill(graph: Graph, binned: DataFrame, window: int, horizon: int) -> DataFrame:
    """observed (1 + share of adoptions outside the root's community * sqrt(remaining steps))."""
    labels = structure.communities(graph)
    a = binned.where(F.col("t") < window).join(labels, "node")
    root = a.groupBy("cascade_id").agg(F.min(F.struct("t", "node", "label"))["label"].alias("home"))
    j = a.join(root, "cascade_id").groupBy("cascade_id").agg(F.count("*").alias("n"), F.avg((F.col("label") != F.col("home")).cast("double")).alias("escape"))
    return j.select("cascade_id", (F.col("n") * (1 + F.col("escape") * F.lit(math.sqrt(max(0, horizon - window))))).alias("predicted"))


def random_size(observed: DataFrame, examples: DataFrame, seed: int = 0) -> DataFrame:
    """A random training size, at least what is observed; drawn by a hash of the cascade."""
    sizes = examples.select("final", (F.row_number().over(Window.orderBy("final")) - 1).alias("at"))
    n = max(1, examples.count())
    return observed.select("cascade_id", "observed").withColumn("at", F.pmod(F.crc32(F.concat_ws("#", F.lit(str(seed)), F.col("cascade_id")).cast("binary")), F.lit(n))).join(F.broadcast(sizes), "at", "left").select("cascade_id", F.greatest(F.col("observed"), F.coalesce("final", F.lit(0))).cast("double").alias("predicted"))


def forward_simulation(graph: Graph, binned: DataFrame, window: int, steps: int, runs: int = 20) -> DataFrame:
    """Mean size when the last wave spreads on for ``steps`` by independent cascade among unreached nodes."""
    seen = written(binned.where(F.col("t") < window), "seen")
    front = seen.where(F.col("t") == window - 1).select("cascade_id", "node")
    done = seen.where(F.col("t") < window - 1).select("cascade_id", "node")
    h = dynamics.ic_samples(graph, front, runs, steps, blocked=done)
    grown = dynamics.mean_spread(h, runs, ["cascade_id"])
    n = seen.groupBy("cascade_id").agg(F.count("*").alias("n"), F.sum((F.col("t") == window - 1).cast("int")).alias("f"))
    return n.join(grown, "cascade_id", "left").select("cascade_id", (F.col("n") - F.col("f") + F.coalesce("spread", F.lit(0.0))).alias("predicted"))


def validated(forecasts: DataFrame, observed: DataFrame) -> DataFrame:
    """Forecasts that are finite and at least what is observed; others are declined."""
    ok = F.col("predicted").isNotNull() & ~F.isnan("predicted") & (F.abs("predicted") < float("inf")) & (F.col("predicted") >= F.col("observed"))
    return observed.join(forecasts, "cascade_id", "left").select("cascade_id", "observed", F.when(ok, F.col("predicted")).alias("predicted"))
