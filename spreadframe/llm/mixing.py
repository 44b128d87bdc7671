"""Mixing sources to target weights by Pareto order sampling.

A source's ratio of target to size is a number of certain whole copies of each of its
documents and a fraction, which is sampled with unequal probabilities: a document's
inclusion odds are the fraction's odds times its size over the mean size of its source,
so longer documents are likelier and none is certain. With a random number u it ranks by
(u / (1 - u)) over those odds: the lowest ranks are taken while their words are within
what the certain copies leave of the target, and one more document fills the rest as well
as any can, so the sample has a fixed size in words. Ranks are found by their place among
buckets first, so no source is ordered in one task: the logarithm of the rank has a density
of at most a quarter, whatever the sizes, so each of the buckets holds few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size and target from ``source, source_size`` (a row for each source).

    Sources in code point order, null last, take the weights in turn. A target is the
    weight's share of ``share`` times all sizes, at most ``most`` times its source's size;
    the excess goes to the others by weight. A source is at its limit iff its limit for a
    weight is below the level that the sources after it in that order would reach.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    limit = F.lit(float(most)) * F.col("source_size")
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, after = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()) - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level).withColumn("full", limit <= F.col("weight") * F.col("level"))
    # the first source that is not at its limit sets the level of all that follow
    free = F.min(F.when(~F.col("full"), F.struct((F.col("source_size") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(Window.partitionBy())
    return levels.withColumn("free", free).select("source", "source_size", F.when(F.col("free").isNull() | F.col("full"), limit).otherwise(F.col("weight") * F.col("free.level")).alias("target"))


def uniform(seed: int, *cols: Column) -> Column:
    """A reproducible number strictly between 0 and 1 from 52 bits of an MD5."""
    key = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("-")) for c in cols))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with size, source_size, target, copies and taken.

    ``docs`` has ``doc_id``, ``text`` and ``source``; columns of the new names are
    replaced. size counts words (null text: 0), taken is copies times size. A null source
    is a source of its own. Documents without words get the certain copies only and take
    nothing. Repeated rows draw the same number and are then ordered by their place in the
    table. An empty table gives an empty one.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    own = [c for c in carry or docs.columns if c not in new and not c.startswith("_mix")]
    sized = docs.select(*dict.fromkeys(["doc_id", "source", *own]), words(F.col("text")).alias("size"))
    drawn = sized.select("*", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_mix_key"), F.col("source").isNull().alias("_mix_none"), uniform(seed, F.col("doc_id"), F.col("size")).alias("_mix_u"), F.monotonically_increasing_id().alias("_mix_row"))
    drawn, group = written(drawn, "sized"), ["_mix_key", "_mix_none"]

    totals = drawn.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    totals = written(totals, "sources")
    targets = source_targets(totals.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.join(totals.select("source", "n"), F.col("s").eqNullSafe(F.col("source"))).select(
        F.coalesce("source", F.lit("")).alias("_mix_key"), F.col("source").isNull().alias("_mix_none"), "source_size", "target",
        whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("goal"), "n",
    )
    plan = written(plan, "targets")

    p = F.try_divide(F.col("goal"), F.col("source_size"))
    odds = F.try_divide(F.col("_mix_u") / (1 - F.col("_mix_u")), p / (1 - p) * (F.col("size") / (F.col("source_size") / F.col("n"))))
    rank = F.struct(odds.alias("odds"), "doc_id", F.col("_mix_row").alias("row"))
    narrow = drawn.select(*group, "doc_id", "size", "_mix_u", "_mix_row").where("size > 0").join(plan, group).where("goal > 0")
    ranked = narrow.select(*group, "size", "goal", F.floor(F.log(odds) * F.sqrt("n") / 4).alias("bucket"), rank.alias("rank"))
    per = ranked.groupBy(*group, "bucket", "goal").agg(F.sum("size").alias("words"), F.max("rank").alias("top"))
    in_order = Window.partitionBy(*group).orderBy("bucket")
    upto, below = F.sum("words").over(in_order.rowsBetween(Window.unboundedPreceding, 0)), F.max("top").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    cut = per.withColumn("upto", upto).withColumn("below", below).where("upto >= goal and upto - words < goal").select(*group, "below", "top", (F.col("upto") - F.col("words")).alias("before"))
    cut = written(cut, "cuts")
    # within the bucket that crosses the goal: the last rank at which the running words are within it
    so_far = F.col("before") + F.sum("size").over(Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    within = ranked.join(cut, group).where((F.col("rank") <= F.col("top")) & F.coalesce(F.col("rank") > F.col("below"), F.lit(True))).select(*group, "goal", "rank", so_far.alias("so_far"))
    edge = within.where("so_far <= goal").groupBy(*group).agg(F.max("rank").alias("edge"), F.max("so_far").alias("so_far"))
    edges = written(cut.join(edge, group, "left").select(*group, F.coalesce("edge", "below").alias("edge"), F.coalesce("so_far", "before").alias("so_far")), "edges")
    # and of the ranks after it, the one document whose words come nearest to what is missing, if that is nearer than none
    missing = F.col("goal") - F.col("so_far")
    rest = ranked.join(edges, group).where(F.coalesce(F.col("rank") > F.col("edge"), F.lit(True))).select(*group, F.struct(F.abs(missing - F.col("size")).alias("off"), "rank").alias("last"), missing.alias("missing"))
    last = rest.groupBy(*group).agg(F.min("last").alias("last"), F.first("missing").alias("missing")).select(*group, F.when(F.col("last.off") < F.col("missing"), F.col("last.rank")).alias("last"))
    limits = written(plan.join(edges.drop("so_far"), group, "left").join(last, group, "left"), "limits")

    under = F.coalesce(rank <= F.col("edge"), F.lit(False))
    extra = (F.col("size") > 0) & (F.col("goal") > 0) & (under | F.coalesce(rank == F.col("last"), F.lit(False)))
    out = drawn.join(limits, group).withColumn("copies", F.col("whole") + F.when(extra, 1).otherwise(0))
    return out.select(*own, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
