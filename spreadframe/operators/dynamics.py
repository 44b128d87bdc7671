"""Spreading dynamics: live-edge Monte Carlo, exact one-step marginals, two cascades, compartments.

States are long tables keyed by ``sample``; every random decision is a coin of its arc or
node and sample, so plans that are compared share their random numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Graph, iterate, product_of
from ..functions.coins import coin
from ..shared import drop_table, written

# --- interventions


def apply_edge_actions(edges: DataFrame, actions: DataFrame) -> DataFrame:
    """Edges after ``actions(op, target, destination, weight)``: add_edge, remove_edge, set_edge_weight, remove_node.

    Of several actions on one arc the last ``seq`` counts, if there is such a column.
    """
    seq = F.col("seq") if "seq" in actions.columns else F.lit(0)
    on_arc = actions.where(F.col("op").isin("add_edge", "remove_edge", "set_edge_weight")).groupBy(F.col("target").alias("src"), F.col("destination").alias("dst")).agg(F.max_by(F.struct("op", "weight"), seq).alias("a"))
    joined = edges.join(on_arc, ["src", "dst"], "full_outer")
    had = F.col("ic_p").isNotNull()
    p = F.when(F.col("a").isNull(), F.col("ic_p")).when(F.col("a.op") == "remove_edge", None).when(F.col("a.op") == "add_edge", F.coalesce("a.weight", "ic_p")).when(had, F.col("a.weight"))
    left = joined.select("src", "dst", p.alias("ic_p")).where("ic_p is not null")
    gone = actions.where("op = 'remove_node'").select(F.col("target").alias("node")).distinct()
    return left.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti")


def edges_as_of(edges: DataFrame, log: DataFrame, t: int | Column) -> DataFrame:
    """The arcs visible at ``t``: the last of ``log(t, seq, op, src, dst, ic_p)`` on an arc up to then decides."""
    last = log.where(F.col("t") <= t).groupBy("src", "dst").agg(F.max_by(F.struct("op", "ic_p"), F.struct("t", "seq")).alias("a"))
    joined = edges.select("src", "dst", F.col("ic_p").alias("base")).join(last, ["src", "dst"], "full_outer")
    p = F.when(F.col("a").isNull(), F.col("base")).when(F.col("a.op") == "delete", None).otherwise(F.coalesce("a.ic_p", "base"))
    return joined.select("src", "dst", p.alias("ic_p")).where("ic_p is not null")


def edge_edit_stream(graph: Graph, horizon: int, rate: float, seed: int = 0) -> DataFrame:
    """A log of exogenous edits: each step after 0 deletes arcs by coin and inserts as many between kept nodes."""
    e = graph.edges.select("src", "dst", "ic_p")
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("t")
    hit = e.select("*", steps).where(coin(F.col("src"), F.col("dst"), F.col("t") + 1000 * seed, "edit") < rate)
    drop = hit.select("t", F.lit(0).alias("seq"), F.lit("delete").alias("op"), "src", "dst", F.lit(None).cast("double").alias("ic_p"))
    # the inserted arc keeps tail and probability and turns the head around
    turned = hit.select("t", F.lit(1).alias("seq"), F.lit("insert").alias("op"), F.col("dst").alias("src"), F.col("src").alias("dst"), "ic_p")
    return drop.unionByName(turned)


def delete_node_actions(graph: Graph, nodes: DataFrame) -> DataFrame:
    """``op, target, destination``: remove_node and the removal of every incident arc, both orientations."""
    n = nodes.select("node").distinct()
    removal = n.select(F.lit("remove_node").alias("op"), F.col("node").alias("target"), F.lit(None).cast("long").alias("destination"))
    arcs = graph.edges.join(n, F.col("src") == F.col("node"), "left_semi").unionByName(graph.edges.join(n, F.col("dst") == F.col("node"), "left_semi")).select("src", "dst").distinct()
    return removal.unionByName(arcs.select(F.lit("remove_edge").alias("op"), F.col("src").alias("target"), F.col("dst").alias("destination")))


# --- independent cascade


def samples(df: DataFrame, runs: int) -> DataFrame:
    return df.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))


def live_edges(graph: Graph, runs: int, seed: int = 0) -> DataFrame:
    """``sample, src, dst``: each arc kept with its probability in each sample."""
    s = F.col("sample") + runs * seed
    return samples(graph.edges.select("src", "dst", "ic_p"), runs).where(coin(F.col("src"), F.col("dst"), s, "arc") < F.col("ic_p")).select("sample", "src", "dst")


def spread_over(live: DataFrame, seeds: DataFrame, horizon: int, blocked: DataFrame | None = None) -> DataFrame:
    """``(keys,) sample, node, t, parent``: breadth-first over live arcs from ``seeds(keys, sample, node)``.

    A node's parent is the smallest active neighbour with a live arc to it. Columns of
    ``seeds`` other than node are the key, so many plans run in one job. ``blocked(keys, node)``
    nodes are never reached.
    """
    keys = [c for c in seeds.columns if c != "node"]
    on = [k for k in keys if k in live.columns]
    stop = None if blocked is None else [c for c in blocked.columns if c in [*keys, "node"]]
    live = written(live, "live")
    front = seeds if blocked is None else seeds.join(blocked, stop, "left_anti")
    front = written(front.distinct().select(*keys, "node", F.lit(0).alias("t"), F.lit(None).cast("long").alias("parent")), "front")
    seen = front
    for t in range(1, horizon + 1):
        arcs = live.withColumnRenamed("src", "node")
        new = front.select(*keys, "node").join(arcs, [*on, "node"]).groupBy(*keys, "dst").agg(F.min("node").alias("parent")).withColumnRenamed("dst", "node")
        new = new.join(seen, [*keys, "node"], "left_anti")
        new = new if blocked is None else new.join(blocked, stop, "left_anti")
        front = written(new.select(*keys, "node", F.lit(t).alias("t"), "parent"), "front")
        if front.isEmpty():
            break
        seen = written(seen.unionByName(front), "seen")
    return seen


def ic_samples(graph: Graph, seeds: DataFrame, runs: int, horizon: int, seed: int = 0, blocked: DataFrame | None = None) -> DataFrame:
    """Independent cascade episodes: an arc is tried once, so live arcs give the same histories as coins step by step."""
    keys = [c for c in seeds.columns if c != "node"]
    return spread_over(live_edges(graph, runs, seed), samples(seeds.select(*keys, "node"), runs), horizon, blocked)


def mean_spread(history: DataFrame, runs: int, keys: list[str] | None = None) -> DataFrame:
    """``(keys,) spread, se`` over samples; a sample without nodes counts zero."""
    keys = keys or []
    per = history.groupBy(*keys, "sample").agg(F.count("*").cast("double").alias("n"))
    total, square = F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0))
    out = per.groupBy(*keys).agg((total / runs).alias("spread"), (square / runs).alias("_sq"))
    var = F.greatest(F.lit(0.0), F.col("_sq") - F.col("spread") * F.col("spread")) * (runs / max(1, runs - 1))
    return out.select(*keys, "spread", F.sqrt(var / runs).alias("se"))


def marginals(history: DataFrame, runs: int, keys: list[str] | None = None) -> DataFrame:
    """``(keys,) node, p``: how often a node is reached."""
    return history.groupBy(*(keys or []), "node").agg((F.count("*") / runs).alias("p"))


def curve(history: DataFrame, runs: int, horizon: int) -> DataFrame:
    """``t, mean``: mean number reached by each step."""
    per = history.groupBy("t").agg(F.count("*").alias("n"))
    steps = history.sparkSession.range(horizon + 1).select(F.col("id").cast("int").alias("at"))
    return steps.join(per, F.col("t") <= F.col("at"), "left").groupBy(F.col("at").alias("t")).agg((F.coalesce(F.sum("n"), F.lit(0)) / runs).alias("mean"))


def ic_step_marginals(graph: Graph, infected: DataFrame, frontier: DataFrame) -> DataFrame:
    """``node, p``: next-step infection probability, 1 - product over frontier in-neighbours of (1 - p)."""
    hit = graph.edges.join(frontier.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(product_of(F.col("ic_p")).alias("new"))
    on = infected.select("node", F.lit(True).alias("on"))
    return graph.nodes.join(on, "node", "left").join(hit, "node", "left").select("node", F.when(F.col("on"), 1.0).otherwise(F.coalesce("new", F.lit(0.0))).alias("p"))


def union_marginal(per_campaign: DataFrame) -> DataFrame:
    """``node, p`` of being reached by any campaign, from ``campaign, node, p``."""
    return per_campaign.groupBy("node").agg(product_of(F.col("p")).alias("p"))


# --- linear threshold


def lt_samples(graph: Graph, seeds: DataFrame, runs: int, horizon: int, seed: int = 0, weighted: bool = False) -> DataFrame:
    """``sample, node, t``: a node turns active when its active share of in-neighbours reaches its threshold.

    The share is unweighted, or the sum of arc weights with ``weighted``. Seeds may carry keys.
    """
    keys = [c for c in seeds.columns if c != "node"]
    indeg = graph.edges.groupBy("dst").agg(F.count("*").alias("n_in"))
    arcs = written(graph.edges.join(indeg, "dst").select("src", F.col("dst"), (F.col("ic_p") if weighted else F.lit(1.0) / F.col("n_in")).alias("share")), "arcs")
    start = samples(seeds.select(*keys, "node"), runs).distinct().withColumn("t", F.lit(0))

    def step(now: DataFrame, i: int) -> DataFrame:
        got = now.join(arcs, F.col("node") == F.col("src")).groupBy(*keys, "sample", "dst").agg(F.sum("share").alias("f"))
        over = got.where(F.col("f") + 1e-12 >= coin(F.col("dst"), 0, F.col("sample") + runs * seed, "threshold")).select(*keys, "sample", F.col("dst").alias("node"))
        return now.unionByName(over.join(now, [*keys, "sample", "node"], "left_anti").withColumn("t", F.lit(i + 1)))

    return iterate(start, step, horizon, lambda a, b: a.count() == b.count(), "active")


def lt_hazard(graph: Graph, before: DataFrame, now: DataFrame) -> DataFrame:
    """``node, p``: chance to turn active given that the shares in ``before(node)`` did not suffice.

    (f_now - f_before) / (1 - f_before), at least 0, over unweighted shares; 1 for active nodes.
    """
    indeg = graph.edges.groupBy("dst").agg(F.count("*").alias("n_in"))
    marked = graph.edges.join(indeg, "dst").join(before.select(F.col("node").alias("src"), F.lit(1.0).alias("was")), "src", "left").join(now.select(F.col("node").alias("src"), F.lit(1.0).alias("is")), "src", "left")
    f = marked.groupBy(F.col("dst").alias("node")).agg(F.sum(F.coalesce("was", F.lit(0.0)) / F.col("n_in")).alias("f0"), F.sum(F.coalesce("is", F.lit(0.0)) / F.col("n_in")).alias("f1"))
    hazard = F.greatest(F.lit(0.0), F.col("f1") - F.col("f0")) / F.greatest(F.lit(1e-9), 1 - F.col("f0"))
    on = now.select("node", F.lit(True).alias("on"))
    return graph.nodes.join(f, "node", "left").join(on, "node", "left").select("node", F.when(F.col("on"), 1.0).otherwise(F.coalesce(hazard, F.lit(0.0))).alias("p"))


# --- two competing cascades


def resolve_tie_break(tie_break: str, model: str) -> str:
    """Which side takes a node that both reach: ``auto`` is positive under IC and negative under LT."""
    if tie_break == "auto":
        return "positive" if model == "ic" else "negative"
    if tie_break not in ("positive", "negative", "random"):
        raise ValueError(f"unknown tie break {tie_break!r}")
    return tie_break


def competitive_samples(graph: Graph, negative: DataFrame, positive: DataFrame, runs: int, horizon: int, model: str = "ic", tie_break: str = "auto", positive_p: float | None = None, seed: int = 0, blocked: DataFrame | None = None) -> DataFrame:
    """``sample, node, t, side``: two cascades on one graph; a node belongs to the side that takes it first.

    Both sides step from the same snapshot. Under IC an arc carries each side by its own
    coin below its probability (``positive_p`` for all arcs of the positive side, if given);
    under LT each side has a threshold of its own.
    """
    rule = resolve_tie_break(tie_break, model)
    s = F.col("sample") + runs * seed
    neg = negative.select("node", F.lit("negative").alias("side"))
    pos = positive.join(negative, "node", "left_anti").select("node", F.lit("positive").alias("side"))
    start = samples(neg.unionByName(pos).distinct(), runs).select("sample", "node", F.lit(0).alias("t"), "side")
    start = start if blocked is None else start.join(blocked, "node", "left_anti")
    arcs = written(graph.edges.select("src", "dst", "ic_p"), "arcs")

    def step(now: DataFrame, i: int) -> DataFrame:
        if model == "ic":
            tried = now.where(F.col("t") == i).join(arcs, F.col("node") == F.col("src"))
            p = F.when((F.col("side") == "positive") & F.lit(positive_p is not None), F.lit(positive_p or 0.0)).otherwise(F.col("ic_p"))
            salt = F.when(F.col("side") == "positive", 1).otherwise(0)
            hit = tried.where(coin(F.col("src"), F.col("dst"), s * 2 + salt, "arc") < p)
            got = hit.groupBy("sample", "dst").agg(F.max((F.col("side") == "negative").cast("int")).alias("n"), F.max((F.col("side") == "positive").cast("int")).alias("p"))
        else:
            mass = now.join(arcs, F.col("node") == F.col("src")).groupBy("sample", "dst").agg(F.sum(F.when(F.col("side") == "negative", F.col("ic_p"))).alias("fn"), F.sum(F.when(F.col("side") == "positive", F.col("ic_p"))).alias("fp"))
            over = lambda f, salt: ((F.coalesce(F.col(f), F.lit(0.0)) > 0) & (F.col(f) + 1e-12 >= coin(F.col("dst"), 0, s, salt))).cast("int")
            got = mass.select("sample", "dst", F.coalesce(over("fn", "threshold"), F.lit(0)).alias("n"), F.coalesce(over("fp", "threshold2"), F.lit(0)).alias("p")).where("n + p > 0")
        first = {"positive": F.lit("positive"), "negative": F.lit("negative"), "random": F.when(coin(F.col("dst"), 0, s, "tie") < 0.5, "positive").otherwise("negative")}[rule]
        side = F.when(F.col("n") + F.col("p") == 2, first).when(F.col("p") == 1, "positive").otherwise("negative")
        new = got.select("sample", F.col("dst").alias("node"), F.lit(i + 1).alias("t"), side.alias("side")).join(now, ["sample", "node"], "left_anti")
        return now.unionByName(new if blocked is None else new.join(blocked, "node", "left_anti"))

    return iterate(start, step, horizon, lambda a, b: a.count() == b.count(), "sides")


def competitive_ic_marginals(graph: Graph, negative: DataFrame, positive: DataFrame, taken: DataFrame, tie_break: str = "positive") -> DataFrame:
    """``node, p_negative, p_positive`` of the next step from the two frontiers; ``taken(node)`` nodes cannot be reached."""
    def reach(front: DataFrame, name: str) -> DataFrame:
        return graph.edges.join(front.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(product_of(F.col("ic_p")).alias(name))

    j = graph.nodes.join(taken, "node", "left_anti").join(reach(negative, "n"), "node", "left").join(reach(positive, "p"), "node", "left")
    n, p = F.coalesce("n", F.lit(0.0)), F.coalesce("p", F.lit(0.0))
    share = {"positive": 1.0, "negative": 0.0, "random": 0.5}[tie_break]
    return j.select("node", (n * (1 - p * share)).alias("p_negative"), (p * (1 - n * (1 - share))).alias("p_positive"))


# --- compartments


@dataclass(frozen=True)
class EpidemicConfig:
    beta_scale: float = 1.0
    gamma: float = 0.3
    alpha: float = 0.5
    burn_in: float = 0.5


def epidemic_samples(graph: Graph, sources: DataFrame, runs: int, horizon: int, model: str = "sir", config: EpidemicConfig = EpidemicConfig(), seed: int = 0, immune: DataFrame | None = None) -> DataFrame:
    """``sample, node, t, state``: the state of every node that has left S (or come back), at every step.

    All moves of a step are made from one snapshot: infectious nodes try their arcs with
    min(1, beta_scale * p), leave I with ``gamma`` (to R, or back to S under sis), and
    exposed ones become infectious with ``alpha`` (seir). A step without I and E ends it.
    """
    s = F.col("sample") + runs * seed
    arcs = written(graph.edges.select("src", "dst", F.least(F.lit(1.0), F.lit(config.beta_scale) * F.col("ic_p")).alias("ic_p")), "arcs")
    first = samples(sources.select("node").distinct(), runs)
    first = first if immune is None else first.join(immune, "node", "left_anti")
    now = written(first.select("sample", "node", F.lit("I").alias("state")), "now")
    out = now.select("sample", "node", F.lit(0).alias("t"), "state")
    for t in range(1, horizon + 1):
        # arcs and nodes are tried at every step, so the step is part of the coin
        at = s + 1000003 * t
        hit = now.where("state = 'I'").join(arcs, F.col("node") == F.col("src")).where(coin(F.col("src"), F.col("dst"), at, "arc") < F.col("ic_p")).select("sample", F.col("dst").alias("node")).distinct()
        hit = hit if immune is None else hit.join(immune, "node", "left_anti")
        caught = hit.join(now.where("state <> 'S'"), ["sample", "node"], "left_anti").select("sample", "node", F.lit("E" if model == "seir" else "I").alias("new"))
        leave = coin(F.col("node"), 1, at, "recover") < config.gamma
        turn = coin(F.col("node"), 2, at, "recover") < config.alpha
        moved = now.select("sample", "node", F.when((F.col("state") == "I") & leave, "S" if model == "sis" else "R").when((F.col("state") == "E") & turn, "I").otherwise(F.col("state")).alias("moved"))
        nxt = moved.join(caught, ["sample", "node"], "full_outer").select("sample", "node", F.coalesce("new", "moved").alias("state"))
        new = written(nxt, "now")
        drop_table(now) if t > 1 else None
        out = written(out.unionByName(new.select("sample", "node", F.lit(t).alias("t"), "state")), "states")
        now = new
        if now.where("state in ('I', 'E')").isEmpty():
            break
    return out


def prevalence(states: DataFrame, runs: int) -> DataFrame:
    """``t, infectious, ever``: mean numbers at each step; ever counts nodes that have left S once."""
    return states.groupBy("t").agg((F.sum((F.col("state") == "I").cast("int")) / runs).alias("infectious"), (F.count("*") / runs).alias("ever"))


def epidemic_step_marginals(graph: Graph, state: DataFrame, config: EpidemicConfig = EpidemicConfig(), model: str = "sir") -> DataFrame:
    """``node, p_s, p_e, p_i, p_r`` after one step from ``state(node, state)``; other nodes are susceptible."""
    beta = F.least(F.lit(1.0), F.lit(config.beta_scale) * F.col("ic_p"))
    hit = graph.edges.join(state.where("state = 'I'").select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(product_of(beta).alias("x"))
    j = graph.nodes.join(state, "node", "left").join(hit, "node", "left").select("node", F.coalesce("state", F.lit("S")).alias("state"), F.coalesce("x", F.lit(0.0)).alias("x"))
    g, a = config.gamma, config.alpha
    is_ = lambda k: F.col("state") == k
    zero = F.lit(0.0)
    p_s = F.when(is_("S"), 1 - F.col("x")).when(is_("I") & F.lit(model == "sis"), g).otherwise(zero)
    p_e = F.when(is_("S") & F.lit(model == "seir"), F.col("x")).when(is_("E"), 1 - a).otherwise(zero)
    p_i = F.when(is_("S") & F.lit(model != "seir"), F.col("x")).when(is_("E"), a).when(is_("I"), 1 - g).otherwise(zero)
    p_r = F.when(is_("R"), 1.0).when(is_("I") & F.lit(model != "sis"), g).otherwise(zero)
    return j.select("node", p_s.alias("p_s"), p_e.alias("p_e"), p_i.alias("p_i"), p_r.alias("p_r"))


def endemic_prevalence(curve: DataFrame, burn_in: float = 0.5) -> DataFrame:
    """One value: the mean of ``curve(t, value)`` from the burn-in share of its length on."""
    n = curve.agg((F.max("t") + 1).alias("n"))
    return curve.join(F.broadcast(n), F.col("t") >= F.floor(F.col("n") * burn_in)).agg(F.avg("value").alias("endemic"))


# --- mean field


def mean_field(graph: Graph, seeds: DataFrame, horizon: int) -> DataFrame:
    """``t, node, infected, frontier``: independent-node rollout of IC with probabilities for states.

    infected' = infected + (1 - infected) * new, new = 1 - product of (1 - p * frontier).
    """
    start = graph.nodes.join(seeds.select("node", F.lit(1.0).alias("x")), "node", "left").select("node", F.coalesce("x", F.lit(0.0)).alias("infected"))
    now = written(start.select("node", "infected", F.col("infected").alias("frontier")), "field")
    out = now.select(F.lit(0).alias("t"), "node", "infected", "frontier")
    for t in range(1, horizon + 1):
        new = graph.edges.join(now.where("frontier > 0"), F.col("src") == F.col("node")).groupBy("dst").agg(product_of(F.col("ic_p") * F.col("frontier")).alias("x"))
        gain = (1 - F.col("infected")) * F.coalesce("x", F.lit(0.0))
        now = written(now.join(new, F.col("node") == F.col("dst"), "left").select("node", (F.col("infected") + gain).alias("infected"), gain.alias("frontier")), "field")
        out = out.unionByName(now.select(F.lit(t).alias("t"), "node", "infected", "frontier"))
    return out
