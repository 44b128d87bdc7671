"""Choosing nodes and arcs under a budget: seeds, removals, blockers, doses.

Scores are tables; ties go to the smallest id. Greedy selectors are a loop of ``k``
dependent jobs that bring one winning row to the driver each. A choice is ``node, rank``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import Graph, numbered, top_k, undirected
from ..functions.coins import coin
from ..shared import drop_table, written
from . import dynamics, structure


def nodes_of(graph: Graph, ids: list[int]) -> DataFrame:
    return graph.nodes.sparkSession.createDataFrame([(int(i),) for i in ids], "node long")


def ranked(graph: Graph, ids: list[int]) -> DataFrame:
    return graph.nodes.sparkSession.createDataFrame([(int(i), r + 1) for r, i in enumerate(ids)], "node long, rank int")


def padded(graph: Graph, chosen: DataFrame, k: int, protected: DataFrame | None = None) -> DataFrame:
    """``node, rank`` of k nodes: the chosen ones first, then unused ones by degree."""
    rest = structure.degree(graph).join(chosen, "node", "left_anti")
    rest = rest if protected is None else rest.join(protected, "node", "left_anti")
    fill = rest.orderBy(F.desc("score"), "node").limit(k).select("node", F.lit(1).alias("late"), (-F.col("score")).alias("at"))
    both = chosen.select("node", F.lit(0).alias("late"), F.col("rank").cast("double").alias("at")).unionByName(fill).orderBy("late", "at", "node").limit(k)
    return both.select("node", F.row_number().over(Window.orderBy("late", "at", "node")).alias("rank"))


def by_score(graph: Graph, scores: DataFrame, k: int, protected: DataFrame | None = None) -> DataFrame:
    left = scores if protected is None else scores.join(protected, "node", "left_anti")
    return top_k(left, k).select("node", "rank")


def random_choice(graph: Graph, k: int, seed: int = 0, protected: DataFrame | None = None) -> DataFrame:
    return by_score(graph, graph.nodes.select("node", (-coin(F.col("node"), 7, seed, "pick")).alias("score")), k, protected)


def _best(scores: DataFrame) -> tuple[int, float] | None:
    row = scores.orderBy(F.desc("score"), "node").first()
    return None if row is None else (row["node"], row["score"])


def greedy(k: int, score: Callable[[list[int]], DataFrame]) -> list[int]:
    """Up to ``k`` nodes, each the best of ``score(chosen so far)``, which leaves out the chosen."""
    chosen: list[int] = []
    for _ in range(k):
        best = _best(score(chosen))
        if best is None:
            break
        chosen.append(best[0])
    return chosen


# --- seeds


def degree_discount(graph: Graph, k: int) -> list[int]:
    """d - 2t - (d - t) t p with d distinct neighbours, t of them chosen, p the mean arc probability."""
    near = written(undirected(graph.edges), "arcs")
    d = written(structure.neighbour_degree(graph), "degree")
    p = graph.edges.agg(F.avg("ic_p")).first()[0] or 0.0

    def score(chosen: list[int]) -> DataFrame:
        t = near.where(F.col("src").isin(chosen)).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("t")) if chosen else d.select("node", F.lit(0).alias("t")).limit(0)
        j = d.where(~F.col("node").isin(chosen)) if chosen else d
        t_ = F.coalesce("t", F.lit(0))
        return j.join(t, "node", "left").select("node", (F.col("score") - 2 * t_ - (F.col("score") - t_) * t_ * F.lit(p)).alias("score"))

    return greedy(k, score)


def voterank(graph: Graph, k: int) -> list[int]:
    """Neighbours vote with their ability; the elected one's falls to 0 and its neighbours' by 1 / mean degree."""
    near = written(undirected(graph.edges), "arcs")
    mean = (near.count() / max(1, graph.nodes.count())) or 1.0
    ability = written(graph.nodes.select("node", F.lit(1.0).alias("vote")), "votes")
    chosen: list[int] = []
    for _ in range(k):
        votes = near.join(ability, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum("vote").alias("score")).select(F.col("dst").alias("node"), "score")
        best = _best(votes.where(~F.col("node").isin(chosen)) if chosen else votes)
        if best is None or best[1] <= 0:
            break
        chosen.append(best[0])
        hit = near.where(F.col("src") == best[0]).select(F.col("dst").alias("node"), F.lit(1.0 / mean).alias("less"))
        ability = written(ability.join(hit, "node", "left").select("node", F.when(F.col("node") == best[0], 0.0).otherwise(F.greatest(F.lit(0.0), F.col("vote") - F.coalesce("less", F.lit(0.0)))).alias("vote")), "votes")
    return chosen


#: Rounds after which ended sets are laid aside.
ASIDE = 4


def reverse_sets(graph: Graph, theta: int, seed: int = 0, max_hops: int = 1 << 10) -> DataFrame:
    """``rr_id, node``: nodes that reach a random root over the live arcs of sample ``rr_id``.

    Coins are drawn where a set's frontier meets an arc, so no arc is copied for every set.
    """
    spark = graph.nodes.sparkSession
    ids = written(graph.nodes.select("node").distinct(), "nodes")
    n = ids.count()
    placed = numbered(ids, [F.asc("node")], "at")
    roots = spark.range(theta).select(F.col("id").alias("rr_id"), F.floor(coin(F.col("id"), 3, seed, "root") * n).cast("int").alias("at")).join(placed, "at").select("rr_id", "node")
    arcs = written(graph.edges.select("src", "dst", "ic_p"), "arcs")
    front = written(roots, "front")
    # sets whose front has died are laid aside, so a round looks only at those that still grow, and no round writes them again
    parts, done = [front], []
    for turn in range(max_hops):
        more = front.join(arcs, F.col("node") == F.col("dst")).where(coin(F.col("src"), F.col("dst"), F.col("rr_id") + 100003 * seed, "arc") < F.col("ic_p")).select("rr_id", F.col("src").alias("node")).distinct()
        front = written(more.join(reduce(DataFrame.unionByName, parts), ["rr_id", "node"], "left_anti"), "front")
        if front.isEmpty():
            break
        parts.append(front)
        if len(parts) > ASIDE:
            whole, alive = reduce(DataFrame.unionByName, parts), front.select("rr_id").distinct()
            ended, growing = written(whole.join(alive, "rr_id", "left_anti"), "ended"), written(whole.join(alive, "rr_id", "left_semi"), "growing")
            for old in parts[:-1]:
                drop_table(old)
            parts = [growing]
            done.append(ended)
    return reduce(DataFrame.unionByName, [*done, *parts])


def max_coverage(sets: DataFrame, k: int, candidates: DataFrame | None = None) -> list[int]:
    """Greedy cover of ``sets(rr_id, node)``: a pick takes the most sets not yet hit."""
    left = written(sets if candidates is None else sets.join(candidates, "node", "left_semi"), "sets")
    chosen: list[int] = []
    for _ in range(k):
        best = _best(left.groupBy("node").agg(F.count("*").alias("score")))
        if best is None:
            break
        chosen.append(best[0])
        left = written(left.join(left.where(F.col("node") == best[0]).select("rr_id"), "rr_id", "left_anti"), "sets")
    return chosen


def sample_size(n: int, k: int, epsilon: float = 0.2, least: int = 200, most: int | None = None) -> int:
    """(k + 1) n ln n / epsilon**2, at least ``least``; ``most``, if given, gives up the guarantee of epsilon."""
    import math

    size = int(max(least, (k + 1) * n * math.log(max(2, n)) / epsilon**2))
    return size if most is None else min(most, size)


def ris(graph: Graph, k: int, theta: int | None = None, seed: int = 0, least_size: int = 1) -> list[int]:
    """Reverse-reachable sets and greedy cover; sets smaller than ``least_size`` are left out."""
    sets = reverse_sets(graph, theta or sample_size(graph.nodes.count(), k), seed)
    if least_size > 1:
        sets = sets.join(sets.groupBy("rr_id").count().where(F.col("count") >= least_size), "rr_id", "left_semi")
    return max_coverage(sets, k)


def imm(graph: Graph, k: int, epsilon: float = 0.5) -> list[int]:
    """Two levels of sets, at 2 epsilon and epsilon, taken together."""
    n = graph.nodes.count()
    a, b = (reverse_sets(graph, sample_size(n, k, e), i) for i, e in enumerate((2 * epsilon, epsilon)))
    return max_coverage(a.unionByName(b.select((F.col("rr_id") + (1 << 40)).alias("rr_id"), "node")), k)


def ssa(graph: Graph, k: int, theta: int = 200, doublings: int = 4, stable: float = 0.9) -> list[int]:
    """Double the sets until 90 % of the choice repeats."""
    last = ris(graph, k, theta, 0)
    for i in range(1, doublings + 1):
        now = ris(graph, k, theta << i, i)
        if len(set(now) & set(last)) >= stable * k:
            return now
        last = now
    return last


def discounted(graph: Graph, scores: DataFrame, k: int, factor: float = 0.5) -> list[int]:
    """Best score first; each pick multiplies its out-neighbours' scores by ``factor``."""
    arcs = written(graph.edges.select("src", "dst").distinct(), "arcs")
    base = written(scores, "scores")

    def score(chosen: list[int]) -> DataFrame:
        if not chosen:
            return base
        hits = arcs.where(F.col("src").isin(chosen)).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("h"))
        return base.where(~F.col("node").isin(chosen)).join(hits, "node", "left").select("node", (F.col("score") * F.pow(F.lit(factor), F.coalesce("h", F.lit(0)))).alias("score"))

    return greedy(k, score)


def simulated_gain(graph: Graph, chosen: list[int], candidates: DataFrame, runs: int, horizon: int, seed: int = 0) -> DataFrame:
    """``node, score``: mean spread of the chosen seeds and each candidate, all in one keyed job on shared coins."""
    c = candidates.select("node")
    plans = c.select(F.col("node").alias("plan"), "node")
    if chosen:
        plans = plans.unionByName(c.select(F.col("node").alias("plan"), F.explode(F.array(*(F.lit(x).cast("long") for x in chosen))).alias("node"))).distinct()
    return dynamics.mean_spread(dynamics.ic_samples(graph, plans, runs, horizon, seed), runs, ["plan"]).select(F.col("plan").alias("node"), F.col("spread").alias("score"))


def celf(graph: Graph, k: int, runs: int = 20, horizon: int = 10, pool: DataFrame | None = None, seed: int = 0) -> list[int]:
    """Greedy on simulated gain; lazy evaluation picks the same nodes on shared coins, so all candidates are scored at once."""
    base = graph.nodes if pool is None else pool
    return greedy(k, lambda chosen: simulated_gain(graph, chosen, base.where(~F.col("node").isin(chosen)) if chosen else base, runs, horizon, seed))


def local_search(graph: Graph, start: list[int], pool: list[int], runs: int = 20, horizon: int = 10, rounds: int = 2) -> list[int]:
    """Best single swap, again and again while it helps; all swaps of a round are one job."""
    now = list(start)
    spark = graph.nodes.sparkSession
    for _ in range(rounds):
        plans = [now] + [[b if x == a else x for x in now] for a in now for b in pool if b not in now]
        rows = [(i, int(x)) for i, p in enumerate(plans) for x in p]
        got = dynamics.mean_spread(dynamics.ic_samples(graph, spark.createDataFrame(rows, "plan long, node long"), runs, horizon), runs, ["plan"])
        best = got.orderBy(F.desc("spread"), "plan").first()
        if best is None or best["plan"] == 0:
            break
        now = plans[best["plan"]]
    return now


def community_quota(labels: DataFrame, k: int) -> DataFrame:
    """``label, quota``: largest remainders by community size."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    exact = sizes.select("label", "n", (F.col("n") * k / total).alias("x")).withColumn("low", F.floor("x"))
    left = k - F.sum("low").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.col("x") - F.col("low")), "label"))
    return exact.select("label", (F.col("low") + F.when(place <= left, 1).otherwise(0)).alias("quota"))


def community_seeds(graph: Graph, k: int, scores: DataFrame | None = None) -> DataFrame:
    """Per community its quota of best-scored (by default highest-degree) nodes."""
    labels = structure.communities(graph)
    scored = labels.join(structure.degree(graph) if scores is None else scores, "node").join(community_quota(labels, k), "label")
    inside = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "node"))
    kept = scored.withColumn("r", inside).where("r <= quota")
    return kept.select("node", F.row_number().over(Window.orderBy(F.desc("score"), "node")).alias("rank"))


def bridging_degree(graph: Graph, labels: DataFrame) -> DataFrame:
    """``node, score``: degree and, again, the neighbours in other communities."""
    e = graph.edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("ld")), "dst")
    ends = e.select(F.col("src").alias("node"), (F.col("ls") != F.col("ld")).cast("int").alias("x")).unionByName(e.select(F.col("dst").alias("node"), (F.col("ls") != F.col("ld")).cast("int").alias("x")))
    return graph.nodes.join(ends.groupBy("node").agg((F.count("*") + F.sum("x")).cast("double").alias("score")), "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def kshell(graph: Graph, k: int, protected: DataFrame | None = None) -> DataFrame:
    """Core number, then degree."""
    j = structure.core_numbers(graph).join(structure.degree(graph), "node")
    j = j if protected is None else j.join(protected, "node", "left_anti")
    best = j.orderBy(F.desc("core"), F.desc("score"), "node").limit(k)
    return best.select("node", F.row_number().over(Window.orderBy(F.desc("core"), F.desc("score"), "node")).alias("rank"))


def collective_influence_scores(graph: Graph, radius: int = 2) -> DataFrame:
    """(k - 1) times the sum of (k_j - 1) over nodes exactly ``radius`` away."""
    d = written(structure.neighbour_degree(graph), "degree")
    edge = structure.distances(graph, graph.nodes, radius, both_ways=True, keyed=True).where(F.col("hop") == radius)
    ball = edge.join(d, "node").groupBy("key").agg(F.sum(F.col("score") - 1).alias("s"))
    return d.join(ball, F.col("node") == F.col("key"), "left").select("node", ((F.col("score") - 1) * F.coalesce("s", F.lit(0.0))).alias("score"))


def irie_scores(graph: Graph, chosen: list[int], alpha: float = 0.7, rounds: int = 20) -> DataFrame:
    """r = (1 - ap)(1 + alpha sum of p r over outgoing arcs), ap the chance that a chosen seed reaches it directly."""
    from ..core import iterate, product_of

    arcs = written(graph.edges.select("src", "dst", "ic_p"), "arcs")
    hit = arcs.where(F.col("src").isin(chosen)).groupBy(F.col("dst").alias("node")).agg(product_of(F.col("ic_p")).alias("ap")) if chosen else None
    base = graph.nodes.withColumn("ap", F.lit(0.0)) if hit is None else graph.nodes.join(hit, "node", "left").select("node", F.coalesce("ap", F.lit(0.0)).alias("ap"))

    def step(now: DataFrame, _: int) -> DataFrame:
        got = arcs.join(now, F.col("dst") == F.col("node")).groupBy("src").agg(F.sum(F.col("ic_p") * F.col("score")).alias("x"))
        return now.join(got, F.col("node") == F.col("src"), "left").select("node", "ap", ((1 - F.col("ap")) * (1 + F.lit(alpha) * F.coalesce("x", F.lit(0.0)))).alias("score"))

    out = iterate(base.withColumn("score", F.lit(1.0)), step, rounds, None, "ranks").select("node", "score")
    return out.where(~F.col("node").isin(chosen)) if chosen else out


# --- removals


def adaptive(graph: Graph, k: int, scores: Callable[[Graph], DataFrame], block: int = 1, protected: DataFrame | None = None) -> list[int]:
    """Remove the ``block`` best, recompute, and so on."""
    chosen: list[int] = []
    g = graph
    while len(chosen) < k:
        s = scores(g)
        s = s if protected is None else s.join(protected, "node", "left_anti")
        best = [r["node"] for r in s.orderBy(F.desc("score"), "node").limit(min(block, k - len(chosen))).collect()]
        if not best:
            break
        chosen += best
        g = graph.without(nodes_of(graph, chosen)).materialized()
    return chosen


def corehd(graph: Graph, k: int) -> list[int]:
    """Highest degree within the 2-core, until the core is empty."""
    def core_degree(g: Graph) -> DataFrame:
        c = written(structure.two_core(g), "core")
        e = undirected(g.edges).join(c.withColumnRenamed("node", "src"), "src", "left_semi").join(c.withColumnRenamed("node", "dst"), "dst", "left_semi")
        return e.groupBy(F.col("src").alias("node")).agg(F.count("*").cast("double").alias("score"))

    return adaptive(graph, k, core_degree)


def netshield(graph: Graph, k: int, protected: DataFrame | None = None, rounds: int = 60) -> list[int]:
    """Greedy on 2 lambda x_v**2 - 2 x_v sum of x_u over chosen neighbours."""
    e = written(undirected(graph.edges), "arcs")
    x = written(structure.eigenvector(graph, rounds, both_ways=True), "vector")
    lam = e.join(x.select(F.col("node").alias("src"), F.col("score").alias("a")), "src").join(x.select(F.col("node").alias("dst"), F.col("score").alias("b")), "dst").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0.0
    base = x if protected is None else x.join(protected, "node", "left_anti")

    def score(chosen: list[int]) -> DataFrame:
        if not chosen:
            return base.select("node", (2 * F.lit(lam) * F.col("score") * F.col("score")).alias("score"))
        inside = e.where(F.col("src").isin(chosen)).join(x.select(F.col("node").alias("src"), F.col("score").alias("xs")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("xs").alias("b"))
        return base.where(~F.col("node").isin(chosen)).join(inside, "node", "left").select("node", (2 * F.lit(lam) * F.col("score") * F.col("score") - 2 * F.col("score") * F.coalesce("b", F.lit(0.0))).alias("score"))

    return greedy(k, score)


def closed_walks(graph: Graph, length: int = 4) -> DataFrame:
    """``node, score``: the squares of walks of half the length from each node, scaled each sweep."""
    e = written(undirected(graph.edges), "arcs")
    now = graph.nodes.select("node", F.lit(1.0).alias("score"))
    for _ in range(length // 2):
        got = e.join(now, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum("score").alias("x"))
        new = written(graph.nodes.join(got, F.col("node") == F.col("dst"), "left").select("node", F.coalesce("x", F.lit(0.0)).alias("score")), "walks")
        top = new.agg(F.max("score")).first()[0] or 1.0
        now = new.select("node", (F.col("score") / F.lit(top)).alias("score"))
    return now.select("node", (F.col("score") * F.col("score")).alias("score"))


def acquaintances(graph: Graph, k: int, seed: int = 0, protected: DataFrame | None = None) -> DataFrame:
    """A random neighbour of a random node, distinct, in the order of the random nodes."""
    e = undirected(graph.edges)
    pick = e.groupBy("src").agg(F.min(F.struct(coin(F.col("src"), F.col("dst"), seed, "pick").alias("c"), F.col("dst").alias("node"))).alias("m")).select(F.col("m.node").alias("node"), coin(F.col("src"), 5, seed, "pick").alias("at"))
    first = pick.groupBy("node").agg((-F.min("at")).alias("score"))
    return by_score(graph, first, k, protected)


# --- blockers and doses


def exposure(graph: Graph, sources: DataFrame, hops: int = 4, decay: float = 0.5) -> DataFrame:
    """``node, score``: walks from the sources, weighted by decay for each hop."""
    arcs = written(graph.edges.select("src", "dst"), "arcs")
    now = written(sources.select("node", F.lit(1.0).alias("w")), "walks")
    out = None
    for h in range(1, hops + 1):
        now = written(now.join(arcs, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("w")), "walks")
        part = now.select("node", (F.col("w") * F.lit(decay**h)).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("node").agg(F.sum("score").alias("score")).join(sources, "node", "left_anti")


def rings(graph: Graph, sources: DataFrame, hops: int) -> DataFrame:
    """``node, hop, score``: nodes around the sources, hop by hop outward, with their degrees."""
    return structure.distances(graph, sources, hops).where("hop > 0").join(structure.degree(graph), "node")


def proximity(graph: Graph, k: int, sources: DataFrame, hops: int = 1) -> DataFrame:
    """Nearest ring first, highest degree inside it; filled up by degree."""
    r = rings(graph, sources, hops).orderBy("hop", F.desc("score"), "node").limit(k)
    near = r.select("node", F.row_number().over(Window.orderBy("hop", F.desc("score"), "node")).alias("rank"))
    return padded(graph, near, k, sources)


def multi_hop_proximity(graph: Graph, k: int, sources: DataFrame, hops: int = 4) -> DataFrame:
    s = exposure(graph, sources, hops).join(structure.out_degree(graph).withColumnRenamed("score", "out"), "node").select("node", (F.col("score") * (1 + F.col("out"))).alias("score"))
    return padded(graph, by_score(graph, s, k, sources), k, sources)


def in_region(graph: Graph, scores: DataFrame, k: int, sources: DataFrame) -> DataFrame:
    """Best-scored nodes among those the sources can reach."""
    region = structure.distances(graph, sources).select("node")
    return padded(graph, by_score(graph, scores.join(region, "node", "left_semi"), k, sources), k, sources)


def earlier_reach(graph: Graph, sources: DataFrame, threshold: float = 1 / 320) -> DataFrame:
    """``node, score``: for each candidate the nodes it reaches in strictly fewer arcs than the rumour, over likely paths."""
    rumour = structure.max_probability_paths(graph, sources, threshold).groupBy("node").agg(F.min("hops").alias("due"))
    others = graph.nodes.join(sources, "node", "left_anti")
    mine = structure.max_probability_paths(graph, others, threshold)
    return mine.join(rumour, "node").where("hops < due").groupBy(F.col("key").alias("node")).agg(F.count("*").cast("double").alias("score"))


def out_arc_scores(graph: Graph, sources: DataFrame, hops: int = 4) -> DataFrame:
    """``src, dst, score``: exposure of the tail times the arc's probability; a source is exposed by 1."""
    e = exposure(graph, sources, hops).unionByName(sources.select("node", F.lit(1.0).alias("score")))
    return graph.edges.join(e, F.col("src") == F.col("node")).select("src", "dst", (F.col("score") * F.col("ic_p")).alias("score"))


def tree_arc_scores(graph: Graph, sources: DataFrame) -> DataFrame:
    """``src, dst, score``: how many breadth-first trees (one for each source, smallest parent) use the arc."""
    d = written(structure.distances(graph, sources, keyed=True), "hops")
    a, b = d.alias("a"), d.alias("b")
    step = graph.edges.join(a, F.col("src") == F.col("a.node")).join(b, (F.col("dst") == F.col("b.node")) & (F.col("a.key") == F.col("b.key")) & (F.col("b.hop") == F.col("a.hop") + 1))
    return step.groupBy(F.col("a.key"), "dst").agg(F.min("src").alias("src")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("score"))


def arc_products(graph: Graph, scores: DataFrame) -> DataFrame:
    """``src, dst, score`` of each undirected arc (src < dst): the product of its ends' scores."""
    e = undirected(graph.edges).where("src < dst")
    j = e.join(scores.select(F.col("node").alias("src"), F.col("score").alias("a")), "src").join(scores.select(F.col("node").alias("dst"), F.col("score").alias("b")), "dst")
    return j.select("src", "dst", (F.col("a") * F.col("b")).alias("score"))


def top_arcs(scored: DataFrame, k: int) -> DataFrame:
    best = scored.orderBy(F.desc("score"), "src", "dst").limit(k)
    return best.select("src", "dst", "score", F.row_number().over(Window.orderBy(F.desc("score"), "src", "dst")).alias("rank"))


def frontier_arcs(graph: Graph, sources: DataFrame) -> DataFrame:
    """``src, dst, score``: arcs with exactly one end among the sources, by the outer end's degree."""
    s = sources.select("node", F.lit(1).alias("in"))
    j = undirected(graph.edges).join(s.select(F.col("node").alias("src"), F.col("in").alias("a")), "src", "left").join(s.select(F.col("node").alias("dst"), F.col("in").alias("b")), "dst", "left").where("a is not null and b is null")
    return j.join(structure.degree(graph), F.col("dst") == F.col("node")).select("src", "dst", "score")


def preciado(graph: Graph, rounds: int = 20) -> DataFrame:
    """``node, score``: x**2 (degree + the neighbours' allocations), scaled by the largest each sweep."""
    e = written(undirected(graph.edges), "arcs")
    x = structure.eigenvector(graph, 60, both_ways=True).select("node", (F.col("score") * F.col("score")).alias("x2"))
    base = written(x.join(structure.neighbour_degree(graph).withColumnRenamed("score", "d"), "node"), "base")
    now = base.select("node", F.lit(0.0).alias("score"))
    for _ in range(rounds):
        got = e.join(now, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum("score").alias("g"))
        new = written(base.join(got, F.col("node") == F.col("dst"), "left").select("node", (F.col("x2") * (F.col("d") + F.coalesce("g", F.lit(0.0)))).alias("score")), "doses")
        top = new.agg(F.max("score")).first()[0] or 1.0
        now = new.select("node", (F.col("score") / F.lit(top)).alias("score"))
    return now


def simulated_blocking(graph: Graph, k: int, sources: DataFrame, pool: DataFrame, runs: int = 20, horizon: int = 15) -> list[int]:
    """Greedy on the mean size of the rumour with a candidate blocked as well; all candidates are one keyed job."""
    def score(chosen: list[int]) -> DataFrame:
        c = pool.where(~F.col("node").isin(chosen)) if chosen else pool
        plans = c.select(F.col("node").alias("plan"))
        blocked = c.select(F.col("node").alias("plan"), F.explode(F.array(F.col("node"), *(F.lit(x).cast("long") for x in chosen))).alias("node"))
        seeds = plans.join(F.broadcast(sources.select("node")))
        got = dynamics.mean_spread(dynamics.ic_samples(graph, seeds, runs, horizon, blocked=blocked), runs, ["plan"])
        return got.select(F.col("plan").alias("node"), (-F.col("spread")).alias("score"))

    return greedy(k, score)


# --- rounds


def round_batches(budget: int, rounds: int | None = None, per_round: int | None = None) -> list[int]:
    """Seeds for each round: a fixed number for each, or spread evenly with the larger rounds first."""
    if per_round:
        return [min(per_round, budget - i) for i in range(0, budget, per_round)]
    n = max(1, min(rounds or 1, budget))
    return [budget // n + (1 if i < budget % n else 0) for i in range(n)]


def batch_plans(budgets: DataFrame, rounds: int) -> DataFrame:
    """``plan, round, seeds`` for ``budgets(plan, budget)``: each budget spread evenly over at most ``rounds`` rounds, larger ones first.

    A budget below the number of rounds has a round a seed; null budgets and those below 1 have none.
    """
    n = F.least(F.col("budget"), F.lit(rounds))
    each = budgets.where("budget >= 1").select("plan", "budget", n.alias("n"), F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("round"))
    return each.select("plan", F.col("round").cast("long").alias("round"), (F.floor(F.col("budget") / F.col("n")) + (F.col("round") <= F.col("budget") % F.col("n")).cast("long")).alias("seeds"))


def adaptive_round(scores: DataFrame, active: DataFrame, batch: int) -> DataFrame:
    """The best ``batch`` nodes that are not active yet."""
    return top_k(scores.join(active, "node", "left_anti"), batch).select("node", "rank")


def uncovered_round(sets: DataFrame, active: DataFrame, batch: int) -> list[int]:
    """Greedy cover over the reverse-reachable sets that hold no active node."""
    hit = sets.join(active, "node", "left_semi").select("rr_id").distinct()
    return max_coverage(sets.join(hit, "rr_id", "left_anti"), batch)
