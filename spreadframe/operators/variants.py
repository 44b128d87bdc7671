"""Further selectors, decoders and probes, composed of the operators beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import Graph, iterate, top_k, undirected
from ..functions.coins import coin
from ..shared import written
from . import dynamics, inference, kernels, selectors, structure, sweeps
from .selectors import by_score, greedy, max_coverage, nodes_of, padded, reverse_sets, simulated_gain


def _number(seed: int, *at: int) -> float:
    """A coin on the driver, for loops of a few steps."""
    import random

    return random.Random(str((seed, *at))).random()


# --- seeds


def snapshot_greedy(graph: Graph, k: int, snapshots: int = 16, horizon: int = 16) -> list[int]:
    """Greedy cover of (snapshot, reached node) pairs over fixed live-edge graphs."""
    h = dynamics.ic_samples(graph, graph.nodes.select(F.col("node").alias("plan"), "node"), snapshots, horizon)
    return max_coverage(h.select((F.col("node") * snapshots + F.col("sample")).alias("rr_id"), F.col("plan").alias("node")), k)


def community_coverage(graph: Graph, k: int, theta: int = 500) -> list[int]:
    """Reverse-set cover that takes from each community no more than its quota."""
    labels = written(structure.communities(graph), "labels")
    room = {r["label"]: int(r["quota"]) for r in selectors.community_quota(labels, k).where("quota > 0").collect()}
    left = written(reverse_sets(graph, theta).join(labels, "node"), "sets")
    chosen: list[int] = []
    while len(chosen) < k and any(room.values()):
        best = left.where(F.col("label").isin([c for c, n in room.items() if n])).groupBy("node", "label").count().orderBy(F.desc("count"), "node").first()
        if best is None:
            break
        chosen.append(best["node"])
        room[best["label"]] -= 1
        left = written(left.join(left.where(F.col("node") == best["node"]).select("rr_id"), "rr_id", "left_anti"), "sets")
    return chosen


def coverage_swaps(graph: Graph, k: int, theta: int = 500) -> list[int]:
    """Highest degrees, then each given up in turn for the node that covers more of what the others miss."""
    sets = written(reverse_sets(graph, theta), "sets")
    now = [r["node"] for r in top_k(structure.degree(graph), k).collect()]
    for i in range(k):
        others = [v for j, v in enumerate(now) if j != i]
        missed = sets.join(sets.where(F.col("node").isin(others)).select("rr_id").distinct(), "rr_id", "left_anti") if others else sets
        best = missed.where(~F.col("node").isin(others)).groupBy("node").count().orderBy(F.desc("count"), "node").first() if others else missed.groupBy("node").count().orderBy(F.desc("count"), "node").first()
        if best is not None:
            now[i] = best["node"]
    return now


def two_stage_greedy(graph: Graph, k: int, coarse: int = 5, fine: int = 40, keep: int = 10, horizon: int = 10) -> list[int]:
    """Each pick: a rough simulated gain for all nodes, a better one for the best of them."""
    def score(chosen: list[int]) -> DataFrame:
        pool = graph.nodes.where(~F.col("node").isin(chosen)) if chosen else graph.nodes
        few = top_k(simulated_gain(graph, chosen, pool, coarse, horizon), keep).select("node")
        return simulated_gain(graph, chosen, written(few, "pool"), fine, horizon)

    return greedy(k, score)


def community_greedy(graph: Graph, k: int, runs: int = 10, horizon: int = 8) -> list[int]:
    """Simulated greedy inside each community, for its quota."""
    labels = written(structure.communities(graph), "labels")
    out: list[int] = []
    for r in selectors.community_quota(labels, k).where("quota > 0").orderBy("label").collect():
        out += selectors.celf(graph, int(r["quota"]), runs, horizon, pool=labels.where(F.col("label") == r["label"]).select("node"))
    return out


def _spreads(graph: Graph, plans: list[list[int]], runs: int, horizon: int) -> list[float]:
    rows = [(i, int(v)) for i, p in enumerate(plans) for v in p]
    got = dynamics.mean_spread(dynamics.ic_samples(graph, graph.nodes.sparkSession.createDataFrame(rows, "plan long, node long"), runs, horizon), runs, ["plan"])
    by = {r["plan"]: r["spread"] for r in got.collect()}
    return [by.get(i, 0.0) for i in range(len(plans))]


def annealed_seeds(graph: Graph, k: int, steps: int = 10, batch: int = 4, cooling: float = 0.8, runs: int = 10, horizon: int = 8, seed: int = 0) -> list[int]:
    """Simulated annealing over single swaps; each step scores a few swaps in one job and accepts by temperature."""
    import math

    pool = [r["node"] for r in top_k(structure.degree(graph), 4 * k).collect()]
    now, heat = pool[:k], 1.0
    at = best_at = _spreads(graph, [now], runs, horizon)[0]
    best = list(now)
    for s in range(steps):
        moves = []
        for b in range(batch):
            out, new = int(_number(seed, s, b, 0) * k), pool[int(_number(seed, s, b, 1) * len(pool))]
            moves.append([new if i == out and new not in now else v for i, v in enumerate(now)])
        got = _spreads(graph, moves, runs, horizon)
        i = max(range(batch), key=lambda i: (got[i], -i))
        if got[i] >= at or _number(seed, s) < math.exp((got[i] - at) / max(heat, 1e-9)):
            now, at = moves[i], got[i]
        if at > best_at:
            best, best_at = list(now), at
        heat *= cooling
    return best


def bred_seeds(graph: Graph, k: int, size: int = 8, generations: int = 4, mutation: float = 0.2, runs: int = 10, horizon: int = 8, seed: int = 0) -> list[int]:
    """Genetic search: crossover, mutation and the best kept; a generation is one keyed job."""
    pool = [r["node"] for r in top_k(structure.degree(graph), 5 * k).collect()]
    pick = lambda *at: pool[int(_number(seed, *at) * len(pool))]
    people = [pool[:k]] + [list(dict.fromkeys([pick(0, i, j) for j in range(3 * k)]))[:k] for i in range(1, size)]
    for g in range(1, generations + 1):
        fit = _spreads(graph, people, runs, horizon)
        order = sorted(range(size), key=lambda i: (-fit[i], i))
        best = [people[i] for i in order[: size // 2]]
        children = []
        for i in range(size - len(best)):
            a, b = best[int(_number(seed, g, i, 0) * len(best))], best[int(_number(seed, g, i, 1) * len(best))]
            genes = list(dict.fromkeys([x for ab in zip(a, b) for x in ab]))
            child = [pick(g, i, j, 2) if _number(seed, g, i, j, 3) < mutation else v for j, v in enumerate(genes)]
            children.append(list(dict.fromkeys([*child, *pool]))[:k])
        people = best + children
    fit = _spreads(graph, people, runs, horizon)
    return people[max(range(size), key=lambda i: (fit[i], -i))]


# --- blockers and doses


def prevention_cover(graph: Graph, k: int, sources: DataFrame, theta: int = 500, seed: int = 0, hops: int = 32) -> list[int]:
    """Cover of the nodes that reach a sampled target no later than the rumour does, on the same coins."""
    roots = reverse_sets(graph, theta, seed, 0)
    sample = roots.select("rr_id", F.col("node").alias("root"))
    live = sample.select(F.col("rr_id").alias("sample")).join(F.broadcast(sources.select("node")))
    arcs = written(graph.edges.select("src", "dst", "ic_p"), "arcs")

    def spread(front: DataFrame, forward: bool) -> DataFrame:
        a, b = ("src", "dst") if forward else ("dst", "src")
        front = seen = written(front.withColumn("hop", F.lit(0)), "front")
        for h in range(1, hops + 1):
            new = front.join(arcs, F.col("node") == F.col(a)).where(coin(F.col("src"), F.col("dst"), F.col("sample") + 100003 * seed, "arc") < F.col("ic_p")).select("sample", F.col(b).alias("node")).distinct()
            front = written(new.join(seen, ["sample", "node"], "left_anti").withColumn("hop", F.lit(h)), "front")
            if front.isEmpty():
                break
            seen = written(seen.unionByName(front), "seen")
        return seen

    due = spread(live, True).join(sample, (F.col("sample") == F.col("rr_id")) & (F.col("node") == F.col("root"))).select("sample", F.col("hop").alias("due"))
    back = spread(sample.select(F.col("rr_id").alias("sample"), F.col("root").alias("node")), False)
    sets = back.join(due, "sample").where("hop <= due").join(sources, "node", "left_anti").select(F.col("sample").alias("rr_id"), "node")
    return max_coverage(sets, k)


def reverse_blocking(graph: Graph, k: int, sources: DataFrame, theta: int = 500) -> list[int]:
    """Reverse-set cover by nodes that the rumour can reach."""
    region = structure.distances(graph, sources).join(sources, "node", "left_anti").select("node")
    return max_coverage(reverse_sets(graph, theta), k, region)


def ring_cover(graph: Graph, k: int, sources: DataFrame, theta: int = 500) -> list[int]:
    """Cover of the reverse sets that hold a rumour source, by nodes one hop from one."""
    sets = reverse_sets(graph, theta)
    hit = sets.join(sources, "node", "left_semi").select("rr_id").distinct()
    return max_coverage(sets.join(hit, "rr_id", "left_semi"), k, selectors.rings(graph, sources, 1).select("node"))


def earlier_cover(graph: Graph, k: int, sources: DataFrame, threshold: float = 1 / 320) -> list[int]:
    """Greedy cover of the nodes that a candidate reaches no later than the rumour, over likely paths."""
    rumour = structure.max_probability_paths(graph, sources, threshold).groupBy("node").agg(F.min("hops").alias("due"))
    mine = structure.max_probability_paths(graph, graph.nodes.join(sources, "node", "left_anti"), threshold)
    return max_coverage(mine.join(rumour, "node").where("hops <= due").select(F.col("node").alias("rr_id"), F.col("key").alias("node")), k)


def dominating_blockers(graph: Graph, k: int, sources: DataFrame, runs: int = 20, replace: bool = False) -> list[int]:
    """Per step the ring node that dominates most over live-edge samples; with ``replace``, re-picked from the last one back."""
    live = written(dynamics.live_edges(graph, runs), "live")

    def pick(gone: list[int]) -> int | None:
        left = live.where(~F.col("src").isin(gone) & ~F.col("dst").isin(gone)) if gone else live
        ring = selectors.rings(graph, sources, 1).select("node")
        s = kernels.dominator_scores(left, sources, runs).join(ring, "node", "left_semi")
        best = (s.where(~F.col("node").isin(gone)) if gone else s).orderBy(F.desc("score"), "node").first()
        return None if best is None else best["node"]

    chosen: list[int] = []
    while len(chosen) < k and (v := pick(chosen)) is not None:
        chosen.append(v)
    if replace:
        for i in range(len(chosen) - 1, -1, -1):
            v = pick(chosen[:i] + chosen[i + 1 :])
            if v is None or v == chosen[i]:
                break
            chosen[i] = v
    return chosen


def dominator_doses(graph: Graph, k: int, sources: DataFrame, fast: bool = False) -> list[int]:
    """Children of the merged outbreak in the dominator tree of the whole graph, by what they dominate; rebuilt after each unless ``fast``."""
    live = graph.edges.select(F.lit(0).alias("sample"), "src", "dst")

    def tree(gone: list[int]) -> DataFrame:
        left = live.where(~F.col("src").isin(gone) & ~F.col("dst").isin(gone)) if gone else live
        first = sources.select(F.col("node").alias("idom"))
        near = kernels.dominated(left, sources).join(sources, "node", "left_anti")
        return near.join(first.unionByName(graph.nodes.sparkSession.createDataFrame([(-1,)], "idom long")), "idom", "left_semi").select("node", F.col("size").cast("double").alias("score"))

    if fast:
        return [r["node"] for r in top_k(tree([]), k).collect()]
    return greedy(k, tree)


def netshield_batches(graph: Graph, k: int, batch: int = 5, rounds: int = 30) -> list[int]:
    """NetShield in batches, each on the graph that the earlier ones left."""
    chosen: list[int] = []
    g = graph
    while len(chosen) < k:
        got = selectors.netshield(g, min(batch, k - len(chosen)), rounds=rounds)
        if not got:
            break
        chosen += got
        g = graph.without(nodes_of(graph, chosen)).materialized()
    return chosen


def walk_arcs(graph: Graph, k: int) -> list[tuple[int, int]]:
    """Arcs by the product of their ends' closed walks; each pick halves both ends."""
    walks = written(selectors.closed_walks(graph), "walks")
    e = written(undirected(graph.edges).where("src < dst"), "arcs")
    chosen: list[tuple[int, int]] = []
    for _ in range(k):
        w = lambda c: walks.select(F.col("node").alias(c), F.col("score").alias(f"w{c}"))
        scored = e.join(w("src"), "src").join(w("dst"), "dst").select("src", "dst", (F.col("wsrc") * F.col("wdst")).alias("score"))
        for a, b in chosen:
            scored = scored.where(~((F.col("src") == a) & (F.col("dst") == b)))
        best = scored.orderBy(F.desc("score"), "src", "dst").first()
        if best is None:
            break
        chosen.append((best["src"], best["dst"]))
        walks = written(walks.select("node", F.when(F.col("node").isin(best["src"], best["dst"]), F.col("score") / 2).otherwise(F.col("score")).alias("score")), "walks")
    return chosen


# --- localisation and reconstruction


def submatrix_scores(graph: Graph, observation: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, score``: vector of the least eigenvalue of the Laplacian's infected part, by shifted power iteration."""
    i = written(inference.infected_set(observation), "infected")
    d = structure.neighbour_degree(graph).join(i, "node", "left_semi")
    top = (d.agg(F.max("score")).first()[0] or 0.0) * 2 + 1
    g = inference.infected_graph(graph, observation)
    base = written(d.select("node", F.col("score").alias("d")), "degree")
    arcs = written(g.edges.select("src", "dst"), "arcs")

    def step(now: DataFrame, _: int) -> DataFrame:
        got = arcs.join(now, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum("score").alias("x"))
        new = written(now.join(base, "node").join(got, F.col("node") == F.col("dst"), "left").select("node", ((F.lit(top) - F.col("d")) * F.col("score") + F.coalesce("x", F.lit(0.0))).alias("score")), "raw")
        size = new.agg(F.max("score")).first()[0] or 1.0
        return new.select("node", (F.col("score") / F.lit(size)).alias("score"))

    return iterate(i.withColumn("score", F.lit(1.0)), step, rounds, None, "vector")


def submatrix_sources(graph: Graph, observation: DataFrame, k: int, rounds: int = 30) -> list[int]:
    """Repeatedly the best node of the vector on what is left of the infected set."""
    chosen: list[int] = []
    for _ in range(k):
        left = observation.where(~F.col("node").isin(chosen)) if chosen else observation
        best = submatrix_scores(graph, left, rounds).orderBy(F.desc("score"), "node").first()
        if best is None:
            break
        chosen.append(best["node"])
    return chosen


def with_neighbours(graph: Graph, reports: DataFrame) -> DataFrame:
    """``node``: reports and everything next to them."""
    near = undirected(graph.edges).join(reports.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))
    return reports.select("node").unionByName(near).distinct()


def random_times(reports: DataFrame, horizon: int, seed: int = 0) -> DataFrame:
    return reports.select("node", F.coalesce("time", F.floor(coin(F.col("node"), 13, seed, "mask") * (horizon + 1))).cast("int").alias("time"))


def consistent_times(graph: Graph, roots: DataFrame, reports: DataFrame, horizon: int, exactly: bool = True) -> DataFrame:
    """``node, time``: hop by hop from the roots; a node with a reported step is entered only then, or up to then."""
    said = reports.where("time is not null").select("node", F.col("time").alias("said"))
    arcs = written(graph.edges.select("src", "dst").distinct(), "arcs")
    seen = written(roots.select("node", F.lit(0).alias("time")), "seen")
    for t in range(1, horizon + 1):
        # a node may wait: any earlier member can reach another at a later step
        new = seen.join(arcs, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").join(said, "node", "left")
        ok = F.col("said").isNull() | ((F.col("said") == t) if exactly else (F.col("said") >= t))
        seen = written(seen.unionByName(new.where(ok).select("node", F.lit(t).alias("time"))), "seen")
    return seen


def community_centers(graph: Graph, reports: DataFrame, horizon: int) -> DataFrame:
    """``node, time``: hops inside the reports from the best-connected report of each community."""
    labels = structure.communities(graph).join(reports.select("node"), "node", "left_semi")
    d = inference.infected_scores(graph, reports.select("node", F.lit(1.0).alias("y")), "degree")
    roots = labels.join(d, "node").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "node"))).where("r = 1").select("node")
    return inference.bfs_times(Graph(graph.nodes, undirected(graph.edges)), written(roots, "roots"), reports.select("node"), horizon)


def sampled_trees(graph: Graph, reports: DataFrame, horizon: int, trees: int = 20, share: float = 0.5) -> DataFrame:
    """``node, time``: nodes on at least half of the shortest-path trees under randomly stretched costs, and their mean depth.

    All trees are relaxed together, keyed by their number.
    """
    first = reports.agg(F.min("time")).first()[0] or 0
    roots = reports.where(F.coalesce("time", F.lit(1 << 30)) <= first).select("node")
    arcs = written(graph.edges.select("src", "dst", (-F.log(F.greatest("ic_p", F.lit(1e-12)))).alias("cost")), "costs")
    start = dynamics.samples(roots, trees).select("sample", "node", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("parent"))

    def step(now: DataFrame, _: int) -> DataFrame:
        stretch = -F.log1p(-coin(F.col("src"), F.col("dst"), F.col("sample"), "weight"))
        more = now.select("sample", F.col("node").alias("src"), F.col("cost").alias("c"), (F.col("hops") + 1).alias("hops")).join(arcs, "src").select("sample", F.col("dst").alias("node"), (F.col("c") + F.col("cost") * stretch).alias("cost"), "hops", F.col("src").alias("parent"))
        best = now.unionByName(more).groupBy("sample", "node").agg(F.min(F.struct("cost", "hops", "parent")).alias("m"))
        return best.select("sample", "node", "m.cost", "m.hops", "m.parent")

    paths = iterate(start, step, horizon, None, "trees")
    ends = paths.join(reports.select("node").distinct(), "node", "left_semi").select("sample", "node")
    kept = iterate(ends, lambda now, _: now.unionByName(paths.join(now, ["sample", "node"], "left_semi").where("parent is not null").select("sample", F.col("parent").alias("node"))).distinct(), horizon, lambda a, b: a.count() == b.count(), "kept")
    on = kept.join(paths, ["sample", "node"]).groupBy("node").agg(F.count("*").alias("n"), F.avg("hops").alias("time"))
    return on.where(F.col("n") >= share * trees).select("node", F.round("time").cast("int").alias("time"))


def cheapest_attachment(graph: Graph, reports: DataFrame, alpha: float, rounds: int = 20) -> DataFrame:
    """``node, cost``: every report can start alone at cost ``alpha``, or hang from a cheaper path; others are kept up to that cost."""
    arcs = written(graph.edges.select("src", "dst", (-F.log(F.greatest("ic_p", F.lit(1e-12)))).alias("step")), "arcs")
    first = reports.agg(F.min("time")).first()[0] or 0
    start = reports.select("node", F.when(F.col("time") <= first, 0.0).otherwise(float(alpha)).alias("cost"))

    def step(now: DataFrame, _: int) -> DataFrame:
        more = now.join(arcs, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost")).where(F.col("cost") <= alpha)
        return now.unionByName(more).groupBy("node").agg(F.min("cost").alias("cost"))

    same = lambda a, b: a.agg(F.count("*"), F.sum("cost")).first() == b.agg(F.count("*"), F.sum("cost")).first()
    return iterate(start, step, rounds, same, "costs")


def voted_times(graph: Graph, roots: DataFrame, reports: DataFrame, horizon: int, particles: int = 20) -> DataFrame:
    """``node, time``: nodes that most simulated runs reach, at their median step; reported steps stand."""
    h = dynamics.ic_samples(graph, roots, particles, horizon)
    voted = h.groupBy("node").agg(F.count("*").alias("n"), F.expr("percentile(t, 0.5)").alias("t")).where(F.col("n") * 2 >= particles)
    j = voted.join(reports.select("node", F.col("time").alias("said"), F.lit(True).alias("reported")), "node", "full_outer")
    return j.select("node", F.coalesce("said", F.round("t").cast("int"), F.lit(horizon)).cast("int").alias("time"))


# --- credit and probes


def leave_one_out(graph: Graph, seeds: list[int], runs: int = 20, horizon: int = 10) -> DataFrame:
    """``node, credit, solo``: what the plan loses without a seed, and what the seed reaches alone; all plans are one job."""
    spark = graph.nodes.sparkSession
    rows = [(0, v) for v in seeds] + [(i + 1, v) for i in range(len(seeds)) for j, v in enumerate(seeds) if j != i] + [(-i - 1, v) for i, v in enumerate(seeds)]
    got = dynamics.mean_spread(dynamics.ic_samples(graph, spark.createDataFrame(rows, "plan long, node long"), runs, horizon), runs, ["plan"])
    value = {r["plan"]: r["spread"] for r in got.collect()}
    return spark.createDataFrame([(int(v), float(value[0] - value.get(i + 1, 0.0)), float(value[-i - 1])) for i, v in enumerate(seeds)], "node long, credit double, solo double")


def bottlenecks(graph: Graph, reached: DataFrame, k: int) -> DataFrame:
    """``node, score``: unreached nodes that are likeliest to follow in one step."""
    m = dynamics.ic_step_marginals(graph, reached, reached).join(reached, "node", "left_anti")
    return top_k(m.where("p > 0").select("node", F.col("p").alias("score")), k)


def structural_regions(graph: Graph, high: float = 0.75, low: float = 0.25) -> DataFrame:
    """``node, region``: bridge, core, periphery or interior, by percentiles of betweenness and degree."""
    j = structure.betweenness(graph, both_ways=True).withColumnRenamed("score", "b").join(structure.neighbour_degree(graph), "node")
    cut = j.agg(F.expr(f"percentile(b, {high})").alias("b1"), F.expr(f"percentile(score, {high})").alias("d1"), F.expr(f"percentile(score, {low})").alias("d0"))
    region = F.when((F.col("b") >= F.col("b1")) & (F.col("b") > 0) & (F.col("score") < F.col("d1")), "bridge").when(F.col("score") >= F.col("d1"), "core").when(F.col("score") <= F.col("d0"), "periphery").otherwise("interior")
    return j.join(F.broadcast(cut)).select("node", region.alias("region"))


def bridge_nodes(graph: Graph, percentile: float = 0.75) -> DataFrame:
    """``node, outside, score``: nodes with arcs into other communities and high betweenness, best first."""
    labels = structure.communities(graph)
    e = undirected(graph.edges).join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
    out = e.where("a <> b").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outside"))
    b = written(structure.betweenness(graph, both_ways=True), "scores")
    cut = b.agg(F.expr(f"percentile(score, {percentile})").alias("cut"))
    return out.join(b, "node").join(F.broadcast(cut)).where("score >= cut").select("node", "outside", "score")


def lost_nodes(candidate: DataFrame, incumbent: DataFrame, k: int) -> DataFrame:
    """``node, score``: nodes that the incumbent's samples reach and the candidate's do not, in samples where it loses."""
    size = lambda df, n: df.groupBy("sample").agg(F.count("*").alias(n))
    worse = size(candidate, "c").join(size(incumbent, "i"), "sample").where("c < i").select("sample")
    lost = incumbent.join(worse, "sample", "left_semi").join(candidate, ["sample", "node"], "left_anti")
    return top_k(lost.groupBy("node").agg(F.count("*").cast("double").alias("score")), k)


def spread_gradient(graph: Graph, seeds: DataFrame, candidates: DataFrame, horizon: int, step: float = 1e-4) -> DataFrame:
    """``node, gradient``: change of the mean-field spread with a candidate's own seed probability, all candidates at once."""
    e, of = written(graph.edges.select("src", "dst", F.col("ic_p").alias("w")), "arcs"), graph.nodes.select("node", F.lit(1.0).alias("v"))

    def spread(sources: DataFrame) -> DataFrame:
        fields = sweeps.mean_fields(e, sources, horizon, of, lambda x, v: (x.sum(0),), "v", step, seeds)
        return written(fields.groupBy("key").agg(F.sum("v").alias("v")), "values")

    # a seed is there already, so its own run is the one without further candidates
    base = spread(seeds.limit(1)).select(F.col("v").alias("base"))
    return spread(candidates).join(F.broadcast(base)).select(F.col("key").alias("node"), ((F.col("v") - F.col("base")) / step).alias("gradient"))


def padded_choice(graph: Graph, ids: list[int], k: int) -> DataFrame:
    return padded(graph, selectors.ranked(graph, ids), k) if ids else by_score(graph, structure.degree(graph), k)
