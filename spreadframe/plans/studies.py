"""Registered queries over decoders, dismantling, effects of actions, action logs, rounds and hybrid forecasts, over graphs and tables that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import Graph
from ..functions.coins import coin, coin_sql
from ..operators import cascades, decoders, dismantling, effects, inference, plan_checks, rounds, selectors, structure
from ..shared import written
from ..sources import derived
from .catalog import HOPS, RUNS, WINDOW, binned, history, longs, query, r6, seeds3, sizes, users
from .views import sql

# --- decoders of a cascade over the user graph, half of whose steps are reported


def reported(spark, sf, setting: str = "partial_times") -> tuple[Graph, DataFrame]:
    g, h = history(spark, sf)
    return g, written(inference.mask(h, setting), "reports")


@query()
def reconstruct_nearest_terminal(spark, sf):
    g, said = reported(spark, sf, "partial_nodes")
    return decoders.grown_tree(g, said, HOPS)


@query()
def reconstruct_delayed_paths(spark, sf):
    g, said = reported(spark, sf)
    return decoders.grown_tree(g, said, HOPS, nearest=False)


@query()
def mcmc_decode(spark, sf):
    g, said = reported(spark, sf)
    return decoders.mcmc_decode(g, said, HOPS, chains=16, sweeps=8)


@query()
def forward_backward(spark, sf):
    g, said = reported(spark, sf)
    return decoders.forward_backward(g, said, HOPS)


# --- dismantling


def backbone(spark, sf) -> Graph:
    """Each user's most frequent next user (ties to the smallest id): a sparse graph of all users."""
    e = derived.table(spark, sf, "events")
    order = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    hops = e.select("user_id", F.lead("user_id").over(order).alias("after")).where("after is not null and after <> user_id")
    often = hops.groupBy("user_id", "after").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max(F.struct("n", (-F.col("after")).alias("a"))).alias("m"))
    return Graph.from_edges(often.select(F.col("user_id").alias("src"), (-F.col("m.a")).alias("dst"), F.lit(1.0).alias("ic_p"))).materialized()


@query()
def decycling_removal(spark, sf):
    return longs(dismantling.decycling(backbone(spark, sf), 8), "rank")


@query()
def decycling_reinserted_removal(spark, sf):
    return longs(dismantling.decycling_reinserted(backbone(spark, sf), 6), "rank")


@query()
def tree_breaking(spark, sf):
    g = backbone(spark, sf)
    arcs = written(dismantling.undirected(g.edges), "arcs")
    hubs = dismantling.decycled(arcs, g.nodes.count())
    return dismantling.broken_trees(dismantling._without(arcs, hubs), 40)


@query()
def spectral_ensemble_removal(spark, sf):
    return longs(dismantling.spectral_ensemble(users(spark, sf), 3, members=5, rounds=16), "rank")


# --- effects of actions: a brand's sales in a year under the suppliers' nations, by return flag

_EFFECTS = ("eff", """SELECT p_brand || '#' || CAST(year(l_shipdate) AS VARCHAR) AS state, s_nationkey AS action, l_returnflag AS node, round(avg(l_tax), 9) AS predicted, round(avg(l_discount), 9) AS "true"
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""")


def effect_rows(spark, sf) -> DataFrame:
    li, p, s = (derived.table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    j = li.join(p, li["l_partkey"] == p["p_partkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    return j.groupBy(F.concat_ws("#", "p_brand", F.year("l_shipdate").cast("string")).alias("state"), F.col("s_nationkey").alias("action"), F.col("l_returnflag").alias("node")).agg(F.round(F.avg("l_tax"), 9).alias("predicted"), F.round(F.avg("l_discount"), 9).alias("true"))


@query(sql("", """SELECT (SELECT CAST(sum(n * (n - 1) / 2) AS BIGINT) FROM (SELECT count(DISTINCT action) AS n FROM eff GROUP BY state)) AS pairs, count(*) AS scored, round(corr(dp, dt), 6) AS pearson, round(avg(abs(dp - dt)), 6) AS mae,
    round(avg(abs(dp - dt)) / avg(abs(dt)), 6) AS mae_norm, round(avg(abs(dp)) / avg(abs(dt)), 6) AS magnitude_ratio,
    round(avg(CASE WHEN abs(dt) > 1.23457e-3 THEN CASE WHEN sign(dp) = sign(dt) THEN 1e0 ELSE 0e0 END END), 4) AS sign_agree
    FROM (SELECT a.predicted - b.predicted AS dp, a."true" - b."true" AS dt FROM eff a JOIN eff b ON a.state = b.state AND a.node = b.node AND a.action < b.action)""", [_EFFECTS]))
def counterfactual_effect(spark, sf):
    found = effects.counterfactual_effect(effect_rows(spark, sf), noise=1.23457e-3)  # no difference of means falls on this bound
    return r6(found, "pearson", "mae", "mae_norm", "magnitude_ratio").withColumn("sign_agree", F.round("sign_agree", 4))


_RECORDS = ("rec", f"SELECT event_id, event_type AS grp, user_id AS action, CASE WHEN value > 10 THEN 1e0 ELSE 0e0 END AS y, {coin_sql('event_id', '5', '0', 'pick')} AS d FROM events")


@query(sql("", """SELECT arm, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg((p - y) * (p - y) - (own - y) * (own - y)), 6) AS brier_rise, round(stddev_samp((p - y) * (p - y) - (own - y) * (own - y)) / sqrt(count(*)), 6) AS rise_se,
    round(2 * sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1e0 ELSE 0e0 END) / sum((CASE WHEN p >= 0.5 THEN 1e0 ELSE 0e0 END) + y), 6) AS f1,
    round(2 * sum(CASE WHEN own >= 0.5 AND y = 1 THEN 1e0 ELSE 0e0 END) / sum((CASE WHEN own >= 0.5 THEN 1e0 ELSE 0e0 END) + y) - 2 * sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1e0 ELSE 0e0 END) / sum((CASE WHEN p >= 0.5 THEN 1e0 ELSE 0e0 END) + y), 6) AS f1_drop
    FROM (SELECT 'null' AS arm, y, own, plain AS p FROM outcome UNION ALL SELECT 'shuffle', y, own, swapped FROM outcome) GROUP BY arm""", [
    _RECORDS,
    ("ring", "SELECT *, coalesce(lead(action) OVER w, first_value(action) OVER w) AS swap, count(*) OVER (PARTITION BY grp) AS m FROM rec WINDOW w AS (PARTITION BY grp ORDER BY d, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    ("means", "SELECT grp, action, round(avg(y), 9) AS p FROM rec GROUP BY 1, 2"),
    ("base", "SELECT grp, round(avg(y), 9) AS p FROM rec GROUP BY 1"),
    ("outcome", "SELECT r.y, o.p AS own, b.p AS plain, coalesce(s.p, b.p) AS swapped FROM ring r JOIN means o ON o.grp = r.grp AND o.action = r.action JOIN base b ON b.grp = r.grp LEFT JOIN means s ON s.grp = r.grp AND s.action = r.swap WHERE r.m > 1"),
]))
def action_ablation(spark, sf):
    rec = derived.table(spark, sf, "events").select("event_id", F.col("event_type").alias("grp"), F.col("user_id").alias("action"), (F.col("value") > 10).cast("double").alias("y"))
    means = rec.groupBy("grp", "action").agg(F.round(F.avg("y"), 9).alias("by_action"))
    base = rec.groupBy("grp").agg(F.round(F.avg("y"), 9).alias("plain"))

    def predict(rows: DataFrame) -> DataFrame:
        return rows.join(means, ["grp", "action"], "left").join(base, "grp").withColumn("p", F.coalesce("by_action", "plain"))

    found = effects.action_ablation(rec, predict, coin(F.col("event_id"), 5, 0, "pick"), ["event_id"], ["grp"])
    return r6(found, "brier", "brier_rise", "rise_se", "f1", "f1_drop")


# --- action logs: a day's events of one type are a plan, hours its steps

_LOG = ("log", """SELECT event_type || '#' || CAST(CAST(ts AS DATE) AS VARCHAR) AS plan, CAST(hour(ts) AS BIGINT) AS t, event_id AS seq, CASE event_id % 5 WHEN 0 THEN 'set_edge_weight' WHEN 1 THEN 'remove_edge' WHEN 2 THEN 'add_node' ELSE 'remove_node' END AS op,
    user_id AS target, lead(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS destination, value / 1000 AS weight FROM events""")
BUDGET = 20


def action_log(spark, sf) -> DataFrame:
    e = derived.table(spark, sf, "events")
    kind = F.col("event_id") % 5
    op = F.when(kind == 0, "set_edge_weight").when(kind == 1, "remove_edge").when(kind == 2, "add_node").otherwise("remove_node")
    order = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    return e.select(F.concat_ws("#", "event_type", F.to_date("ts").cast("string")).alias("plan"), F.hour("ts").cast("long").alias("t"), F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("target"), F.lead("user_id").over(order).alias("destination"), (F.col("value") / 1000).alias("weight"))


_CHECKED = ("checked", f"""SELECT *, CASE WHEN op = 'add_node' THEN 'op' WHEN known IS NULL THEN 'range' WHEN op = 'remove_node' AND guarded IS NOT NULL THEN 'protected' WHEN op = 'set_edge_weight' AND cap IS NULL THEN 'arc' WHEN op = 'set_edge_weight' AND weight > cap THEN 'weight'
    WHEN again THEN 'repeat' WHEN op = 'remove_node' AND spent > {BUDGET} THEN 'budget' END AS reason FROM (
    SELECT *, CAST(sum(CASE WHEN op = 'remove_node' AND NOT again THEN 1 ELSE 0 END) OVER (PARTITION BY plan ORDER BY t, seq) AS BIGINT) AS spent FROM (
    SELECT l.*, n.node AS known, p.node AS guarded, g.ic_p AS cap, op = 'remove_node' AND row_number() OVER (PARTITION BY plan, op, target ORDER BY t, seq) > 1 AS again
    FROM log l LEFT JOIN nu n ON n.node = target LEFT JOIN top3u p ON p.node = target LEFT JOIN gu g ON op = 'set_edge_weight' AND g.src = target AND g.dst = destination))""")


def checked(spark, sf) -> DataFrame:
    g = users(spark, sf)
    return plan_checks.checked_actions(action_log(spark, sf), g.nodes, g.edges, ["remove_node", "remove_edge", "set_edge_weight"], "remove_node", BUDGET, seeds3(g))


@query(sql("gu nu top3u", f"SELECT plan, t, seq, op, target, reason, spent, greatest(0, {BUDGET} - spent) AS \"left\" FROM checked", [_LOG, _CHECKED]))
def check_actions(spark, sf):
    return checked(spark, sf).select("plan", "t", "seq", "op", "target", "reason", "spent", "left")


@query(sql("gu nu top3u", "SELECT plan, count(reason) = 0 AS valid, min(CASE WHEN k = 1 THEN t END) AS t, min(CASE WHEN k = 1 THEN seq END) AS seq, min(CASE WHEN k = 1 THEN reason END) AS reason, max(spent) AS spent FROM (SELECT *, CASE WHEN reason IS NOT NULL THEN row_number() OVER (PARTITION BY plan, reason IS NULL ORDER BY t, seq) END AS k FROM checked) GROUP BY plan", [_LOG, _CHECKED]))
def validate_plan(spark, sf):
    return plan_checks.plan_verdicts(checked(spark, sf))


def _expanded_sql(isolate: bool) -> str:
    plain = "SELECT plan, t, seq, 0 AS sub, op, target, CASE WHEN op IN ('remove_edge', 'set_edge_weight') THEN destination END AS destination FROM log" + (" WHERE op <> 'remove_node'" if isolate else "")
    return sql("uu", f"""SELECT plan, t, seq, sub, op, target, destination FROM (SELECT *, row_number() OVER (PARTITION BY plan, t, op, target, destination ORDER BY seq, sub) AS k FROM ({plain}
        UNION ALL SELECT plan, t, seq, 2 * dst + 1, 'remove_edge', src, dst FROM log JOIN uu ON src = target WHERE op = 'remove_node' UNION ALL SELECT plan, t, seq, 2 * dst + 2, 'remove_edge', dst, src FROM log JOIN uu ON src = target WHERE op = 'remove_node')) WHERE k = 1""", [_LOG])


@query(_expanded_sql(False))
def expand_removals(spark, sf):
    return plan_checks.expanded_actions(action_log(spark, sf), derived.user_arcs(spark, sf))


@query(_expanded_sql(True))
def expand_quarantine(spark, sf):
    return plan_checks.expanded_actions(action_log(spark, sf), derived.user_arcs(spark, sf), isolate=True)


_FILL = [
    _LOG,
    ("own", "SELECT plan, target AS node, min(seq) AS r FROM log WHERE op = 'remove_node' AND target NOT IN (SELECT node FROM top3u) GROUP BY 1, 2"),
    ("kept", f"SELECT * FROM (SELECT plan, node, row_number() OVER (PARTITION BY plan ORDER BY r, node) AS turn FROM own) WHERE turn <= {BUDGET}"),
    ("deg", "SELECT node, count(*) AS n FROM (SELECT src AS node FROM user_arcs UNION ALL SELECT dst FROM user_arcs) WHERE node NOT IN (SELECT node FROM top3u) GROUP BY 1"),
]


@query(sql("user_arcs top3u", f"""SELECT plan, node, turn FROM kept UNION ALL SELECT plan, node, turn FROM (SELECT p.plan, d.node, coalesce(h.n, 0) + row_number() OVER (PARTITION BY p.plan ORDER BY d.n DESC, d.node) AS turn
    FROM (SELECT DISTINCT plan FROM log WHERE op = 'remove_node') p LEFT JOIN (SELECT plan, count(*) AS n FROM kept GROUP BY 1) h ON h.plan = p.plan CROSS JOIN deg d LEFT JOIN kept k ON k.plan = p.plan AND k.node = d.node WHERE k.node IS NULL) WHERE turn <= {BUDGET}""", _FILL))
def removal_plans(spark, sf):
    g = users(spark, sf)
    picks = action_log(spark, sf).where("op = 'remove_node'").select("plan", F.col("seq").alias("rank"), F.col("target").alias("node"))
    return longs(plan_checks.filled_plans(picks, structure.degree(g), BUDGET, seeds3(g)), "turn")


@query(sql("", "SELECT plan, node, row_number() OVER (PARTITION BY plan ORDER BY t, seq) AS turn FROM (SELECT plan, target AS node, t, seq, row_number() OVER (PARTITION BY plan, target ORDER BY t, seq) AS k FROM log WHERE op = 'remove_node') WHERE k = 1", [_LOG]))
def removal_set(spark, sf):
    return longs(plan_checks.targets_in_order(action_log(spark, sf)), "turn")


# --- regions of ten users each, weak on a day on which under 45 % of them are seen

_COVER = ("cover", """SELECT region, turn, round(coalesce(n, 0) / 10e0, 6) AS coverage, coalesce(n, 0) / 10e0 < 0.45 AS weak FROM (SELECT DISTINCT user_id // 10 AS region FROM events) r CROSS JOIN (SELECT DISTINCT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS turn FROM events) t
    LEFT JOIN (SELECT user_id // 10 AS region, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS turn, count(DISTINCT user_id) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) USING (region, turn)""")


def coverage(spark, sf) -> DataFrame:
    e = derived.table(spark, sf, "events").select(F.floor(F.col("user_id") / 10).alias("region"), F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("turn"), "user_id", "event_type")
    seen = e.where("event_type = 'purchase'").groupBy("region", "turn").agg((F.count_distinct("user_id") / F.lit(10.0)).alias("share"))
    every = e.select("region").distinct().crossJoin(F.broadcast(e.select("turn").distinct()))
    c = every.join(seen, ["region", "turn"], "left").withColumn("coverage", F.round(F.coalesce("share", F.lit(0.0)), 6))
    return c.select("region", "turn", "coverage", (F.coalesce("share", F.lit(0.0)) < 0.45).alias("weak"))


@query(sql("", "SELECT region, min(turn) AS first, max(turn) AS last, count(*) AS turns, max(coverage) AS max_coverage FROM (SELECT *, turn - row_number() OVER (PARTITION BY region ORDER BY turn) AS island FROM cover WHERE weak) GROUP BY region, island", [_COVER]))
def weak_runs(spark, sf):
    return plan_checks.weak_runs(coverage(spark, sf))


@query(sql("", "SELECT region, count(*) AS turns, max(coverage) AS max_coverage FROM cover WHERE weak AND turn > (SELECT max(turn) FROM cover) - 3 GROUP BY region HAVING count(*) = 3", [_COVER]))
def persistent_weakness(spark, sf):
    return plan_checks.persistent_weakness(coverage(spark, sf), 3)


# --- seeding in rounds: two, two and one seeds at times 0, 1 and 2, in each of eight realisations

BATCHES = selectors.round_batches(5, 3)


def _rounds_sql(score: str) -> list[tuple[str, str]]:
    """Histories ``h`` of a policy that takes the nodes of largest ``score`` (SQL over ``d``, the degrees, and ``w.s``, the realisation) among the unreached."""
    def picks(p: str | None, i: int) -> str:
        seen = f"WHERE NOT EXISTS (SELECT 1 FROM {p} z WHERE z.sample = w.s AND z.node = d.node)" if p else ""
        return f"SELECT sample, node, {i} AS t, true AS seeded FROM (SELECT CAST(w.s AS BIGINT) AS sample, d.node, row_number() OVER (PARTITION BY w.s ORDER BY {score.format(t=i)} DESC, d.node) AS k FROM deg d CROSS JOIN range({RUNS}) w(s) {seen}) WHERE k <= {BATCHES[i]}"

    out = [
        ("deg", "SELECT node, count(*) AS n FROM (SELECT src AS node FROM gu UNION ALL SELECT dst FROM gu) GROUP BY 1"),
        ("live", f"SELECT w.s AS sample, src, dst FROM gu CROSS JOIN range({RUNS}) w(s) WHERE {coin_sql('src', 'dst', 'w.s', 'arc')} < ic_p"),
        ("h0", picks(None, 0)),
    ]
    for i in range(1, HOPS + 1):
        out.append((f"s{i}", f"SELECT * FROM h{i - 1} UNION ALL SELECT DISTINCT a.sample, l.dst, {i}, false FROM h{i - 1} a JOIN live l ON l.sample = a.sample AND l.src = a.node WHERE a.t = {i - 1} AND NOT EXISTS (SELECT 1 FROM h{i - 1} z WHERE z.sample = a.sample AND z.node = l.dst)"))
        out.append((f"h{i}", f"SELECT * FROM s{i}" + (f" UNION ALL {picks(f's{i}', i)}" if i < len(BATCHES) else "")))
    return out


_HISTORY = f"SELECT sample, node, CAST(t AS BIGINT) AS t, seeded FROM h{HOPS}"


def in_rounds(g: Graph, policy: rounds.Policy) -> DataFrame:
    return longs(rounds.rollout(g, policy, BATCHES, 1, HOPS, RUNS), "sample", "t")


@query(sql("gu", _HISTORY, _rounds_sql("d.n")))
def adapt_degree(spark, sf):
    g = users(spark, sf)
    return in_rounds(g, rounds.by_ranking(structure.degree(g)))


@query(sql("gu", _HISTORY, _rounds_sql("-" + coin_sql("d.node", "w.s", "{t}", "pick"))))
def adapt_random(spark, sf):
    g = users(spark, sf)
    return in_rounds(g, rounds.at_random(g))


@query()
def adapt_pagerank(spark, sf):
    g = users(spark, sf)
    return in_rounds(g, rounds.by_ranking(structure.pagerank(g, rounds=10, tolerance=None)))


@query()
def adapt_degree_discount(spark, sf):
    g = users(spark, sf)
    return in_rounds(g, rounds.by_discounted_degree(g))


@query()
def adapt_greedy(spark, sf):
    g = users(spark, sf)
    return in_rounds(g, rounds.by_marginal_gain(g, 20, 4, HOPS))


@query()
def adapt_epic(spark, sf):
    g = users(spark, sf)
    return in_rounds(g, rounds.by_uncovered_sets(g, 2000))


# a static plan, users by out-degree, dealt out in the same rounds
@query(sql("gu", _HISTORY, [("outs", "SELECT src, count(*) AS n FROM gu GROUP BY 1"), *_rounds_sql("coalesce((SELECT n FROM outs WHERE outs.src = d.node), 0)")]))
def static_split(spark, sf):
    g = users(spark, sf)
    return in_rounds(g, rounds.by_ranking(g.nodes.join(structure.out_degree(g), "node", "left").select("node", F.coalesce("score", F.lit(0)).alias("score"))))


@query(sql("gu", f"SELECT r.i + 1 AS round, r.i + 1 AS t, (SELECT count(*) FROM h{HOPS} WHERE t <= r.i + 1) / {RUNS}e0 AS spread FROM range({len(BATCHES)}) r(i)", _rounds_sql("d.n")))
def round_spreads(spark, sf):
    return longs(rounds.round_spreads(adapt_degree(spark, sf), len(BATCHES), 1, HOPS, RUNS), "t")


@query(sql("gu", f"SELECT r.i AS time, 'full' AS feedback, sample, node FROM h{HOPS} JOIN range({len(BATCHES)}) r(i) ON t <= r.i UNION ALL SELECT t, 'myopic', sample, node FROM h{HOPS} WHERE t < {len(BATCHES)}", _rounds_sql("d.n")))
def observed_states(spark, sf):
    h = adapt_degree(spark, sf)
    views = [rounds.observed_state(h, t, f).select(F.lit(t).cast("long").alias("time"), F.lit(f).alias("feedback"), "sample", "node") for t in rounds.round_schedule(BATCHES, 1, HOPS) for f in ("full", "myopic")]
    out = views[0]
    for v in views[1:]:
        out = out.unionByName(v)
    return out


# --- a generative forecast, corrected by a layer fitted on the other folds


@query()
def forecast_hawkes_hybrid(spark, sf):
    b = binned(spark, sf)
    found = cascades.hawkes_hybrid(cascades.features(users(spark, sf), b, WINDOW), written(cascades.observed_waves(b, WINDOW), "waves"), sizes(b))
    return r6(found, "predicted")
