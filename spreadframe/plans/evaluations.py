"""Registered queries over regrets on several graphs, evaluators, and sources and sinks, each read back after writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import Graph, top_k
from ..functions.coins import coin_sql
from ..operators import dynamics, evaluators, regrets
from ..shared import new_path, written
from ..sources import derived, files
from .catalog import HOPS, binned, longs, query, r6, seeds3, sizes, users
from .views import product_sql, sql, unrolled

# --- regret of one-step choices on a graph for each type of event

STATES, DRAWN, RING, TRIES = 3, 10, 5, 4

_GRAPHS = [
    ("ga_arcs", "SELECT DISTINCT g AS graph_id, u AS src, v AS dst FROM (SELECT event_type AS g, user_id AS v, lag(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS u FROM events) WHERE u IS NOT NULL AND u <> v"),
    ("ga", "SELECT *, 1e0 / count(*) OVER (PARTITION BY graph_id, dst) AS ic_p FROM ga_arcs"),
    ("na", "SELECT graph_id, src AS node FROM ga_arcs UNION SELECT graph_id, dst FROM ga_arcs"),
    ("model", "SELECT graph_id, src, dst, round(avg(ic_p) OVER (PARTITION BY graph_id, src), 9) AS ic_p FROM ga"),
    ("degs", "SELECT graph_id, node, count(*) AS degree FROM (SELECT graph_id, src AS node FROM ga UNION ALL SELECT graph_id, dst FROM ga) GROUP BY 1, 2"),
]


def _drawn_sql(share: float) -> list[tuple[str, str]]:
    return [
        ("every", f"SELECT graph_id, state, node, {coin_sql('node', '0', 'state', 'pick')} AS c, {coin_sql('node', '0', 'state', 'tie')} AS tie FROM na, range({STATES}) s(state)"),
        ("act", f"SELECT graph_id, state, node FROM (SELECT *, min(c) OVER (PARTITION BY graph_id, state) AS least FROM every) WHERE c < {share} OR c = least"),
        ("drawn", f"SELECT graph_id, state, node FROM every e WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.graph_id = e.graph_id AND a.state = e.state AND a.node = e.node) QUALIFY row_number() OVER (PARTITION BY graph_id, state ORDER BY tie, node) <= {DRAWN}"),
        ("hit", f"SELECT a.graph_id, a.state, m.dst AS node, {product_sql('m.ic_p')} AS hit FROM act a JOIN model m ON m.graph_id = a.graph_id AND m.src = a.node WHERE NOT EXISTS (SELECT 1 FROM act x WHERE x.graph_id = a.graph_id AND x.state = a.state AND x.node = m.dst) GROUP BY 1, 2, 3"),
    ]


def _regret_sql(choosers: dict[str, str], judged: str) -> list[tuple[str, str]]:
    arms = " UNION ALL ".join(f"SELECT *, '{name}' AS chooser, row_number() OVER (PARTITION BY graph_id, state ORDER BY {order}, node) AS place FROM judged" for name, order in choosers.items())
    return [("judged", judged), ("regrets", f"SELECT graph_id, state, chooser, best, truth AS chosen, best - truth AS regret FROM (SELECT *, max(truth) OVER (PARTITION BY graph_id, state, chooser) AS best FROM ({arms})) WHERE place = 1")]


_MULTI = "SELECT chooser, count(*) AS graphs, round(avg(regret), 6) AS mean, round(stddev_pop(regret), 6) AS std FROM (SELECT graph_id, chooser, avg(regret) AS regret FROM regrets GROUP BY 1, 2) GROUP BY 1"
_RANDOM = coin_sql("node", "0", "state", "mask") + " DESC"
_LIVE = f"SELECT s.graph_id, s.state, s.node, r.sample, e.dst FROM {{0}} s JOIN ga e ON e.graph_id = s.graph_id AND e.src = s.node JOIN range({TRIES}) r(sample) ON {coin_sql('e.src', 'e.dst', 'r.sample', 'arc')} < e.ic_p"
_PLANNING = [
    *_GRAPHS, *_drawn_sql(0.05),
    ("had", f"SELECT graph_id, state, sample, dst FROM ({_LIVE.format('act')}) UNION SELECT graph_id, state, sample, node FROM act, range({TRIES}) r(sample)"),
    ("added", f"SELECT graph_id, state, node, sample, dst FROM ({_LIVE.format('drawn')}) UNION SELECT graph_id, state, node, sample, node FROM drawn, range({TRIES}) r(sample)"),
    *_regret_sql({"model": "predicted DESC", "degree": "degree DESC", "random": _RANDOM}, f"""SELECT d.graph_id, d.state, d.node, g.degree,
        (SELECT count(*) FROM added a WHERE a.graph_id = d.graph_id AND a.state = d.state AND a.node = d.node AND NOT EXISTS (SELECT 1 FROM had h WHERE h.graph_id = a.graph_id AND h.state = a.state AND h.sample = a.sample AND h.dst = a.dst)) / {TRIES}e0 AS truth,
        round(1 - coalesce((SELECT hit FROM hit h WHERE h.graph_id = d.graph_id AND h.state = d.state AND h.node = d.node), 0) + coalesce((SELECT sum((1 - coalesce(h.hit, 0)) * m.ic_p) FROM model m LEFT JOIN hit h ON h.graph_id = m.graph_id AND h.state = d.state AND h.node = m.dst
            WHERE m.graph_id = d.graph_id AND m.src = d.node AND NOT EXISTS (SELECT 1 FROM act x WHERE x.graph_id = d.graph_id AND x.state = d.state AND x.node = m.dst)), 0), 9) AS predicted
        FROM drawn d JOIN degs g ON g.graph_id = d.graph_id AND g.node = d.node"""),
]


def _typed(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graphs by type of event, their nodes, and a coarse model: the mean probability of a tail's arcs."""
    edges = written(derived.typed_edges(spark, sf), "edges")
    nodes = written(edges.select("graph_id", F.col("src").alias("node")).union(edges.select("graph_id", "dst")).distinct(), "nodes")
    tails = edges.groupBy("graph_id", "src").agg(F.round(F.avg("ic_p"), 9).alias("ic_p"))
    return edges, nodes, edges.drop("ic_p").join(tails, ["graph_id", "src"])


def _planned(spark, sf) -> DataFrame:
    return regrets.planning_regrets(*_typed(spark, sf), states=STATES, share=0.05, most=DRAWN, runs=TRIES)


@query(sql("", "SELECT graph_id, state, chooser, round(best, 6) AS best, round(chosen, 6) AS chosen, round(regret, 6) AS regret FROM regrets", _PLANNING))
def planning_regret_states(spark, sf):
    return longs(r6(_planned(spark, sf), "best", "chosen", "regret"), "state")


@query(sql("", _MULTI, _PLANNING))
def planning_regret_multi(spark, sf):
    return r6(regrets.over_graphs(_planned(spark, sf)), "mean", "std")


def _prevention_sql(spreads: bool) -> list[tuple[str, str]]:
    draw = f"CASE WHEN a.side = 1 THEN {coin_sql('a.node', 'e.dst', 'a.sample', regrets.SIDES[1])} ELSE {coin_sql('a.node', 'e.dst', 'a.sample', regrets.SIDES[0])} END"
    only = "" if spreads else " AND a.side = 0"
    near = f" + coalesce((SELECT sum(h.hit * m.ic_p) FROM model m JOIN hit h ON h.graph_id = m.graph_id AND h.state = d.state AND h.node = m.dst WHERE m.graph_id = d.graph_id AND m.src = d.node), 0)" if spreads else ""
    return [
        *_GRAPHS, *_drawn_sql(0.01),
        ("around", f"SELECT graph_id, state, node FROM (SELECT DISTINCT a.graph_id, a.state, e.dst AS node FROM act a JOIN ga e ON e.graph_id = a.graph_id AND e.src = a.node) n WHERE NOT EXISTS (SELECT 1 FROM act x WHERE x.graph_id = n.graph_id AND x.state = n.state AND x.node = n.node) QUALIFY row_number() OVER (PARTITION BY graph_id, state ORDER BY node) <= {RING}"),
        ("cand", "SELECT * FROM drawn UNION SELECT * FROM around"),
        ("plans", "SELECT graph_id, state, node AS plan FROM cand UNION SELECT graph_id, state, -1 FROM act"),
        *unrolled("w", f"SELECT graph_id, state, plan, sample, node, max(side) AS side, 0 AS t FROM (SELECT p.graph_id, p.state, p.plan, a.node, 0 AS side FROM plans p JOIN act a ON a.graph_id = p.graph_id AND a.state = p.state UNION ALL SELECT graph_id, state, plan, plan, 1 FROM plans WHERE plan >= 0), range({TRIES}) r(sample) GROUP BY ALL",
                  lambda p, i: f"""SELECT * FROM {p} UNION ALL SELECT n.* FROM (SELECT a.graph_id, a.state, a.plan, a.sample, e.dst AS node, max(a.side) AS side, {i} AS t FROM {p} a JOIN ga e ON e.graph_id = a.graph_id AND e.src = a.node WHERE a.t = {i - 1}{only} AND {draw} < e.ic_p GROUP BY 1, 2, 3, 4, 5) n
                      LEFT JOIN {p} s ON s.graph_id = n.graph_id AND s.state = n.state AND s.plan = n.plan AND s.sample = n.sample AND s.node = n.node WHERE s.node IS NULL""", HOPS),
        ("reach", f"SELECT graph_id, state, plan, count(*) / {TRIES}e0 AS reach FROM w{HOPS} WHERE side = 0 GROUP BY 1, 2, 3"),
        ("known", f"SELECT c.graph_id, c.state, e.dst AS node, max({coin_sql('c.node', 'e.dst', 'c.state', 'tie')}) AS known FROM cand c JOIN ga e ON e.graph_id = c.graph_id AND e.src = c.node GROUP BY 1, 2, 3"),
        *_regret_sql({"model": "predicted DESC", "degree": "degree DESC", "random": _RANDOM, "proximity": "in_ring DESC, degree DESC", "acquaintance": "known DESC NULLS LAST, degree DESC"}, f"""SELECT d.graph_id, d.state, d.node, g.degree, f.reach - r.reach AS truth, k.known,
            CASE WHEN EXISTS (SELECT 1 FROM around x WHERE x.graph_id = d.graph_id AND x.state = d.state AND x.node = d.node) THEN 1 ELSE 0 END AS in_ring,
            round(coalesce((SELECT hit FROM hit h WHERE h.graph_id = d.graph_id AND h.state = d.state AND h.node = d.node), 0){near}, 9) AS predicted
            FROM cand d JOIN degs g ON g.graph_id = d.graph_id AND g.node = d.node JOIN reach r ON r.graph_id = d.graph_id AND r.state = d.state AND r.plan = d.node JOIN reach f ON f.graph_id = d.graph_id AND f.state = d.state AND f.plan = -1
            LEFT JOIN known k ON k.graph_id = d.graph_id AND k.state = d.state AND k.node = d.node"""),
    ]


def _prevented(spark, sf, spreads: bool) -> DataFrame:
    found = regrets.prevention_regrets(*_typed(spark, sf), states=STATES, share=0.01, most=DRAWN, near=RING, runs=TRIES, horizon=HOPS, spreads=spreads)
    return r6(regrets.over_graphs(found), "mean", "std")


@query(sql("", _MULTI, _prevention_sql(True)))
def blocking_regret_multi(spark, sf):
    return _prevented(spark, sf, True)


# an infectious node tries its arcs for one step, a dose takes its node out
@query(sql("", _MULTI, _prevention_sql(False)))
def immunization_regret_multi(spark, sf):
    return _prevented(spark, sf, False)


# --- localisers over several cascades at once: the three infected users of highest degree among the infected

CASCADES, NAMED = 4, 3


def _bfs_sql(name: str, starts: str, seed: int) -> list[tuple[str, str]]:
    """``instance, sample, node`` reached within HOPS from ``starts(instance, sample, node)``; coins of ``sample + CASCADES * seed``."""
    return unrolled(name, f"SELECT instance, sample, node, 0 AS t FROM ({starts})", lambda p, i: f"""SELECT * FROM {p} UNION ALL SELECT n.* FROM (SELECT DISTINCT a.instance, a.sample, g.dst AS node, {i} AS t FROM {p} a JOIN gu g ON g.src = a.node WHERE a.t = {i - 1} AND {coin_sql('g.src', 'g.dst', f'a.sample + {CASCADES * seed}', 'arc')} < g.ic_p) n
        LEFT JOIN {p} s ON s.instance = n.instance AND s.sample = n.sample AND s.node = n.node WHERE s.node IS NULL""", HOPS)


_SEEN = [
    *_bfs_sql("o", f"SELECT sample AS instance, sample, node FROM top3u, range({CASCADES}) r(sample)", 0),
    ("seen", f"SELECT instance, node FROM o{HOPS}"),
    ("named", f"SELECT instance, node, row_number() OVER (PARTITION BY instance ORDER BY n DESC, node) AS rank FROM (SELECT s.instance, s.node, (SELECT count(*) FROM gu JOIN seen x ON x.instance = s.instance AND x.node = gu.dst WHERE gu.src = s.node) + (SELECT count(*) FROM gu JOIN seen x ON x.instance = s.instance AND x.node = gu.src WHERE gu.dst = s.node) AS n FROM seen s) QUALIFY rank <= {NAMED}"),
]


def _localised(spark, sf) -> tuple[Graph, DataFrame, DataFrame]:
    """The user graph, cascades of the busiest users seen at their end, and the sources named for each."""
    g = users(spark, sf)
    seen = written(dynamics.ic_samples(g, seeds3(g), CASCADES, HOPS).select(F.col("sample").cast("long").alias("instance"), "node"), "seen")
    ends = g.edges.join(seen.withColumnRenamed("node", "src"), "src").join(seen.withColumnRenamed("node", "dst"), ["instance", "dst"])
    n = ends.select("instance", F.explode(F.array("src", "dst")).alias("node")).groupBy("instance", "node").agg(F.count("*").alias("score"))
    scored = seen.join(n, ["instance", "node"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    return g, seen, written(top_k(scored, NAMED, by=["instance"]).select("instance", "node", "rank"), "named")


@query(sql("gu nu top3u", f"""SELECT i.instance, round(-avg(pow(coalesce(p, 0) - y, 2)), 6) AS consistency, round(avg(pow(coalesce(p, 0) - y, 2)), 6) AS resim_error, CAST({NAMED} AS BIGINT) AS n_named, count(*) FILTER (coalesce(p, 0) - y >= 0.25) AS n_over, count(*) FILTER (coalesce(p, 0) - y <= -0.25) AS n_under
    FROM (SELECT instance, nu.node, CASE WHEN EXISTS (SELECT 1 FROM seen s WHERE s.instance = c.instance AND s.node = nu.node) THEN 1e0 ELSE 0e0 END AS y FROM nu, (SELECT DISTINCT instance FROM seen) c) i
    LEFT JOIN (SELECT instance, node, count(*) / {CASCADES}e0 AS p FROM v{HOPS} GROUP BY 1, 2) m ON m.instance = i.instance AND m.node = i.node GROUP BY 1""", [*_SEEN, *_bfs_sql("v", f"SELECT instance, sample, node FROM named, range({CASCADES}) r(sample)", 1)]))
def evaluate_localizer(spark, sf):
    g, seen, named = _localised(spark, sf)
    observation = g.nodes.withColumn("instance", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CASCADES - 1).cast("long")))).join(seen.withColumn("y", F.lit(1.0)), ["instance", "node"], "left").select("instance", "node", F.coalesce("y", F.lit(0.0)).alias("y"))
    again = dynamics.ic_samples(g, named.select("instance", "node"), CASCADES, HOPS, seed=1)
    found = evaluators.consistency(named, observation, dynamics.marginals(again, CASCADES, ["instance"]))
    return r6(found, "consistency", "resim_error")


_LABELS = ("labelled", f"""SELECT i.instance, nu.node, t.node IS NOT NULL AS y, n.rank, CASE WHEN n.rank IS NULL THEN 0e0 ELSE 1e0 / n.rank END AS s FROM nu CROSS JOIN range({CASCADES}) i(instance) LEFT JOIN top3u t ON t.node = nu.node LEFT JOIN named n ON n.instance = i.instance AND n.node = nu.node""")


@query(sql("gu nu top3u", """SELECT count(*) AS instances, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(accuracy), 6) AS accuracy, round(avg(auc), 6) AS auc FROM (
    SELECT a.*, b.auc FROM (SELECT instance, count(*) FILTER (y AND rank IS NOT NULL) / CAST(count(rank) AS DOUBLE) AS precision, count(*) FILTER (y AND rank IS NOT NULL) / CAST(count(*) FILTER (y) AS DOUBLE) AS recall, 2e0 * count(*) FILTER (y AND rank IS NOT NULL) / (count(rank) + count(*) FILTER (y)) AS f1, avg(CASE WHEN y = (rank IS NOT NULL) THEN 1e0 ELSE 0e0 END) AS accuracy FROM labelled GROUP BY 1) a
    JOIN (SELECT p.instance, avg(CASE WHEN p.s > n.s THEN 1e0 WHEN p.s = n.s THEN 0.5 ELSE 0e0 END) AS auc FROM labelled p JOIN labelled n ON n.instance = p.instance AND p.y AND NOT n.y GROUP BY 1) b USING (instance))""", [*_SEEN, _LABELS]))
def aggregate_localization(spark, sf):
    g, _, named = _localised(spark, sf)
    truth = seeds3(g).withColumn("instance", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CASCADES - 1).cast("long"))))
    totals = truth.select("instance").distinct().withColumn("n_nodes", F.lit(g.nodes.count()))
    values = ["precision", "recall", "f1", "accuracy", "auc"]
    return r6(evaluators.means(evaluators.localization_labels(named, truth, totals), values), *values)


# a customer's orders name clerks' numbers as sources; the customer's nation is the budget
@query(sql("nu", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN nu.node IS NULL THEN 'range' WHEN row_number() OVER (PARTITION BY instance, o.node ORDER BY rank) > 1 THEN 'duplicate' WHEN row_number() OVER (PARTITION BY instance ORDER BY rank, o.node) > budget THEN 'budget' END AS reason
    FROM (SELECT o_custkey AS instance, o_orderkey AS rank, o_orderkey % 170 AS node FROM orders) o JOIN (SELECT c_custkey, c_nationkey AS budget FROM customer) c ON c_custkey = instance LEFT JOIN nu ON nu.node = o.node) GROUP BY 1"""))
def validate_sources(spark, sf):
    o = derived.table(spark, sf, "orders").select(F.col("o_custkey").alias("instance"), F.col("o_orderkey").alias("rank"), (F.col("o_orderkey") % 170).alias("node"))
    budgets = derived.table(spark, sf, "customer").select(F.col("c_custkey").alias("instance"), F.col("c_nationkey").alias("budget"))
    return evaluators.source_refusals(o, users(spark, sf).nodes, budgets).groupBy("reason").agg(F.count("*").alias("n"))


# --- decoded histories: the steps of logged cascades, some of them spoilt

_DECODED = ("dec", """SELECT b.cascade_id AS instance, b.node, CASE b.node % 7 WHEN 0 THEN NULL ELSE b.t // 4 END AS time, CASE WHEN b.node % 5 = 0 THEN NULL WHEN b.node % 11 = 0 THEN 100000 ELSE a.parent END AS parent FROM bins b JOIN ad a ON a.cascade_id = b.cascade_id AND a.adopter = b.node""")
_LOGGED = ("logged", "SELECT b.cascade_id AS instance, b.node, b.t // 4 AS time, a.parent FROM bins b JOIN ad a ON a.cascade_id = b.cascade_id AND a.adopter = b.node")


def _histories(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Logged cascades in steps of two hours as decoded with faults, and as they were: ``instance, node, time, parent``."""
    parents = derived.adoptions(spark, sf).select("cascade_id", F.col("adopter").alias("node"), "parent")
    logged = written(binned(spark, sf).join(parents, ["cascade_id", "node"]).select(F.col("cascade_id").alias("instance"), "node", F.floor(F.col("t") / 4).alias("time"), "parent"), "logged")
    node = F.col("node")
    return logged.withColumns({"time": F.when(node % 7 != 0, F.col("time")), "parent": F.when(node % 5 != 0, F.when(node % 11 == 0, F.lit(100000)).otherwise(F.col("parent")))}), logged


@query(sql("nu gu bins ad", """SELECT instance, reason, count(*) AS n FROM (SELECT instance, CASE WHEN n.node IS NULL THEN 'range' WHEN (d.node + length(instance)) % 13 = 0 THEN 'hidden' WHEN time IS NULL OR time > 6 THEN 'horizon' WHEN parent IS NULL AND time > 0 THEN 'orphan' WHEN parent IS NOT NULL AND time = 0 THEN 'early'
    WHEN parent IS NOT NULL AND p.node IS NULL THEN 'parent' WHEN parent IS NOT NULL AND gu.src IS NULL THEN 'arc' WHEN (parent + length(instance)) % 13 = 0 THEN 'hidden_parent' END AS reason
    FROM dec d LEFT JOIN nu n ON n.node = d.node LEFT JOIN nu p ON p.node = parent LEFT JOIN gu ON gu.src = parent AND gu.dst = d.node) GROUP BY 1, 2""", [_DECODED]))
def validate_reconstruction(spark, sf):
    g, (decoded, _) = users(spark, sf), _histories(spark, sf)
    hidden = decoded.select("instance", F.explode(F.array("node", "parent")).alias("node")).where("(node + length(instance)) % 13 = 0")
    found = evaluators.decoded_refusals(decoded, g.nodes, g.edges, 6, hidden)
    return found.groupBy("instance", "reason").agg(F.count("*").alias("n"))


@query(sql("bins ad", """SELECT instance, round(event_f1, 6) AS event_f1, round(path_precision, 6) AS path_precision, round(path_recall, 6) AS path_recall, round(order_accuracy, 6) AS order_accuracy, round(coalesce(0.6 * path_precision + 0.4 * event_f1, event_f1), 6) AS reward FROM (
    SELECT instance, 2e0 * count(*) FILTER (d.time = l.time) / (count(d.time) + count(l.time)) AS event_f1, CASE WHEN count(l.parent) > 0 THEN coalesce(count(*) FILTER (d.parent = l.parent) / CAST(nullif(count(d.parent), 0) AS DOUBLE), 0) END AS path_precision,
    count(*) FILTER (d.parent = l.parent) / CAST(nullif(count(l.parent), 0) AS DOUBLE) AS path_recall, coalesce(count(*) FILTER (b.time <= d.time) / CAST(nullif(count(d.parent), 0) AS DOUBLE), 0) AS order_accuracy
    FROM dec d JOIN logged l USING (instance, node) LEFT JOIN (SELECT instance, node, time FROM dec) b ON b.instance = d.instance AND b.node = d.parent GROUP BY 1)""", [_DECODED, _LOGGED]))
def reconstruction_reward(spark, sf):
    found = evaluators.reconstruction_rewards(*_histories(spark, sf))
    return r6(found, "event_f1", "path_precision", "path_recall", "order_accuracy", "reward")


# --- forecasts: twice what was seen, declined for some cascades

_FORECASTS = ("fc", "SELECT split_part(cascade_id, '#', 1) AS kind, CASE WHEN final % 7 <> 0 THEN 2e0 * observed END AS p, CAST(final AS DOUBLE) AS a, CAST(observed AS DOUBLE) AS o FROM sizes")
_ERRORS = {
    "msle": "pow(log2(greatest(p, 1)) - log2(greatest(a, 1)), 2)", "male": "abs(log2(greatest(p, 1)) - log2(greatest(a, 1)))", "msle_offset": "pow(log2(p + 1) - log2(a + 1), 2)", "msle_natural": "pow(ln(greatest(p, 1)) - ln(greatest(a, 1)), 2)",
    "msle_increment": "pow(log2(greatest(p - o, 0) + 1) - log2(greatest(a - o, 0) + 1), 2)", "male_increment": "abs(log2(greatest(p - o, 0) + 1) - log2(greatest(a - o, 0) + 1))",
    "mape": "abs(log2(p + 1) - log2(a + 1)) / log2(a + 2)", "mrse": "pow((p - a) / greatest(a, 1), 2)", "wroperc": "CASE WHEN abs(p - a) / greatest(a, 1) >= 0.5 THEN 1e0 ELSE 0e0 END",
}


@query(sql("sizes", "SELECT kind, metric, round(avg(e), 6) AS reward, round(coalesce(stddev_samp(e) / sqrt(count(e)), 0), 6) AS se, count(e) AS n_scored, count(*) - count(e) AS n_failed FROM errs GROUP BY 1, 2", [_FORECASTS, ("errs", " UNION ALL ".join(f"SELECT kind, '{m}' AS metric, CASE WHEN p IS NOT NULL THEN {e} END AS e FROM fc" for m, e in _ERRORS.items()))]))
def evaluate_predictor(spark, sf):
    seen = sizes(binned(spark, sf))
    forecasts = seen.select(F.substring_index("cascade_id", "#", 1).alias("kind"), F.when(F.col("final") % 7 != 0, 2.0 * F.col("observed")).alias("predicted"), F.col("final").alias("actual"), "observed")
    return r6(evaluators.forecast_rewards(forecasts, by=["kind"]), "reward", "se")


# --- sources and sinks: what is written is read back

@query(sql("gcs", "SELECT src, dst FROM gcs"))
def edge_list_read_back(spark, sf):
    path = new_path(spark, "arcs")
    files.write_edge_list(derived.customer_supplier_graph(spark, sf), path)
    return files.read_pairs(spark, path)


@query(sql("ad", "SELECT cascade_id, CAST(first_value(adopter) OVER (PARTITION BY cascade_id ORDER BY seq) AS VARCHAR) AS root, publish_time, CAST(adopter AS VARCHAR) AS adopter, elapsed, CAST(parent AS VARCHAR) AS parent, seq FROM ad"))
def cascade_lines_read_back(spark, sf):
    path = new_path(spark, "cascades")
    files.write_cascades(derived.adoptions(spark, sf), path)
    return files.read_cascades(spark, path)


@query(sql("gu", "SELECT src, dst, round(ic_p, 6) AS ic_p FROM gu"))
def graph_store_read_back(spark, sf):
    path = new_path(spark, "graphs")
    for name, g in (("users", derived.user_graph(spark, sf)), ("trade", derived.customer_supplier_graph(spark, sf))):
        files.save_graph(g, name, path)
    return r6(files.load_graph(spark, path, "users").edges, "ic_p")


@query(sql("gu top3u", f"SELECT 'users|ic|degree|r' || sample AS episode_id, node, CAST(t AS BIGINT) AS time FROM o{HOPS} WHERE sample % 2 = 0", _bfs_sql("o", f"SELECT sample AS instance, sample, node FROM top3u, range({CASCADES}) r(sample)", 0)))
def transitions_read_back(spark, sf):
    g, path = users(spark, sf), new_path(spark, "transitions")
    records = files.transition_records(written(dynamics.ic_samples(g, seeds3(g), CASCADES, HOPS), "episodes"), "users", "ic", "degree")
    even = F.regexp_extract("episode_id", "([0-9]+)$", 1).cast("int") % 2 == 0
    files.write_transitions(records.withColumn("split", F.when(even, "train").otherwise("test")), path)
    return longs(files.episode_histories(files.read_transitions(spark, path, "ic", "train")), "time")
