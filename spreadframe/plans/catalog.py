"""Registered queries over the supplied tables and, where SQL can express them, SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import Graph, top_k, undirected
from ..functions.coins import coin, coin_sql
from ..operators import build, cascades, dynamics, inference, kernels, metrics, ranking, reports, selectors, structure, variants
from ..operators.components import connected_components
from ..shared import written
from ..sources import derived
from .views import product_sql, sql, unrolled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "forecast_log_log_regression"
RUNS, HOPS = 8, 4
WINDOW, HORIZON = 12, 48


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def users(spark: SparkSession, sf: str) -> Graph:
    return derived.user_graph(spark, sf).materialized()


def customers(spark: SparkSession, sf: str) -> Graph:
    """Customers and suppliers without probabilities, for measures that only count arcs; the join of their orders is done once."""
    return Graph.from_edges(written(derived.customer_supplier_arcs(spark, sf), "arcs"))


def nations(spark: SparkSession, sf: str) -> Graph:
    """A small graph, for searches that are sequential within a graph or not yet measured on a larger one."""
    return derived.nation_graph(spark, sf).materialized()


#: Selectors and localisers that run over the user graph; the others run over the nations.
OVER_USERS = set(
    "ris_seeds imm_seeds celf_seeds skim_seeds irie_seeds corehd_removal "
    "lpsi_sources cover_sources effective_distance_scores dmp_scores resimulation_scores rumor_centrality_scores infected_betweenness_scores dynamic_age_scores netsleuth_sources center_times".split()
)


def seeds3(g: Graph, skip: int = 0) -> DataFrame:
    d = structure.degree(g).orderBy(F.desc("score"), "node")
    return d.limit(3).select("node") if not skip else d.limit(6).exceptAll(d.limit(3)).select("node")


# --- construction


@query(sql("user_arcs uu", "SELECT src, dst FROM uu"))
def edges_to_adjacency(spark, sf):
    return build.clean_edges(derived.user_arcs(spark, sf), directed=False)


@query(sql("gcs", "SELECT src, dst, round(ic_p, 6) AS ic_p FROM gcs"))
def build_edge_index(spark, sf):
    return r6(derived.customer_supplier_graph(spark, sf).edges, "ic_p")


@query(sql("cs_arcs", f"SELECT src, dst, round(0.02e0 + 0.38e0 * {coin_sql('src', 'dst', '0', 'weight')}, 6) AS ic_p FROM cs_arcs"))
def random_probabilities(spark, sf):
    return r6(build.with_probability(derived.customer_supplier_arcs(spark, sf), "random"), "ic_p")


@query(sql("cs_arcs ncs", "SELECT node, round(ln(1 + count(*)), 6) AS score FROM (SELECT src AS node FROM cs_arcs UNION ALL SELECT dst FROM cs_arcs) GROUP BY 1"))
def degree_features(spark, sf):
    return r6(structure.log_degree(derived.customer_supplier_graph(spark, sf)), "score")


@query(sql("cs_arcs ncs", "SELECT a.i AS src, b.i AS dst FROM cs_arcs JOIN (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM ncs) a ON a.node = src JOIN (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i FROM ncs) b ON b.node = dst"))
def remap_to_contiguous(spark, sf):
    return build.dense_ids(derived.customer_supplier_arcs(spark, sf))[0]


_CC = unrolled("c", "SELECT node, node AS label FROM nu", lambda p, i: f"SELECT a.node, least(a.label, coalesce(min(b.label), a.label)) AS label FROM {p} a LEFT JOIN uu ON src = a.node LEFT JOIN {p} b ON b.node = dst GROUP BY a.node, a.label", 12)


@query(sql("nu uu", "SELECT node, label AS component FROM c12 WHERE node IN (SELECT src FROM uu)", _CC))
def weak_components(spark, sf):
    return connected_components(users(spark, sf).edges)


@query(sql("nu uu", "SELECT src, dst FROM user_arcs WHERE src IN (SELECT node FROM c12 WHERE label = (SELECT label FROM c12 GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1))", _CC))
def largest_component(spark, sf):
    return build.largest_component(users(spark, sf)).edges.select("src", "dst")


@query(sql("gu", "SELECT (SELECT count(*) FROM (SELECT src FROM gu UNION SELECT dst FROM gu)) AS nodes, (SELECT count(*) FROM gu) AS arcs, (SELECT round(avg(ic_p), 6) FROM gu) AS mean_p"))
def graph_profile_counts(spark, sf):
    return r6(structure.profile(users(spark, sf)).select("nodes", "arcs", "mean_p"), "mean_p")


@query()
def graph_profile(spark, sf):
    return structure.profile(users(spark, sf))


@query()
def synthetic_graphs(spark, sf):
    made = {"er": build.sample_arcs(spark, 80, 0.06), "sbm": build.block_model(spark, 80, 4, 0.2, 0.02), "kronecker": build.kronecker_arcs(spark, 64), **{f: build.grown_graph(spark, f, 80) for f in ("ba", "ws", "plc")}}
    out = None
    for name, arcs in made.items():
        part = arcs.agg(F.count("*").alias("arcs"), F.count_distinct("src").alias("nodes")).withColumn("family", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# --- structure


@query(sql("cs_arcs", "SELECT node, CAST(count(*) AS DOUBLE) AS score FROM (SELECT src AS node FROM cs_arcs UNION ALL SELECT dst FROM cs_arcs) GROUP BY 1"))
def compute_degree(spark, sf):
    return structure.degree(customers(spark, sf))


@query(sql("gcs ncs", "SELECT node, round(coalesce(sum(ic_p), 0), 6) AS score FROM ncs LEFT JOIN gcs ON src = node GROUP BY 1"))
def compute_weighted_degree(spark, sf):
    return r6(structure.weighted_degree(derived.customer_supplier_graph(spark, sf)), "score")


@query(sql("cs_arcs", "SELECT node, row_number() OVER (ORDER BY n DESC, node) AS rank FROM (SELECT node, count(*) AS n FROM (SELECT src AS node FROM cs_arcs UNION ALL SELECT dst FROM cs_arcs) GROUP BY 1) ORDER BY n DESC, node LIMIT 10"))
def high_degree(spark, sf):
    g = customers(spark, sf)
    return longs(selectors.by_score(g, structure.degree(g), 10), "rank")


@query(sql("gcs", "SELECT node, row_number() OVER (ORDER BY s DESC, node) AS rank FROM (SELECT src AS node, round(sum(ic_p), 9) AS s FROM gcs GROUP BY 1) ORDER BY s DESC, node LIMIT 10"))
def weighted_degree_seeds(spark, sf):
    g = derived.customer_supplier_graph(spark, sf)
    return longs(selectors.by_score(g, structure.weighted_degree(g).withColumn("score", F.round("score", 9)), 10), "rank")


_PR = [("shares", "SELECT src, dst, 1e0 / count(*) OVER (PARTITION BY src) AS share FROM gu"), *unrolled("p", "SELECT node, 1e0 / (SELECT count(*) FROM nu) AS score FROM nu", lambda p, i: f"SELECT n.node, 0.15e0 / (SELECT count(*) FROM nu) + 0.85e0 * (coalesce(x.got, 0) + coalesce((SELECT sum(score) FROM {p} WHERE node NOT IN (SELECT src FROM gu)), 0) / (SELECT count(*) FROM nu)) AS score FROM nu n LEFT JOIN (SELECT dst, sum(score * share) AS got FROM shares JOIN {p} ON src = node GROUP BY dst) x ON x.dst = n.node", 10)]


@query(sql("gu nu", "SELECT node, round(score, 6) AS score FROM p10", _PR))
def compute_pagerank(spark, sf):
    return r6(structure.pagerank(users(spark, sf), rounds=10, tolerance=None), "score")


@query(sql("gu nu", "SELECT node, row_number() OVER (ORDER BY round(score, 9) DESC, node) AS rank FROM p10 ORDER BY round(score, 9) DESC, node LIMIT 5", _PR))
def pagerank_seeds(spark, sf):
    g = users(spark, sf)
    return longs(selectors.by_score(g, structure.pagerank(g, rounds=10, tolerance=None).withColumn("score", F.round("score", 9)), 5), "rank")


_EV = unrolled("e", "SELECT node, 1e0 / sqrt((SELECT count(*) FROM nu)) AS score FROM nu", lambda p, i: f"SELECT node, raw / greatest(sqrt(sum(raw * raw) OVER ()), 1e-12) AS score FROM (SELECT n.node, coalesce(x.got, 0) AS raw FROM nu n LEFT JOIN (SELECT dst, sum(score) AS got FROM gu JOIN {p} ON src = node GROUP BY dst) x ON x.dst = n.node)", 8)


@query(sql("gu nu", "SELECT node, round(score, 6) AS score FROM e8", _EV))
def compute_eigenvector(spark, sf):
    return r6(structure.eigenvector(users(spark, sf), rounds=8), "score")


@query(sql("gu nu uu", "SELECT a.node, count(*) FILTER (b.s IS NOT NULL) AS triangles FROM nu a LEFT JOIN (SELECT x.src AS s FROM uu x JOIN uu y ON x.dst = y.src AND x.src < x.dst OR x.dst = y.src AND x.src > x.dst JOIN uu z ON z.src = y.dst AND z.dst = x.src) b ON b.s = a.node GROUP BY 1".replace("count(*) FILTER (b.s IS NOT NULL)", "count(b.s) // 2")))
def node_triangles(spark, sf):
    return structure.triangles(users(spark, sf)).select("node", F.col("triangles").cast("long").alias("triangles"))


@query(sql("gu nu", "SELECT node, round(coalesce(sum(p), 0), 6) AS score FROM nu LEFT JOIN (SELECT s, t, max(p) AS p FROM (SELECT src AS s, dst AS t, ic_p AS p FROM gu UNION ALL SELECT a.src, b.dst, a.ic_p * b.ic_p FROM gu a JOIN gu b ON a.dst = b.src WHERE a.src <> b.dst UNION ALL SELECT a.src, c.dst, a.ic_p * b.ic_p * c.ic_p FROM gu a JOIN gu b ON a.dst = b.src AND a.src <> b.dst JOIN gu c ON b.dst = c.src WHERE a.src <> c.dst) GROUP BY 1, 2) ON s = node GROUP BY 1"))
def path_influence_scores(spark, sf):
    return r6(structure.path_influence(users(spark, sf), 3), "score")


_BFS = unrolled("b", "SELECT node AS key, node, 0 AS hop FROM nu", lambda p, i: f"SELECT * FROM {p} UNION ALL SELECT DISTINCT a.key, dst, {i} FROM {p} a JOIN gu ON src = a.node WHERE a.hop = {i - 1} AND NOT EXISTS (SELECT 1 FROM {p} z WHERE z.key = a.key AND z.node = dst)", 12)


@query(sql("gu nu", "SELECT key, node, CAST(hop AS BIGINT) AS hop FROM b12", _BFS))
def all_pairs_hops(spark, sf):
    g = users(spark, sf)
    return longs(structure.distances(g, g.nodes, keyed=True), "hop")


@query(sql("gu nu", "SELECT n.node, round(coalesce(r / t * r / ((SELECT count(*) FROM nu) - 1e0), 0), 6) AS score FROM nu n LEFT JOIN (SELECT key, CAST(count(*) AS DOUBLE) AS r, CAST(sum(hop) AS DOUBLE) AS t FROM b12 WHERE hop > 0 GROUP BY 1) x ON key = node", _BFS))
def closeness_scores(spark, sf):
    return r6(structure.closeness(users(spark, sf)), "score")


_SIGMA = unrolled("g", "SELECT node AS s, node, 0 AS hop, 1e0 AS paths FROM nu", lambda p, i: f"SELECT * FROM {p} UNION ALL SELECT a.s, dst, {i}, sum(a.paths) FROM {p} a JOIN gu ON src = a.node WHERE a.hop = {i - 1} AND NOT EXISTS (SELECT 1 FROM {p} z WHERE z.s = a.s AND z.node = dst) GROUP BY 1, 2", 12)


@query(sql("gu nu", "SELECT n.node, round(coalesce(sum(x.dep), 0), 6) AS score FROM nu n LEFT JOIN (SELECT v.node, sv.paths * vt.paths / st.paths AS dep FROM nu v JOIN g12 sv ON sv.node = v.node AND sv.s <> v.node JOIN g12 vt ON vt.s = v.node AND vt.node <> v.node JOIN g12 st ON st.s = sv.s AND st.node = vt.node AND st.hop = sv.hop + vt.hop) x ON x.node = n.node GROUP BY 1", _SIGMA))
def betweenness_scores(spark, sf):
    return r6(structure.betweenness(users(spark, sf)), "score")


_CORE = unrolled("k", "SELECT node, count(dst) AS core FROM nu LEFT JOIN uu ON src = node GROUP BY 1", lambda p, i: f"SELECT a.node, least(a.core, coalesce(h.h, 0)) AS core FROM {p} a LEFT JOIN (SELECT src, max(least(core, above)) AS h FROM (SELECT src, core, row_number() OVER (PARTITION BY src ORDER BY core DESC) AS above FROM uu JOIN {p} b ON b.node = dst) GROUP BY 1) h ON h.src = a.node", 12)


@query(sql("nu uu", "SELECT node, core FROM k12", _CORE))
def core_numbers(spark, sf):
    return longs(structure.core_numbers(users(spark, sf)), "core")


_LAB = unrolled("l", "SELECT node, node AS label FROM nu", lambda p, i: f"SELECT a.node, coalesce(v.label, a.label) AS label FROM {p} a LEFT JOIN (SELECT src, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS r FROM uu JOIN {p} b ON b.node = dst GROUP BY src, label) WHERE r = 1) v ON v.src = a.node", 3)


@query(sql("nu uu", "SELECT node, label FROM l3", _LAB))
def detect_communities(spark, sf):
    return structure.communities(users(spark, sf), rounds=3)


@query(sql("nu uu", "SELECT node, row_number() OVER (ORDER BY core DESC, d DESC, node) AS rank FROM (SELECT k.node, core, d FROM k12 k JOIN (SELECT node, count(x) AS d FROM nu LEFT JOIN (SELECT src AS x FROM user_arcs UNION ALL SELECT dst FROM user_arcs) ON x = node GROUP BY 1) d ON d.node = k.node) ORDER BY core DESC, d DESC, node LIMIT 5", _CORE))
def kshell_seeds(spark, sf):
    return longs(selectors.kshell(users(spark, sf), 5), "rank")


# --- dynamics

_LIVE = ("live", f"SELECT s.sample, src, dst FROM gu, range({RUNS}) s(sample) WHERE {coin_sql('src', 'dst', 's.sample', 'arc')} < ic_p")
_REACH = [_LIVE, *unrolled("r", f"SELECT s.sample, node, 0 AS t FROM top3u, range({RUNS}) s(sample)", lambda p, i: f"SELECT * FROM {p} UNION ALL SELECT DISTINCT a.sample, dst, {i} FROM {p} a JOIN live l ON l.sample = a.sample AND l.src = a.node WHERE a.t = {i - 1} AND NOT EXISTS (SELECT 1 FROM {p} z WHERE z.sample = a.sample AND z.node = dst)", HOPS)]
_STEP = _REACH[-1][0]


def ic_history(spark, sf) -> DataFrame:
    g = users(spark, sf)
    return dynamics.ic_samples(g, seeds3(g), RUNS, HOPS)


@query(sql("gu", "SELECT sample, count(*) AS arcs FROM live GROUP BY 1", [_LIVE]))
def live_edge_samples(spark, sf):
    return dynamics.live_edges(users(spark, sf), RUNS).groupBy(F.col("sample").cast("long").alias("sample")).agg(F.count("*").alias("arcs"))


@query(sql("gu top3u", f"SELECT sample, node, CAST(t AS BIGINT) AS t FROM {_STEP}", _REACH))
def independent_cascade_history(spark, sf):
    return longs(ic_history(spark, sf).select("sample", "node", "t"), "sample", "t")


@query(sql("gu top3u", f"SELECT round(avg(n), 6) AS spread, round(stddev_samp(n) / sqrt({RUNS}), 6) AS se FROM (SELECT sample, count(*) AS n FROM {_STEP} GROUP BY 1)", _REACH))
def mc_simulate_spread(spark, sf):
    return r6(dynamics.mean_spread(ic_history(spark, sf), RUNS), "spread", "se")


@query(sql("gu top3u", f"SELECT node, round(count(*) / {RUNS}e0, 6) AS p FROM {_STEP} GROUP BY 1", _REACH))
def predict_marginals_mc(spark, sf):
    return r6(dynamics.marginals(ic_history(spark, sf), RUNS), "p")


@query(sql("gu top3u", f"SELECT s.t, round(coalesce(count(h.node), 0) / {RUNS}e0, 6) AS mean FROM range({HOPS + 1}) s(t) LEFT JOIN {_STEP} h ON h.t <= s.t GROUP BY 1", _REACH))
def spread_curve(spark, sf):
    return longs(r6(dynamics.curve(ic_history(spark, sf), RUNS, HOPS), "mean"), "t")


@query(sql("gu nu top3u", f"SELECT n.node, round(CASE WHEN n.node IN (SELECT node FROM top3u) THEN 1e0 ELSE coalesce(x.p, 0) END, 6) AS p FROM nu n LEFT JOIN (SELECT dst, {product_sql('ic_p')} AS p FROM gu WHERE src IN (SELECT node FROM top3u) GROUP BY 1) x ON x.dst = n.node"))
def ic_step_marginals(spark, sf):
    g = users(spark, sf)
    s = written(seeds3(g))
    return r6(dynamics.ic_step_marginals(g, s, s), "p")


_LT = [("share", "SELECT src, dst, 1e0 / count(*) OVER (PARTITION BY dst) AS w FROM gu"), *unrolled("t", f"SELECT s.sample, node, 0 AS t FROM top3u, range({RUNS}) s(sample)", lambda p, i: f"SELECT * FROM {p} UNION ALL SELECT sample, dst, {i} FROM (SELECT a.sample, dst, sum(w) AS f FROM {p} a JOIN share ON src = a.node GROUP BY 1, 2) x WHERE f + 1e-12 >= {coin_sql('dst', '0', 'sample', 'threshold')} AND NOT EXISTS (SELECT 1 FROM {p} z WHERE z.sample = x.sample AND z.node = dst)", 3)]


@query(sql("gu top3u", "SELECT sample, node, CAST(t AS BIGINT) AS t FROM t3", _LT))
def linear_threshold_history(spark, sf):
    g = users(spark, sf)
    return longs(dynamics.lt_samples(g, seeds3(g), RUNS, 3), "sample", "t")


@query(sql("gu nu top3u next3u", "SELECT n.node, round(CASE WHEN n.node IN (SELECT node FROM top3u UNION SELECT node FROM next3u) THEN 1e0 ELSE coalesce(greatest(0, f1 - f0) / greatest(1e-9, 1 - f0), 0) END, 6) AS p FROM nu n LEFT JOIN (SELECT dst, sum(CASE WHEN src IN (SELECT node FROM top3u) THEN 1e0 ELSE 0 END) / count(*) AS f0, sum(CASE WHEN src IN (SELECT node FROM top3u UNION SELECT node FROM next3u) THEN 1e0 ELSE 0 END) / count(*) AS f1 FROM gu GROUP BY 1) x ON x.dst = n.node"))
def lt_hazard_marginals(spark, sf):
    g = users(spark, sf)
    a, b = written(seeds3(g)), written(seeds3(g, 3))
    return r6(dynamics.lt_hazard(g, a, a.unionByName(b)), "p")


def _competitive(kind: str) -> list[tuple[str, str]]:
    first = f"SELECT s.sample, node, 0 AS t, side FROM (SELECT node, 'negative' AS side FROM top3u UNION ALL SELECT node, 'positive' FROM next3u), range({RUNS}) s(sample)"
    if kind == "ic":
        hit = lambda p, i: f"SELECT a.sample, dst, max(CASE WHEN side = 'negative' THEN 1 ELSE 0 END) AS n, max(CASE WHEN side = 'positive' THEN 1 ELSE 0 END) AS p FROM {p} a JOIN gu ON src = a.node WHERE a.t = {i - 1} AND {coin_sql('src', 'dst', 'a.sample * 2 + CASE WHEN side = ' + chr(39) + 'positive' + chr(39) + ' THEN 1 ELSE 0 END', 'arc')} < ic_p GROUP BY 1, 2"
        both = "positive"
    else:
        over = lambda f, s: f"CASE WHEN coalesce({f}, 0) > 0 AND {f} + 1e-12 >= {coin_sql('dst', '0', 'sample', s)} THEN 1 ELSE 0 END"
        hit = lambda p, i: f"SELECT sample, dst, {over('fn', 'threshold')} AS n, {over('fp', 'threshold2')} AS p FROM (SELECT a.sample, dst, sum(CASE WHEN side = 'negative' THEN ic_p END) AS fn, sum(CASE WHEN side = 'positive' THEN ic_p END) AS fp FROM {p} a JOIN gu ON src = a.node GROUP BY 1, 2)"
        both = "negative"
    return unrolled("v", first, lambda p, i: f"SELECT * FROM {p} UNION ALL SELECT sample, dst, {i}, CASE WHEN n + p = 2 THEN '{both}' WHEN p = 1 THEN 'positive' ELSE 'negative' END FROM ({hit(p, i)}) x WHERE n + p > 0 AND NOT EXISTS (SELECT 1 FROM {p} z WHERE z.sample = x.sample AND z.node = dst)", 3)


@query(sql("gu top3u next3u", "SELECT sample, node, CAST(t AS BIGINT) AS t, side FROM v3", _competitive("ic")))
def competitive_independent_cascade(spark, sf):
    g = users(spark, sf)
    return longs(dynamics.competitive_samples(g, seeds3(g), seeds3(g, 3), RUNS, 3, "ic"), "sample", "t")


@query(sql("gu top3u next3u", "SELECT sample, node, CAST(t AS BIGINT) AS t, side FROM v3", _competitive("lt")))
def competitive_linear_threshold(spark, sf):
    g = users(spark, sf)
    return longs(dynamics.competitive_samples(g, seeds3(g), seeds3(g, 3), RUNS, 3, "lt"), "sample", "t")


@query(sql("gu nu top3u next3u", f"SELECT n.node, round(coalesce(a.p, 0) * (1 - coalesce(b.p, 0)), 6) AS p_negative, round(coalesce(b.p, 0), 6) AS p_positive FROM nu n LEFT JOIN (SELECT dst, {product_sql('ic_p')} AS p FROM gu WHERE src IN (SELECT node FROM top3u) GROUP BY 1) a ON a.dst = n.node LEFT JOIN (SELECT dst, {product_sql('ic_p')} AS p FROM gu WHERE src IN (SELECT node FROM next3u) GROUP BY 1) b ON b.dst = n.node WHERE n.node NOT IN (SELECT node FROM top3u UNION SELECT node FROM next3u)"))
def competitive_step_marginals(spark, sf):
    g = users(spark, sf)
    a, b = written(seeds3(g)), written(seeds3(g, 3))
    return r6(dynamics.competitive_ic_marginals(g, a, b, a.unionByName(b)), "p_negative", "p_positive")


def _epidemic(model: str, steps: int) -> list[tuple[str, str]]:
    caught = "E" if model == "seir" else "I"
    left = "S" if model == "sis" else "R"

    def step(p: str, i: int) -> str:
        at = f"(sample + 1000003 * {i})"
        hit = f"SELECT DISTINCT a.sample, dst AS node FROM {p} a JOIN gu ON src = a.node WHERE a.state = 'I' AND {coin_sql('src', 'dst', f'(a.sample + 1000003 * {i})', 'arc')} < ic_p"
        new = f"SELECT sample, node FROM ({hit}) h WHERE NOT EXISTS (SELECT 1 FROM {p} z WHERE z.sample = h.sample AND z.node = h.node AND z.state <> 'S')"
        moved = f"SELECT sample, node, CASE WHEN state = 'I' AND {coin_sql('node', '1', at, 'recover')} < 0.3 THEN '{left}' WHEN state = 'E' AND {coin_sql('node', '2', at, 'recover')} < 0.5 THEN 'I' ELSE state END AS state FROM {p}"
        return f"SELECT coalesce(m.sample, c.sample) AS sample, coalesce(m.node, c.node) AS node, CASE WHEN c.node IS NOT NULL THEN '{caught}' ELSE m.state END AS state FROM ({moved}) m FULL JOIN ({new}) c ON c.sample = m.sample AND c.node = m.node"

    return unrolled("x", f"SELECT s.sample, node, 'I' AS state FROM top3u, range({RUNS}) s(sample)", step, steps)


def _states(model: str) -> str:
    return sql("gu top3u", " UNION ALL ".join(f"SELECT sample, node, {i}::BIGINT AS t, state FROM x{i}" for i in range(4)), _epidemic(model, 3))


def _epidemic_query(spark, sf, model):
    g = users(spark, sf)
    return longs(dynamics.epidemic_samples(g, seeds3(g), RUNS, 3, model), "sample", "t")


@query(_states("sir"))
def epidemic_sir(spark, sf):
    return _epidemic_query(spark, sf, "sir")


@query(_states("sis"))
def epidemic_sis(spark, sf):
    return _epidemic_query(spark, sf, "sis")


@query(_states("seir"))
def epidemic_seir(spark, sf):
    return _epidemic_query(spark, sf, "seir")


@query(sql("gu top3u", " UNION ALL ".join(f"SELECT {i}::BIGINT AS t, round(sum(CASE WHEN state = 'I' THEN 1 ELSE 0 END) / {RUNS}e0, 6) AS infectious, round(count(*) / {RUNS}e0, 6) AS ever FROM x{i}" for i in range(4)), _epidemic("sir", 3)))
def epidemic_prevalence(spark, sf):
    g = users(spark, sf)
    return longs(r6(dynamics.prevalence(dynamics.epidemic_samples(g, seeds3(g), RUNS, 3), RUNS), "infectious", "ever"), "t")


@query(sql("gu nu top3u next3u", f"SELECT n.node, round(CASE WHEN i.node IS NOT NULL OR r.node IS NOT NULL THEN 0 ELSE 1 - coalesce(x.p, 0) END, 6) AS p_s, round(CASE WHEN i.node IS NULL AND r.node IS NULL THEN coalesce(x.p, 0) ELSE 0 END, 6) AS p_e, round(CASE WHEN i.node IS NOT NULL THEN 0.7e0 ELSE 0 END, 6) AS p_i, round(CASE WHEN r.node IS NOT NULL THEN 1e0 WHEN i.node IS NOT NULL THEN 0.3e0 ELSE 0 END, 6) AS p_r FROM nu n LEFT JOIN top3u i ON i.node = n.node LEFT JOIN next3u r ON r.node = n.node LEFT JOIN (SELECT dst, {product_sql('ic_p')} AS p FROM gu WHERE src IN (SELECT node FROM top3u) GROUP BY 1) x ON x.dst = n.node"))
def compartment_step_marginals(spark, sf):
    g = users(spark, sf)
    state = written(seeds3(g)).withColumn("state", F.lit("I")).unionByName(written(seeds3(g, 3)).withColumn("state", F.lit("R")))
    return r6(dynamics.epidemic_step_marginals(g, state, model="seir"), "p_s", "p_e", "p_i", "p_r")




@query(sql("gu", "SELECT src, dst, round(CASE WHEN (src + dst) % 5 = 0 THEN 0.9e0 ELSE ic_p END, 6) AS ic_p FROM gu WHERE (src + dst) % 7 <> 0 AND src <> 3 AND dst <> 3 UNION ALL SELECT src, dst + 1000000, 0.25e0 FROM gu WHERE src = 4"))
def apply_actions(spark, sf):
    e = users(spark, sf).edges
    act = lambda df, op, dst, w, seq: df.select(F.lit(op).alias("op"), F.col("src").alias("target"), dst.alias("destination"), F.lit(w).cast("double").alias("weight"), F.lit(seq).alias("seq"))
    actions = act(e.where("(src + dst) % 5 = 0"), "set_edge_weight", F.col("dst"), 0.9, 1).unionByName(act(e.where("(src + dst) % 7 = 0"), "remove_edge", F.col("dst"), None, 2))
    actions = actions.unionByName(act(e.where("src = 4"), "add_edge", F.col("dst") + 1000000, 0.25, 1)).unionByName(act(spark.createDataFrame([(3, 0)], "src long, dst long"), "remove_node", F.lit(None).cast("long"), None, 3))
    return r6(dynamics.apply_edge_actions(e, actions), "ic_p")


_EDITS = [("hit", f"SELECT s.t, src, dst, ic_p FROM gu, range(1, 6) s(t) WHERE {coin_sql('src', 'dst', 's.t', 'edit')} < 0.05e0"), ("log", "SELECT t, 0 AS seq, 'delete' AS op, src, dst, NULL::DOUBLE AS ic_p FROM hit UNION ALL SELECT t, 1, 'insert', dst, src, ic_p FROM hit"), ("last", "SELECT src, dst, arg_max(op, t * 10 + seq) AS op, max(t * 10 + seq) AS at FROM log WHERE t <= 3 GROUP BY 1, 2")]


@query(sql("gu", "SELECT coalesce(g.src, l.src) AS src, coalesce(g.dst, l.dst) AS dst FROM gu g FULL JOIN last l ON l.src = g.src AND l.dst = g.dst WHERE l.op IS NULL OR l.op = 'insert'", _EDITS))
def edges_at_time(spark, sf):
    g = users(spark, sf)
    return dynamics.edges_as_of(g.edges, written(dynamics.edge_edit_stream(g, 5, 0.05)), 3).select("src", "dst")


_MF = unrolled("m", "SELECT node, CASE WHEN node IN (SELECT node FROM top3u) THEN 1e0 ELSE 0e0 END AS a, CASE WHEN node IN (SELECT node FROM top3u) THEN 1e0 ELSE 0e0 END AS f FROM nu", lambda p, i: f"SELECT n.node, n.a + (1 - n.a) * coalesce(x.x, 0) AS a, (1 - n.a) * coalesce(x.x, 0) AS f FROM {p} n LEFT JOIN (SELECT dst, {product_sql('ic_p * f')} AS x FROM gu JOIN {p} q ON q.node = src WHERE f > 0 GROUP BY 1) x ON x.dst = n.node", 3)


@query(sql("gu nu top3u", "SELECT node, round(a, 6) AS infected FROM m3", _MF))
def mean_field_rollout(spark, sf):
    g = users(spark, sf)
    return r6(dynamics.mean_field(g, seeds3(g), 3).where("t = 3").select("node", "infected"), "infected")


# --- selection

_DEG = ("deg", "SELECT node, count(dst) AS d FROM nu LEFT JOIN uu ON src = node GROUP BY 1")
_DD = [_DEG, ("q0", "SELECT -1::BIGINT AS node, 0 AS r WHERE false"), *[(f"q{i}", f"SELECT * FROM q{i - 1} UNION ALL SELECT node, {i} FROM (SELECT d.node, d.d - 2 * coalesce(t, 0) - (d.d - coalesce(t, 0)) * coalesce(t, 0) * (SELECT avg(ic_p) FROM gu) AS s FROM deg d LEFT JOIN (SELECT dst, count(*) AS t FROM uu WHERE src IN (SELECT node FROM q{i - 1}) GROUP BY 1) x ON x.dst = d.node WHERE d.node NOT IN (SELECT node FROM q{i - 1}) ORDER BY s DESC, node LIMIT 1)") for i in range(1, 4)]]


@query(sql("gu nu uu", "SELECT node, CAST(r AS BIGINT) AS rank FROM q3", _DD))
def degree_discount(spark, sf):
    g = users(spark, sf)
    return longs(selectors.ranked(g, selectors.degree_discount(g, 3)), "rank")


@query(sql("gcs ncs", f"SELECT node, row_number() OVER (ORDER BY {coin_sql('node', '7', '0', 'pick')}, node) AS rank FROM ncs ORDER BY rank LIMIT 10"))
def random_seeds(spark, sf):
    return longs(selectors.random_choice(derived.customer_supplier_graph(spark, sf), 10), "rank")


@query(sql("gu nu uu top3u", "SELECT node, row_number() OVER (ORDER BY d DESC, node) AS rank FROM (SELECT node, count(*) AS d FROM (SELECT src AS node FROM user_arcs UNION ALL SELECT dst FROM user_arcs) WHERE node NOT IN (SELECT node FROM top3u) GROUP BY 1) ORDER BY rank LIMIT 5"))
def degree_blocking(spark, sf):
    g = users(spark, sf)
    return longs(selectors.by_score(g, structure.degree(g), 5, seeds3(g)), "rank")


_EXP = unrolled("w", "SELECT 0::BIGINT AS node, 1e0 AS w", lambda p, i: f"SELECT dst AS node, sum(w) AS w FROM {p} JOIN gu ON src = node GROUP BY 1", 4)
_EXPS = [*_EXP, ("expo", "SELECT node, sum(s) AS score FROM (" + " UNION ALL ".join(f"SELECT node, w * {0.5**i}e0 AS s FROM w{i}" for i in range(1, 5)) + ") WHERE node <> 0 GROUP BY 1")]


@query(sql("gu", "SELECT node, round(score, 6) AS score FROM expo", _EXPS))
def exposure_scores(spark, sf):
    return r6(selectors.exposure(users(spark, sf), spark.createDataFrame([(0,)], "node long")), "score")


@query(sql("gu nu", "SELECT node, CAST(hop AS BIGINT) AS hop FROM b12 WHERE key = 0 AND hop BETWEEN 1 AND 2", _BFS))
def proximity_rings(spark, sf):
    return longs(selectors.rings(users(spark, sf), spark.createDataFrame([(0,)], "node long"), 2).select("node", "hop"), "hop")


_NDEG = ("nd", "SELECT node, count(x) AS d FROM nu LEFT JOIN (SELECT src AS x FROM user_arcs UNION ALL SELECT dst FROM user_arcs) ON x = node GROUP BY 1")


@query(sql("gu nu", "SELECT node, row_number() OVER (ORDER BY late, hop, d DESC, node) AS rank FROM (SELECT n.node, CASE WHEN b.node IS NULL THEN 1 ELSE 0 END AS late, coalesce(b.hop, 0) AS hop, d FROM nd n LEFT JOIN (SELECT node, hop FROM b12 WHERE key = 0 AND hop = 1) b ON b.node = n.node WHERE n.node <> 0) ORDER BY rank LIMIT 5", [_NDEG, *_BFS]))
def proximity_blocking(spark, sf):
    return longs(selectors.proximity(users(spark, sf), 5, spark.createDataFrame([(0,)], "node long")), "rank")


@query(sql("gu nu uu", "SELECT u.src, u.dst, CAST(a.d * b.d AS DOUBLE) AS score FROM uu u JOIN nd a ON a.node = u.src JOIN nd b ON b.node = u.dst WHERE u.src < u.dst", [_NDEG]))
def product_degree_arcs(spark, sf):
    g = users(spark, sf)
    return selectors.arc_products(g, structure.degree(g))


@query(sql("gu nu uu", "SELECT u.src, u.dst, CAST(b.d AS DOUBLE) AS score FROM uu u JOIN nd b ON b.node = u.dst WHERE u.src IN (0, 1, 2) AND u.dst NOT IN (0, 1, 2)", [_NDEG]))
def frontier_edge_cut(spark, sf):
    return selectors.frontier_arcs(users(spark, sf), spark.createDataFrame([(0,), (1,), (2,)], "node long"))


@query(sql("gu", "SELECT g.src, g.dst, round((CASE WHEN g.src = 0 THEN 1e0 ELSE e.score END) * ic_p, 6) AS score FROM gu g LEFT JOIN expo e ON e.node = g.src WHERE g.src = 0 OR e.score IS NOT NULL", _EXPS))
def out_edge_blocking(spark, sf):
    return r6(selectors.out_arc_scores(users(spark, sf), spark.createDataFrame([(0,)], "node long")), "score")


_CW = [("d1", "SELECT node, CAST(count(dst) AS DOUBLE) AS s FROM nu LEFT JOIN uu ON src = node GROUP BY 1"), ("d2", "SELECT n.node, coalesce(sum(d.s / (SELECT max(s) FROM d1)), 0) AS s FROM nu n LEFT JOIN uu ON uu.dst = n.node LEFT JOIN d1 d ON d.node = uu.src GROUP BY 1")]


@query(sql("nu uu", "SELECT node, round((s / (SELECT max(s) FROM d2)) * (s / (SELECT max(s) FROM d2)), 6) AS score FROM d2", _CW))
def closed_walk_scores(spark, sf):
    return r6(selectors.closed_walks(users(spark, sf)), "score")


_AD = [("z0", "SELECT -1::BIGINT AS node, 0 AS r WHERE false"), *[(f"z{i}", f"SELECT * FROM z{i - 1} UNION ALL SELECT node, {i} FROM (SELECT n.node, count(x.dst) AS d FROM nu n LEFT JOIN (SELECT src, dst FROM uu WHERE src NOT IN (SELECT node FROM z{i - 1}) AND dst NOT IN (SELECT node FROM z{i - 1})) x ON x.src = n.node WHERE n.node NOT IN (SELECT node FROM z{i - 1}) GROUP BY 1 ORDER BY d DESC, n.node LIMIT 1)") for i in range(1, 5)]]


@query(sql("nu uu", "SELECT node, CAST(r AS BIGINT) AS rank FROM z4", _AD))
def adaptive_degree_removal(spark, sf):
    g = users(spark, sf)
    return longs(selectors.ranked(g, selectors.adaptive(g, 4, structure.neighbour_degree)), "rank")


def _chosen(name, pick):
    def run(spark, sf):
        g = (users if name in OVER_USERS else nations)(spark, sf)
        return longs(selectors.ranked(g, pick(g)), "rank")

    run.__name__ = name
    query()(run)


_chosen("ris_seeds", lambda g: selectors.ris(g, 3, 200))
_chosen("imm_seeds", lambda g: selectors.imm(g, 3, 1.0))
_chosen("ssa_seeds", lambda g: selectors.ssa(g, 3, 100, 2))
_chosen("filtered_ris_seeds", lambda g: selectors.ris(g, 3, 200, least_size=2))
_chosen("celf_seeds", lambda g: selectors.celf(g, 2, 8, 4))
_chosen("pagerank_greedy_seeds", lambda g: selectors.celf(g, 2, 8, 4, pool=selectors.by_score(g, structure.pagerank(g, rounds=10, tolerance=None), 8).select("node")))
_chosen("swap_search_seeds", lambda g: selectors.local_search(g, [0, 1], [2, 3, 4], 8, 4, 1))
_chosen("voterank_seeds", lambda g: selectors.voterank(g, 4))
_chosen("mia_seeds", lambda g: selectors.discounted(g, structure.path_influence(g, 2), 3))
_chosen("ldag_seeds", lambda g: selectors.discounted(g, structure.path_influence(g, 4), 3))
_chosen("skim_seeds", lambda g: selectors.discounted(g, selectors.simulated_gain(g, [], g.nodes, 16, 8), 3))
_chosen("irie_seeds", lambda g: selectors.greedy(2, lambda c: selectors.irie_scores(g, c, rounds=6)))
_chosen("collective_influence_removal", lambda g: selectors.adaptive(g, 2, selectors.collective_influence_scores))
_chosen("iterative_betweenness_removal", lambda g: selectors.adaptive(g, 4, lambda h: structure.betweenness(h, both_ways=True), block=2))
_chosen("corehd_removal", lambda g: selectors.corehd(g, 3))
_chosen("netshield_immunization", lambda g: selectors.netshield(g, 3, rounds=30))
_chosen("greedy_walk_immunization", lambda g: selectors.adaptive(g, 3, selectors.closed_walks))
_chosen("simulated_blocking_nodes", lambda g: selectors.simulated_blocking(g, 2, selectors.nodes_of(g, [0]), g.nodes.where("node between 1 and 8"), 8, 6))


_SRC = lambda g: selectors.nodes_of(g, [0])
_chosen("static_greedy_seeds", lambda g: variants.snapshot_greedy(g, 2, 8, 6))
_chosen("community_ris_seeds", lambda g: variants.community_coverage(g, 3, 150))
_chosen("degree_ris_refined_seeds", lambda g: variants.coverage_swaps(g, 3, 150))
_chosen("adaptive_greedy_seeds", lambda g: variants.two_stage_greedy(g, 2, 4, 12, 5, 5))
_chosen("community_celf_seeds", lambda g: variants.community_greedy(g, 2, 6, 4))
_chosen("annealed_seeds", lambda g: variants.annealed_seeds(g, 2, 2, 3, runs=6, horizon=4))
_chosen("genetic_seeds", lambda g: variants.bred_seeds(g, 2, 4, 2, runs=6, horizon=4))
_chosen("prevention_set_blocking", lambda g: variants.prevention_cover(g, 3, _SRC(g), 150, hops=8))
_chosen("reverse_set_blocking", lambda g: variants.reverse_blocking(g, 3, _SRC(g), 150))
_chosen("ring_cover_blocking", lambda g: variants.ring_cover(g, 2, _SRC(g), 150))
_chosen("competitive_mia_blocking", lambda g: variants.earlier_cover(g, 3, _SRC(g)))
_chosen("advanced_greedy_blocking", lambda g: variants.dominating_blockers(g, 2, _SRC(g), 10))
_chosen("greedy_replace_blocking", lambda g: variants.dominating_blockers(g, 2, _SRC(g), 10, replace=True))
_chosen("dava_immunization", lambda g: variants.dominator_doses(g, 2, _SRC(g)))
_chosen("dava_fast_immunization", lambda g: variants.dominator_doses(g, 2, _SRC(g), fast=True))
_chosen("netshield_plus_immunization", lambda g: variants.netshield_batches(g, 3, 2, 15))


@query()
def greedy_walk_arcs(spark, sf):
    return spark.createDataFrame([(a, b, i + 1) for i, (a, b) in enumerate(variants.walk_arcs(users(spark, sf), 3))], "src long, dst long, rank int")


@query()
def leave_one_out_credit(spark, sf):
    return variants.leave_one_out(users(spark, sf), [0, 1, 2], 8, 5)


@query()
def frontier_bottlenecks(spark, sf):
    g = users(spark, sf)
    return variants.bottlenecks(g, seeds3(g), 5)


@query()
def structural_regions(spark, sf):
    return variants.structural_regions(users(spark, sf))


@query()
def bridge_nodes(spark, sf):
    return variants.bridge_nodes(users(spark, sf))


@query()
def spread_gradient(spark, sf):
    g = users(spark, sf)
    return variants.spread_gradient(g, written(seeds3(g)), g.nodes, 3)


@query()
def closeness_seeds(spark, sf):
    g = users(spark, sf)
    return selectors.by_score(g, structure.closeness(g), 5)


@query()
def betweenness_seeds(spark, sf):
    g = users(spark, sf)
    return selectors.by_score(g, structure.betweenness(g), 5)


@query()
def eigenvector_seeds(spark, sf):
    g = users(spark, sf)
    return selectors.by_score(g, structure.eigenvector(g, 30), 5)


@query()
def community_seeds(spark, sf):
    return selectors.community_seeds(users(spark, sf), 5)


@query()
def bridging_seeds(spark, sf):
    g = users(spark, sf)
    return selectors.community_seeds(g, 5, selectors.bridging_degree(g, structure.communities(g)))


@query()
def acquaintance_immunization(spark, sf):
    return selectors.acquaintances(users(spark, sf), 5)


@query()
def preciado_allocation(spark, sf):
    g = nations(spark, sf)
    return selectors.by_score(g, selectors.preciado(g, 6), 5)


@query()
def competitive_ldag_blocking(spark, sf):
    g = nations(spark, sf)
    return selectors.by_score(g, selectors.earlier_reach(g, selectors.nodes_of(g, [0])), 5)


@query()
def multi_hop_proximity_blocking(spark, sf):
    g = nations(spark, sf)
    return selectors.multi_hop_proximity(g, 5, selectors.nodes_of(g, [0]))


@query()
def region_pagerank_blocking(spark, sf):
    g = nations(spark, sf)
    return selectors.in_region(g, structure.pagerank(g, rounds=10, tolerance=None), 5, selectors.nodes_of(g, [0]))


@query()
def edge_betweenness_blocking(spark, sf):
    g = nations(spark, sf)
    return selectors.top_arcs(selectors.tree_arc_scores(g, selectors.nodes_of(g, [0, 5])), 5)


@query()
def netmelt_arcs(spark, sf):
    g = nations(spark, sf)
    return selectors.top_arcs(selectors.arc_products(g, structure.eigenvector(g, 30, both_ways=True)), 5)


@query()
def dominator_blocking(spark, sf):
    g = users(spark, sf)
    return kernels.dominator_scores(dynamics.live_edges(g, 20), selectors.nodes_of(g, [0]), 20)


@query()
def link_blocking(spark, sf):
    g = nations(spark, sf)
    return selectors.top_arcs(kernels.dominator_arcs(dynamics.live_edges(g, 20), selectors.nodes_of(g, [0]), 20), 5)


@query()
def articulation_removal(spark, sf):
    return kernels.articulation_removal(users(spark, sf).edges, 3)


@query()
def fiedler_removal(spark, sf):
    return kernels.fiedler_removal(users(spark, sf).edges, 4)


@query()
def explosive_immunization(spark, sf):
    return kernels.explosive_immunization(nations(spark, sf).edges, 4)


@query()
def belief_decycling(spark, sf):
    return kernels.belief_decycling(nations(spark, sf).edges, 3)


@query()
def reinserted_removal(spark, sf):
    g = nations(spark, sf)
    return kernels.reinserted(g.edges, selectors.by_score(g, structure.degree(g), 6), 0.6)


@query()
def dismantling_curve(spark, sf):
    g = nations(spark, sf)
    return structure.dismantling_curve(g, selectors.by_score(g, structure.degree(g), 8))


@query()
def residual_connectivity(spark, sf):
    g = nations(spark, sf)
    return structure.connectivity(g, seeds3(g))


@query("SELECT plan, r.i AS round, budget // least(budget, 3) + CASE WHEN r.i <= budget % least(budget, 3) THEN 1 ELSE 0 END AS seeds FROM (SELECT o_custkey AS plan, count(*) AS budget FROM orders GROUP BY 1) JOIN range(1, 4) r(i) ON r.i <= least(budget, 3)")
def round_batches(spark, sf):
    budgets = derived.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("plan")).agg(F.count("*").alias("budget"))
    return selectors.batch_plans(budgets, 3)


# --- localisation and reconstruction


def observed(spark, sf) -> tuple[Graph, DataFrame]:
    g = users(spark, sf)
    return g, written(g.nodes.select("node", F.when(coin(F.col("node"), 1, 0, "mask") < 0.4, 1.0).otherwise(0.0).alias("y")))


_LP = [("dg", "SELECT src, sqrt(count(*)) AS d FROM uu GROUP BY 1"), ("sw", "SELECT u.src, u.dst, 1e0 / (a.d * b.d) AS w FROM uu u JOIN dg a ON a.src = u.src JOIN dg b ON b.src = u.dst"), *unrolled("f", "SELECT node, CASE WHEN y >= 0.5 THEN 1e0 ELSE -1e0 END AS y, CASE WHEN y >= 0.5 THEN 1e0 ELSE -1e0 END AS s FROM inf", lambda p, i: f"SELECT n.node, n.y, 0.5e0 * coalesce(x.g, 0) + 0.5e0 * n.y AS s FROM {p} n LEFT JOIN (SELECT dst, sum(w * s) AS g FROM sw JOIN {p} q ON q.node = src GROUP BY 1) x ON x.dst = n.node", 5)]


@query(sql("inf uu", "SELECT node, round(s, 6) AS score FROM f5", _LP))
def lpsi_scores(spark, sf):
    g, y = observed(spark, sf)
    return r6(inference.label_propagation_scores(g, y, rounds=5, tolerance=-1.0), "score")


@query(sql("inf uu", "SELECT i.node, CAST(count(x.dst) AS DOUBLE) AS score FROM inf i LEFT JOIN (SELECT src, dst FROM uu WHERE dst IN (SELECT node FROM inf WHERE y > 0.5)) x ON x.src = i.node WHERE i.y > 0.5 GROUP BY 1"))
def infected_degree_scores(spark, sf):
    g, y = observed(spark, sf)
    return inference.infected_scores(g, y, "degree")


_IB = unrolled("j", "SELECT node AS key, node, 0 AS hop FROM inf WHERE y > 0.5", lambda p, i: f"SELECT * FROM {p} UNION ALL SELECT DISTINCT a.key, dst, {i} FROM {p} a JOIN uu ON src = a.node WHERE a.hop = {i - 1} AND dst IN (SELECT node FROM inf WHERE y > 0.5) AND NOT EXISTS (SELECT 1 FROM {p} z WHERE z.key = a.key AND z.node = dst)", 8)


@query(sql("inf uu", "SELECT key AS node, CAST(-max(hop) AS DOUBLE) AS score FROM j8 GROUP BY 1", _IB))
def jordan_center_scores(spark, sf):
    g, y = observed(spark, sf)
    return inference.jordan_scores(g, y)


def even_observed(spark, sf, graph) -> tuple[Graph, DataFrame]:
    g = graph(spark, sf)
    return g, written(g.nodes.select("node", F.when(F.col("node") % 2 == 0, 1.0).otherwise(0.0).alias("y")))


def _localised(name, score):
    def run(spark, sf):
        return score(*even_observed(spark, sf, users if name in OVER_USERS else nations))

    run.__name__ = name
    query()(run)


_localised("lpsi_sources", lambda g, y: inference.label_propagation_sources(g, y, 3, rounds=10))
_localised("jordan_sources", lambda g, y: inference.jordan_centers(g, y, 3))
_localised("rumor_centrality_scores", inference.rumor_centrality)
_localised("ojc_scores", lambda g, y: inference.jordan_scores(g, y, whole_graph=True))
_localised("cover_sources", lambda g, y: selectors.ranked(g, inference.greedy_cover_sources(g, y, 3)))
_localised("dynamic_age_scores", inference.spectral_drop_scores)
_localised("effective_distance_scores", lambda g, y: inference.effective_distance_scores(g, y))
_localised("dmp_scores", lambda g, y: inference.mean_field_likelihood(g, y, inference.infected_set(y), 4))
_localised("infected_closeness_scores", lambda g, y: inference.infected_scores(g, y, "closeness"))
_localised("infected_betweenness_scores", lambda g, y: inference.infected_scores(g, y, "betweenness"))
_localised("infected_eigenvector_scores", lambda g, y: inference.infected_scores(g, y, "eigenvector"))
_localised("resimulation_scores", lambda g, y: inference.resimulation_scores(g, y, inference.infected_set(y), 6, 5))
_localised("netfill_members", lambda g, y: inference.closure(g, inference.infected_set(y)))
_localised("restart_pagerank_members", lambda g, y: inference.restart_members(g, inference.infected_set(y), 16, 10))
_localised("center_times", lambda g, y: inference.center_times(g, inference.infected_set(y), 6))


_localised("netsleuth_sources", lambda g, y: selectors.ranked(g, variants.submatrix_sources(g, y, 2, 10)))
_localised("one_hop_members", lambda g, y: variants.with_neighbours(g, inference.infected_set(y)))
_localised("community_center_times", lambda g, y: variants.community_centers(g, inference.infected_set(y), 6))


def history(spark, sf) -> tuple[Graph, DataFrame]:
    g = users(spark, sf)
    return g, written(dynamics.ic_samples(g, seeds3(g), 1, HOPS).select("node", F.col("t").alias("time"), "parent"))


_TRUE = [("live", f"SELECT 0 AS sample, src, dst FROM gu WHERE {coin_sql('src', 'dst', '0', 'arc')} < ic_p"), *unrolled("r", "SELECT 0 AS sample, node, 0 AS t FROM top3u", lambda p, i: f"SELECT * FROM {p} UNION ALL SELECT DISTINCT a.sample, dst, {i} FROM {p} a JOIN live l ON l.src = a.node WHERE a.t = {i - 1} AND dst NOT IN (SELECT node FROM {p})", HOPS)]


@query(sql("gu top3u", f"SELECT h.node, CAST(CASE WHEN {coin_sql('node', '11', '0', 'mask')} < 0.5 THEN t END AS BIGINT) AS time FROM r{HOPS} h", _TRUE))
def mask_partial_times(spark, sf):
    return longs(inference.mask(history(spark, sf)[1], "partial_times"), "time")


@query(sql("gu top3u", f"SELECT h.node, CAST(t AS BIGINT) AS time FROM r{HOPS} h WHERE {coin_sql('node', '11', '0', 'mask')} < 0.5", _TRUE))
def mask_partial_nodes(spark, sf):
    return longs(inference.mask(history(spark, sf)[1], "partial_nodes"), "time")


@query(sql("gu top3u", f"SELECT h.node, CAST(h.t AS BIGINT) AS time, CASE WHEN h.t > 0 THEN x.src END AS parent FROM r{HOPS} h LEFT JOIN (SELECT dst, src FROM (SELECT g.dst, g.src, row_number() OVER (PARTITION BY g.dst ORDER BY (a.t = b.t - 1) DESC, ic_p DESC, g.src) AS k FROM gu g JOIN r{HOPS} a ON a.node = g.src JOIN r{HOPS} b ON b.node = g.dst WHERE a.t < b.t) WHERE k = 1) x ON x.dst = h.node", _TRUE))
def likeliest_parents(spark, sf):
    g, h = history(spark, sf)
    return longs(inference.with_parents(g, h.select("node", "time")), "time")


@query(sql("gu top3u", f"SELECT round(coalesce(sum(CASE WHEN h.t IS NOT DISTINCT FROM x.t THEN ln(p) ELSE ln(1 - p) END), 0), 6) AS logprob FROM (SELECT dst, t, greatest(1e-9, least(1 - 1e-9, {product_sql('ic_p')})) AS p FROM (SELECT g.dst, a.t + 1 AS t, ic_p FROM gu g JOIN r{HOPS} a ON a.node = g.src WHERE a.t < {HOPS}) GROUP BY 1, 2) x LEFT JOIN r{HOPS} h ON h.node = x.dst WHERE h.t IS NULL OR h.t >= x.t", _TRUE))
def history_likelihood(spark, sf):
    g, h = history(spark, sf)
    return r6(inference.history_likelihood(g, h, HOPS), "logprob")


@query(sql("gu top3u", f"SELECT s.t, count(h.node) AS infected, count(CASE WHEN h.t = s.t THEN 1 END) AS frontier FROM range({HOPS + 1}) s(t) LEFT JOIN r{HOPS} h ON h.t <= s.t GROUP BY 1", _TRUE))
def history_steps(spark, sf):
    return longs(inference.history_steps(history(spark, sf)[1], HOPS), "t", "infected", "frontier")


@query()
def reconstruct_cheapest_tree(spark, sf):
    g, h = history(spark, sf)
    return inference.cheapest_tree(g, inference.mask(h, "partial_nodes"), HOPS)


@query()
def reconstruct_backfilled(spark, sf):
    g, h = history(spark, sf)
    return inference.with_parents(g, inference.backfilled(g, inference.mask(h, "partial_nodes"), 5))


@query()
def reconstruct_origins(spark, sf):
    g, h = history(spark, sf)
    return inference.greedy_origin_times(g, inference.mask(h, "final_snapshot"), 2, HOPS)[1]


def _decoded(name, decode):
    def run(spark, sf):
        g, h = history(spark, sf)
        return decode(g, written(seeds3(g)), inference.mask(h, "partial_times"))

    run.__name__ = name
    query()(run)


_decoded("reconstruct_random", lambda g, s, r: variants.random_times(r, HOPS))
_decoded("reconstruct_consistent_exact", lambda g, s, r: variants.consistent_times(g, s, r, HOPS))
_decoded("reconstruct_consistent_bounded", lambda g, s, r: variants.consistent_times(g, s, r, HOPS, exactly=False))
_decoded("reconstruct_sampled_trees", lambda g, s, r: variants.sampled_trees(g, r, HOPS, 6))
_decoded("reconstruct_attachment", lambda g, s, r: variants.cheapest_attachment(g, r, 8.0, 4))
_decoded("reconstruct_voted", lambda g, s, r: variants.voted_times(g, s, r, HOPS, 8))


@query()
def reconstruction_scores(spark, sf):
    g, h = history(spark, sf)
    return metrics.reconstruction_scores(inference.with_parents(g, inference.mask(h, "partial_nodes")), h, g.nodes.count(), HOPS)


# --- cascades and forecasts


@query(sql("ad", "SELECT * FROM ad"))
def events_to_cascade(spark, sf):
    return derived.adoptions(spark, sf)


@query(sql("ad", "SELECT cascade_id, sum(CASE WHEN elapsed <= 21600 THEN 1 ELSE 0 END)::BIGINT AS n FROM ad GROUP BY 1"))
def popularity_at(spark, sf):
    return cascades.popularity_at(derived.adoptions(spark, sf), 21600)


@query(sql("ad", "SELECT cascade_id, adopter, elapsed FROM (SELECT *, sum(CASE WHEN elapsed <= 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY cascade_id) AS k, row_number() OVER (PARTITION BY cascade_id ORDER BY elapsed, adopter) AS r FROM ad) WHERE k >= 10 AND (r <= 12 OR elapsed > 21600)"))
def filter_cascades(spark, sf):
    return cascades.filter_observed(derived.adoptions(spark, sf), 21600, 10, 12).select("cascade_id", "adopter", "elapsed")


@query(sql("ad", "SELECT cascade_id, seq, adopter, elapsed, parent FROM (SELECT a.cascade_id, a.seq, b.i AS adopter, a.elapsed, c.i AS parent, count(*) OVER (PARTITION BY a.cascade_id) AS k, min(a.seq) OVER (PARTITION BY a.cascade_id) AS m FROM ad a JOIN busy b ON b.adopter = a.adopter LEFT JOIN busy c ON c.adopter = a.parent) WHERE k >= 2 AND m = 0", [("busy", "SELECT adopter, row_number() OVER (ORDER BY adopter) - 1 AS i FROM (SELECT adopter FROM ad GROUP BY 1 ORDER BY count(*) DESC, adopter LIMIT 60)")]))
def relabel_cascades(spark, sf):
    return cascades.relabel(derived.adoptions(spark, sf), 60)


@query(sql("ad", "SELECT DISTINCT src, dst FROM (SELECT parent AS src, adopter AS dst FROM ad WHERE parent IS NOT NULL AND parent <> adopter UNION ALL SELECT adopter, parent FROM ad WHERE parent IS NOT NULL AND parent <> adopter)"))
def cascade_adjacency(spark, sf):
    return cascades.adoption_arcs(derived.adoptions(spark, sf))


@query(sql("ad", "SELECT count(*) AS cascades, sum(n)::BIGINT AS adoptions, min(n) AS least, round(avg(n), 6) AS mean, round(median(n), 6) AS median, max(n) AS most, (SELECT count(DISTINCT adopter) FROM ad) AS adopters FROM (SELECT cascade_id, count(*) AS n FROM ad GROUP BY 1)"))
def corpus_statistics(spark, sf):
    return r6(cascades.corpus_statistics(derived.adoptions(spark, sf)), "mean", "median")


@query(sql("bins", "SELECT * FROM bins"))
def bin_events(spark, sf):
    return cascades.bin_events(derived.adoptions(spark, sf), 1800, HORIZON)


@query(sql("bins", "SELECT c.cascade_id, s.t, (SELECT count(*) FROM bins b WHERE b.cascade_id = c.cascade_id AND b.t <= s.t) AS infected, (SELECT count(*) FROM bins b WHERE b.cascade_id = c.cascade_id AND b.t = s.t) AS frontier FROM (SELECT cascade_id, max(t) AS m FROM bins GROUP BY 1) c JOIN range(48) s(t) ON s.t <= c.m"))
def replay_records(spark, sf):
    return longs(cascades.replay(cascades.bin_events(derived.adoptions(spark, sf), 1800, HORIZON)), "infected", "frontier")


@query(sql("ad", "SELECT cascade_id, split FROM sp WHERE split <> 'train' OR publish_time + 86400 <= (SELECT min(publish_time) FROM sp WHERE split = 'test')", [("hd", "SELECT DISTINCT cascade_id, publish_time FROM ad"), ("sp", "SELECT cascade_id, publish_time, CASE WHEN r < floor(n * 0.7e0) THEN 'train' WHEN r < floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY publish_time, cascade_id) - 1 AS r, count(*) OVER () AS n FROM hd)")]))
def assign_splits(spark, sf):
    return cascades.assign_splits(derived.adoptions(spark, sf).select("cascade_id", "publish_time").distinct(), 86400).select("cascade_id", "split")


@query(f"SELECT s_suppkey, CASE WHEN r < floor(n * 0.7e0) THEN 'train' WHEN r < floor(n * 0.7e0) + floor(n * 0.15e0) THEN 'valid' ELSE 'test' END AS split FROM (SELECT s_suppkey, row_number() OVER (ORDER BY {coin_sql('s_suppkey', '9', '0', 'split')}, s_suppkey) - 1 AS r, count(*) OVER () AS n FROM supplier)")
def random_splits(spark, sf):
    return cascades.random_splits(derived.table(spark, sf, "supplier").select("s_suppkey"), "s_suppkey")


def binned(spark, sf) -> DataFrame:
    return written(cascades.bin_events(derived.adoptions(spark, sf), 1800, HORIZON))


def sizes(b: DataFrame) -> DataFrame:
    return written(b.groupBy("cascade_id").agg(F.sum((F.col("t") < WINDOW).cast("long")).alias("observed"), F.count("*").alias("final")))


@query(sql("waves", "SELECT * FROM waves"))
def observed_waves(spark, sf):
    return longs(cascades.observed_waves(binned(spark, sf), WINDOW), "n")


def _forecast(name, make, oracle=None):
    def run(spark, sf):
        return r6(make(binned(spark, sf), lambda: users(spark, sf)), "predicted")

    run.__name__ = name
    query(oracle)(run)


_W = lambda b: written(cascades.observed_waves(b, WINDOW))
_OBS = ("ob", "SELECT w.cascade_id, sum(w.n) AS observed, arg_max(w.n, w.t) AS last FROM waves w GROUP BY 1")
_forecast("forecast_persistence", lambda b, g: cascades.persistence(sizes(b)), sql("sizes", "SELECT cascade_id, CAST(observed AS DOUBLE) AS predicted FROM sizes"))
_forecast("forecast_mean_size", lambda b, g: cascades.mean_size(sizes(b), sizes(b)), sql("sizes", "SELECT cascade_id, round(greatest(observed, (SELECT exp(avg(ln(final))) FROM sizes)), 6) AS predicted FROM sizes"))
_forecast("forecast_log_log_regression", lambda b, g: cascades.log_log_regression(sizes(b), sizes(b)), sql("sizes", "SELECT cascade_id, round(greatest(observed, exp((SELECT regr_slope(ln(final), ln(observed)) FROM sizes) * ln(observed) + (SELECT regr_intercept(ln(final), ln(observed)) FROM sizes))), 6) AS predicted FROM sizes"))
_forecast("forecast_branching_factor", lambda b, g: cascades.branching_factor(_W(b)), sql("waves ratios", "SELECT o.cascade_id, round(CASE WHEN coalesce(b, 0) < 1 THEN observed + last * coalesce(b, 0) / (1 - coalesce(b, 0)) END, 6) AS predicted FROM ob o LEFT JOIN (SELECT cascade_id, avg(ratio) AS b FROM (SELECT *, row_number() OVER (PARTITION BY cascade_id ORDER BY t DESC) AS r FROM ratios) WHERE r <= 3 GROUP BY 1) x USING (cascade_id)", [_OBS]))
_forecast("forecast_hawkes", lambda b, g: cascades.hawkes(_W(b)), sql("waves ratios", "SELECT o.cascade_id, round(CASE WHEN coalesce(b, 0) < 0.999 THEN observed + last / (1 - coalesce(b, 0)) END, 6) AS predicted FROM ob o LEFT JOIN (SELECT cascade_id, avg(ratio) AS b FROM ratios GROUP BY 1) x USING (cascade_id)", [_OBS]))
_forecast("forecast_neighbourhood", lambda b, g: cascades.neighbourhood_size(g(), b, WINDOW), sql("bins gu", "SELECT s.cascade_id, CAST(n + coalesce(k, 0) AS DOUBLE) AS predicted FROM (SELECT cascade_id, count(*) AS n FROM bins WHERE t < 12 GROUP BY 1) s LEFT JOIN (SELECT b.cascade_id, count(DISTINCT dst) AS k FROM bins b JOIN gu ON src = b.node WHERE b.t = 11 AND NOT EXISTS (SELECT 1 FROM bins z WHERE z.cascade_id = b.cascade_id AND z.node = dst AND z.t < 12) GROUP BY 1) x USING (cascade_id)"))
_forecast("forecast_degree_scaled", lambda b, g: cascades.degree_scaled(g(), b, WINDOW, HORIZON), sql("bins user_arcs nu", "SELECT cascade_id, round(count(*) * (1 + avg(d) / (SELECT avg(d) FROM dd) * 36 / 48e0), 6) AS predicted FROM bins JOIN dd USING (node) WHERE t < 12 GROUP BY 1", [("dd", "SELECT node, count(*) AS d FROM (SELECT src AS node FROM user_arcs UNION ALL SELECT dst FROM user_arcs) GROUP BY 1")]))
_forecast("forecast_self_exciting", lambda b, g: cascades.self_exciting(g(), b, WINDOW), sql("bins gu nu", "SELECT cascade_id, round(CASE WHEN b < 0.999 THEN n + n * b / (1 - b) END, 6) AS predicted FROM (SELECT cascade_id, count(*) AS n, avg(coalesce(d, 0)) * (SELECT avg(ic_p) FROM gu) AS b FROM bins JOIN nu USING (node) LEFT JOIN (SELECT src, count(*) AS d FROM gu GROUP BY 1) o ON o.src = node WHERE t < 12 GROUP BY 1)"))
_forecast("forecast_reinforced", lambda b, g: cascades.reinforced(_W(b), WINDOW, HORIZON))
_forecast("forecast_power_memory", lambda b, g: cascades.power_memory(_W(b), WINDOW, HORIZON))
_forecast("forecast_reachable", lambda b, g: cascades.reachable_size(g(), b, WINDOW, 2))
_forecast("forecast_communities", lambda b, g: cascades.community_spill(g(), b, WINDOW, HORIZON))
_forecast("forecast_random", lambda b, g: cascades.random_size(sizes(b), sizes(b)))
_forecast("forecast_simulated", lambda b, g: cascades.forward_simulation(g(), b, WINDOW, 2, 4))


def _with_features(b, g):
    f = written(cascades.features(g(), b, WINDOW))
    return f, f.join(sizes(b).select("cascade_id", "final"), "cascade_id")


_forecast("forecast_feature_regression", lambda b, g: cascades.feature_regression(*_with_features(b, g)))
_forecast("forecast_feature_trees", lambda b, g: (lambda f, e: cascades.feature_trees(f, e, trees=10))(*_with_features(b, g)))


@query(sql("sizes", "SELECT count(*) AS n, 0e0 AS decline_rate, round(avg(pow(log2(greatest(p, 1)) - log2(greatest(final, 1)), 2)), 6) AS msle, round(avg(abs(log2(greatest(p, 1)) - log2(greatest(final, 1)))), 6) AS male, round(avg(abs(p - final) / greatest(final, 1)), 6) AS mape, round(avg(pow((p - final) / greatest(final, 1), 2)), 6) AS mrse, round(median(pow((p - final) / greatest(final, 1), 2)), 6) AS mrse_median, round(corr(p, final), 6) AS pcc, round(avg(CASE WHEN (p >= 2 * observed) = (final >= 2 * observed) THEN 1e0 ELSE 0 END), 6) AS doubling FROM (SELECT *, observed * 3e0 AS p FROM sizes)"))
def popularity_metrics(spark, sf):
    s = sizes(binned(spark, sf)).select((F.col("observed") * 3.0).alias("predicted"), F.col("final").alias("actual"), "observed")
    keep = ["decline_rate", "msle", "male", "mape", "mrse", "mrse_median", "pcc", "doubling"]
    return r6(metrics.popularity(s).select("n", *keep), *keep)


@query(sql("sizes", "SELECT round(sum(CASE WHEN a <= k AND b <= k THEN 1 ELSE 0 END) / max(k), 6) AS coverage FROM (SELECT row_number() OVER (ORDER BY observed DESC, cascade_id) AS a, row_number() OVER (ORDER BY final DESC, cascade_id) AS b, floor(count(*) OVER () / 10) AS k FROM sizes)"))
def coverage_at_k(spark, sf):
    s = sizes(binned(spark, sf))
    return r6(metrics.coverage_at_k(s.select(F.col("cascade_id").alias("id"), F.col("observed").alias("predicted"), F.col("final").alias("actual"))), "coverage")


# --- metrics and rankings


def flags(spark, sf) -> DataFrame:
    li = derived.table(spark, sf, "lineitem")
    return li.select(F.col("l_linestatus").alias("grp"), (F.col("l_discount") * 10).alias("p"), (F.col("l_returnflag") == "R").alias("y"), (F.col("l_tax") > 0.04).alias("was"))


@query(sql("flags", "SELECT grp, round(CASE WHEN tp + fp + fn = 0 THEN 1e0 ELSE 2e0 * tp / (2 * tp + fp + fn) END, 6) AS infected_f1, round(acc, 6) AS accuracy, round(brier, 6) AS brier FROM (SELECT grp, count(*) FILTER (p >= 0.5 AND y) AS tp, count(*) FILTER (p >= 0.5 AND NOT y) AS fp, count(*) FILTER (NOT p >= 0.5 AND y) AS fn, avg(CASE WHEN (p >= 0.5) = y THEN 1e0 ELSE 0 END) AS acc, avg(pow(p - CASE WHEN y THEN 1 ELSE 0 END, 2)) AS brier FROM flags GROUP BY 1)"))
def score_predictions(spark, sf):
    return r6(metrics.prediction_scores(flags(spark, sf), ["grp"]).select("grp", "infected_f1", "accuracy", "brier"), "infected_f1", "accuracy", "brier")


@query(sql("flags", "SELECT CAST(b.b AS BIGINT) AS bin, count(f.p) AS n, round(avg(f.p), 6) AS mean_p, round(avg(CASE WHEN f.y THEN 1e0 WHEN NOT f.y THEN 0 END), 6) AS mean_y FROM range(10) b(b) LEFT JOIN flags f ON least(floor(f.p * 10), 9) = b.b GROUP BY 1"))
def reliability_bins(spark, sf):
    return longs(r6(metrics.reliability(flags(spark, sf)), "mean_p", "mean_y"), "bin", "n")


@query(sql("flags", "SELECT grp, round((sum(CASE WHEN y THEN r END) - pos * (pos + 1) / 2) / (pos * (n - pos)), 6) AS auc FROM (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2e0 AS r, count(*) FILTER (y) OVER (PARTITION BY grp) AS pos, count(*) OVER (PARTITION BY grp) AS n FROM flags) GROUP BY grp, pos, n".replace("SELECT grp, round((sum", "SELECT grp, round(CASE WHEN pos > 0 AND pos < n THEN (sum").replace("(n - pos)), 6)", "(n - pos)) END, 6)")))
def roc_auc(spark, sf):
    return r6(metrics.roc_auc(flags(spark, sf), "p", "y", ["grp"]), "auc")


@query(sql("flags", "SELECT grp, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM (SELECT grp, CAST(count(*) FILTER (was AND y) AS DOUBLE) AS tp, CAST(count(*) FILTER (was AND NOT y) AS DOUBLE) AS fp, CAST(count(*) FILTER (NOT was AND y) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT was AND NOT y) AS DOUBLE) AS tn FROM flags GROUP BY 1)"))
def matthews_corrcoef(spark, sf):
    return r6(metrics.matthews(flags(spark, sf), "was", "y", ["grp"]), "mcc")


def trades(spark, sf) -> DataFrame:
    s, li = derived.table(spark, sf, "supplier"), derived.table(spark, sf, "lineitem")
    revenue = li.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return s.join(revenue, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_nationkey").cast("long").alias("graph_id"), F.col("s_suppkey").alias("cand_id"), F.col("s_acctbal").alias("predicted"), F.round(F.coalesce("r", F.lit(0.0)), 2).alias("actual"))


_PAIRS = ("pairs", "SELECT a.graph_id, sign(a.predicted - b.predicted) AS x, sign(a.actual - b.actual) AS y, abs(a.actual - b.actual) AS m FROM trades a JOIN trades b ON a.graph_id = b.graph_id AND a.cand_id < b.cand_id")


@query(sql("trades", "SELECT graph_id, CASE WHEN m < 0.5 THEN '[0,0.5)' WHEN m < 1 THEN '[0.5,1)' WHEN m < 2 THEN '[1,2)' ELSE '[2,inf)' END AS margin, count(*) AS pairs, round(avg(CASE WHEN x = y THEN 1e0 ELSE 0 END), 6) AS accuracy FROM pairs WHERE m > 1e-9 GROUP BY 1, 2", [_PAIRS]))
def preference_accuracy(spark, sf):
    return r6(ranking.pair_order(trades(spark, sf)), "accuracy")


@query(sql("trades", "SELECT graph_id, round(coalesce(sum(x * y) / nullif(sqrt(sum(x * x) * CAST(sum(y * y) AS DOUBLE)), 0), 0), 6) AS tau FROM pairs GROUP BY 1", [_PAIRS]))
def kendall_tau(spark, sf):
    return r6(ranking.kendall_tau(trades(spark, sf)), "tau")


@query(sql("trades", "SELECT round(corr(a, b), 6) AS rho FROM (SELECT rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2e0 AS a, rank() OVER (ORDER BY actual) + (count(*) OVER (PARTITION BY actual) - 1) / 2e0 AS b FROM trades)"))
def spearman_rho(spark, sf):
    return r6(metrics.spearman(trades(spark, sf), "predicted", "actual"), "rho")


_RANKS = ("rk", "SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY predicted DESC, cand_id) AS p, row_number() OVER (PARTITION BY graph_id ORDER BY actual DESC, cand_id) AS t FROM trades")


@query(sql("trades", "SELECT graph_id, round(count(*) FILTER (p <= 3 AND t <= 3) / CAST(least(3, count(*)) AS DOUBLE), 6) AS overlap, round(max(CASE WHEN p <= 3 THEN actual END), 6) AS best_found, round(max(actual) - max(CASE WHEN p <= 3 THEN actual END), 6) AS regret FROM rk GROUP BY 1", [_RANKS]))
def top_k_metrics(spark, sf):
    return r6(ranking.top_k_scores(trades(spark, sf), 3), "overlap", "best_found", "regret")


@query(sql("trades", "SELECT graph_id, coalesce(min(CASE WHEN actual >= 1000000 THEN p END), count(*) + 1) AS calls FROM rk GROUP BY 1", [_RANKS]))
def calls_to_first_win(spark, sf):
    return ranking.calls_to_first_win(trades(spark, sf), 1000000.0)


@query(sql("trades", "SELECT graph_id, round(max(actual), 6) AS best, round(max(CASE WHEN p = 1 THEN actual END), 6) AS chosen, round(max(actual) - max(CASE WHEN p = 1 THEN actual END), 6) AS regret FROM rk GROUP BY 1", [_RANKS]))
def planning_regret(spark, sf):
    return r6(ranking.planning_regret(trades(spark, sf)), "best", "chosen", "regret")


@query(sql("trades", "SELECT a.cand_id, count(b.cand_id) AS dominated_by FROM trades a LEFT JOIN trades b ON b.predicted >= a.predicted AND b.actual >= a.actual AND (b.predicted > a.predicted OR b.actual > a.actual) GROUP BY 1"))
def pareto_front(spark, sf):
    return longs(ranking.pareto_front(trades(spark, sf), {"predicted": "max", "actual": "max"}).select("cand_id", "dominated_by"), "dominated_by")


@query(sql("trades", "SELECT round(coalesce(sum(greatest(0, y - coalesce(b, 0)) * x), 0), 2) AS hypervolume FROM (SELECT x, y, max(y) OVER (ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT predicted AS x, max(actual) AS y FROM trades WHERE predicted > 0 AND actual > 0 GROUP BY 1))"))
def hypervolume_2d(spark, sf):
    return ranking.hypervolume(trades(spark, sf), "predicted", "actual", (0.0, 0.0)).select(F.round("hypervolume", 2).alias("hypervolume"))


@query(sql("trades", "SELECT graph_id, metric, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, count(*) AS n, round(min(v), 6) AS least, round(max(v), 6) AS most FROM (SELECT graph_id, 'predicted' AS metric, predicted AS v FROM trades UNION ALL SELECT graph_id, 'actual', actual FROM trades) GROUP BY 1, 2"))
def aggregate_runs(spark, sf):
    return r6(ranking.summary(trades(spark, sf), ["predicted", "actual"], ["graph_id"]), "mean", "std", "least", "most")


@query(sql("trades", "SELECT round(avg(predicted - actual), 6) AS delta, round(stddev_samp(predicted - actual) / sqrt(count(*)), 6) AS se, round(avg(CASE WHEN predicted < actual THEN 1e0 ELSE 0 END), 6) AS realization_gap FROM trades"))
def paired_band(spark, sf):
    return r6(ranking.paired_band(trades(spark, sf).select(F.col("predicted").alias("candidate"), F.col("actual").alias("incumbent"))), "delta", "se", "realization_gap")


def steps(spark, sf) -> DataFrame:
    o = derived.table(spark, sf, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("step")).agg(F.round(F.max("o_totalprice"), 2).alias("best"))


_STEPS = ("st", "SELECT CAST(o_orderdate AS DATE) AS step, round(max(o_totalprice), 2) AS best FROM orders GROUP BY 1")


@query(sql("", "SELECT CAST(step AS VARCHAR) AS step, CASE WHEN was IS NULL THEN 'WARMING_UP' WHEN top - was < 1e-9 THEN 'STAGNANT' ELSE 'IMPROVING' END AS status FROM (SELECT step, max(best) OVER (ORDER BY step ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS top, lag(best, 5) OVER (ORDER BY step) AS was FROM st)", [_STEPS]))
def search_stagnation(spark, sf):
    return ranking.stagnation(steps(spark, sf), 5).select(F.col("step").cast("string").alias("step"), "status")


@query(sql("", "SELECT date_diff('day', max(CASE WHEN up THEN step END), max(step)) AS flat FROM (SELECT step, best > coalesce(max(best) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) AS up FROM st)", [_STEPS]))
def flat_generations(spark, sf):
    n = steps(spark, sf).select(F.datediff("step", F.lit("1970-01-01")).cast("long").alias("step"), "best")
    return ranking.flat_generations(n)


@query(sql("trades", "SELECT cand_id, graph_id, rank() OVER (PARTITION BY graph_id ORDER BY actual DESC) AS rank, round(max(actual) OVER (PARTITION BY graph_id) - actual, 6) AS gap FROM trades"))
def leaderboard(spark, sf):
    t = trades(spark, sf).withColumnRenamed("actual", "reward")
    return longs(r6(ranking.leaderboard(t, ["graph_id"]).select("cand_id", "graph_id", "rank", "gap"), "gap"), "rank")


@query(sql("gu top3u next3u", f"SELECT round(sum(least(a.p, b.p)) / least((SELECT sum(p) FROM pa), (SELECT sum(p) FROM pb)), 6) AS overlap FROM pa a JOIN pb b USING (node)", [("pa", f"SELECT dst AS node, {product_sql('ic_p')} AS p FROM gu WHERE src IN (SELECT node FROM top3u) GROUP BY 1"), ("pb", f"SELECT dst AS node, {product_sql('ic_p')} AS p FROM gu WHERE src IN (SELECT node FROM next3u) GROUP BY 1")]))
def plan_redundancy(spark, sf):
    from ..core import product_of

    g = users(spark, sf)
    solo = None
    for i in (0, 3):
        part = g.edges.join(written(seeds3(g, i)).withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(product_of(F.col("ic_p")).alias("p")).withColumn("seed", F.lit(i))
        solo = part if solo is None else solo.unionByName(part)
    return r6(ranking.redundancy(written(solo)).select("overlap"), "overlap")


@query(sql("", "SELECT round(max(v), 6) AS peak, CAST(arg_max(t, v * 1000 - t) AS BIGINT) AS time_to_peak, round(sum(v), 6) AS area, round(avg(CASE WHEN t >= 5 THEN v END), 6) AS endemic FROM (VALUES (0, 0e0), (1, 2), (2, 6), (3, 14), (4, 25), (5, 18), (6, 9), (7, 4), (8, 1), (9, 0)) c(t, v)"))
def epidemic_curve_metrics(spark, sf):
    c = spark.createDataFrame(list(enumerate([0.0, 2.0, 6.0, 14.0, 25.0, 18.0, 9.0, 4.0, 1.0, 0.0])), "t int, value double")
    return longs(r6(metrics.epidemic_curve(c), "peak", "area", "endemic"), "time_to_peak")


# --- reports

_DEGREES = ("cd", "SELECT t.*, coalesce(n, 0) AS degree FROM trades t LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_suppkey = t.cand_id")
_ORDERS = ("ord", "SELECT graph_id, cand_id, actual, 'model' AS \"order\", row_number() OVER (PARTITION BY graph_id ORDER BY predicted DESC, cand_id) AS place FROM cd UNION ALL SELECT graph_id, cand_id, actual, 'oracle', row_number() OVER (PARTITION BY graph_id ORDER BY actual DESC, cand_id) FROM cd UNION ALL SELECT graph_id, cand_id, actual, 'degree', row_number() OVER (PARTITION BY graph_id ORDER BY degree DESC, cand_id) FROM cd UNION ALL SELECT graph_id, cand_id, actual, 'random', row_number() OVER (PARTITION BY graph_id ORDER BY md5(CAST(cand_id AS VARCHAR)), cand_id) FROM cd")


def _ordered(spark, sf) -> DataFrame:
    degree = derived.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cand_id")).agg(F.count("*").alias("degree"))
    return reports.ranking_orders(trades(spark, sf).join(degree, "cand_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), ["graph_id"])


@query(sql("trades", 'SELECT graph_id, cand_id, "order", place FROM ord', [_DEGREES, _ORDERS]))
def ranking_orders(spark, sf):
    return _ordered(spark, sf).select("graph_id", "cand_id", "order", "place")


@query(sql("trades", 'SELECT graph_id, "order", calls, round(regret, 4) AS regret, round(1 - calls / CAST(max(CASE WHEN "order" = \'random\' THEN calls END) OVER (PARTITION BY graph_id) AS DOUBLE), 6) AS reduction FROM (SELECT graph_id, "order", coalesce(min(CASE WHEN actual >= 1000000 THEN place END), count(*) + 1) AS calls, max(actual) - max(CASE WHEN place = 1 THEN actual END) AS regret FROM ord GROUP BY 1, 2)', [_DEGREES, _ORDERS]))
def ranking_report(spark, sf):
    return reports.order_report(_ordered(spark, sf), ["graph_id"], 1000000.0).select("graph_id", "order", "calls", F.round("regret", 4).alias("regret"), F.round("reduction", 6).alias("reduction"))


def _budget_sql(direction: str) -> str:
    ranks = ("br", f"SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY predicted {direction}, cand_id) AS p, row_number() OVER (PARTITION BY graph_id ORDER BY actual {direction}, cand_id) AS t FROM trades")
    return sql("trades", "SELECT graph_id, round(best, 3) AS best, round(chosen, 3) AS chosen, round(overlap, 6) AS overlap, round(coalesce(abs(best - chosen) / nullif(abs(best), 0), 0), 6) AS regret FROM (SELECT graph_id, sum(CASE WHEN t <= 3 THEN actual END) AS best, sum(CASE WHEN p <= 3 THEN actual END) AS chosen, count(*) FILTER (p <= 3 AND t <= 3) / CAST(least(3, count(*)) AS DOUBLE) AS overlap FROM br GROUP BY 1)", [ranks])


def _budget(spark, sf, sense: str) -> DataFrame:
    got = reports.budget_regret(trades(spark, sf), ["graph_id"], 3, sense)
    return got.select("graph_id", F.round("best", 3).alias("best"), F.round("chosen", 3).alias("chosen"), F.round("overlap", 6).alias("overlap"), F.round("regret", 6).alias("regret"))


@query(_budget_sql("DESC"))
def planning_regret_budget(spark, sf):
    return _budget(spark, sf, "max")


@query(_budget_sql("ASC"))
def blocking_regret(spark, sf):
    return _budget(spark, sf, "min")


@query(sql("trades", "SELECT a.cand_id FROM trades a WHERE NOT EXISTS (SELECT 1 FROM trades b WHERE b.predicted >= a.predicted AND b.actual <= a.actual AND (b.predicted > a.predicted OR b.actual < a.actual))"))
def fidelity_cost_front(spark, sf):
    return reports.fidelity_cost_front(trades(spark, sf), "predicted", "actual").select("cand_id")


_HISTORY = ("hist", "SELECT o_custkey AS search, o_orderkey AS step, CAST(o_totalprice AS DOUBLE) AS score, CAST(o_totalprice AS DOUBLE) - lag(CAST(o_totalprice AS DOUBLE)) OVER w AS delta, lag(CAST(o_totalprice AS DOUBLE)) OVER w - lag(CAST(o_totalprice AS DOUBLE), 2) OVER w AS expected FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")


def _history(spark, sf) -> DataFrame:
    """Orders of a customer as a search: a step's score, its change, and the last change as the forecast."""
    w = Window.partitionBy("search").orderBy("step")
    o = derived.table(spark, sf, "orders").select(F.col("o_custkey").alias("search"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").cast("double").alias("score"))
    return o.select("*", (F.col("score") - F.lag("score").over(w)).alias("delta"), (F.lag("score").over(w) - F.lag("score", 2).over(w)).alias("expected"))


@query(sql("", "SELECT search, count(*) FILTER (sign(expected) <> sign(delta)) AS wrong, count(*) = 4 AND 2 * count(*) FILTER (sign(expected) <> sign(delta)) > 4 AS miscalibrated FROM (SELECT *, row_number() OVER (PARTITION BY search ORDER BY step DESC) AS back FROM hist WHERE expected IS NOT NULL) WHERE back <= 4 GROUP BY 1", [_HISTORY]))
def miscalibrated(spark, sf):
    return reports.miscalibrated(_history(spark, sf).where("expected is not null"), ["search"], 4)


@query(sql("", "SELECT search, count(*) AS n, round(avg(d), 6) AS \"drop\", round(avg(CASE WHEN d > 0 THEN 1e0 ELSE 0 END), 6) AS share FROM (SELECT search, score - lead(score) OVER (PARTITION BY search ORDER BY step) AS d FROM hist) WHERE d IS NOT NULL GROUP BY 1", [_HISTORY]))
def optimism_summary(spark, sf):
    got = reports.optimism_summary(_history(spark, sf), ["search"])
    return got.select("search", "n", F.round("drop", 6).alias("drop"), F.round("share", 6).alias("share"))


_YEARS = ("yr", "SELECT o_orderpriority AS arm, o_custkey AS unit, avg(CASE WHEN year(CAST(o_orderdate AS DATE)) % 2 = 0 THEN o_totalprice END) AS reward, avg(CASE WHEN year(CAST(o_orderdate AS DATE)) % 2 = 1 THEN o_totalprice END) AS was FROM orders GROUP BY 1, 2")


@query(sql("", "SELECT arm, count(*) AS n, round(avg(was - reward), 4) AS delta, round(coalesce(stddev_samp(was - reward), 0) / sqrt(count(*)), 4) AS se FROM yr WHERE reward IS NOT NULL AND was IS NOT NULL GROUP BY 1", [_YEARS]))
def paired_delta(spark, sf):
    o = derived.table(spark, sf, "orders").withColumn("odd", F.year(F.to_date("o_orderdate")) % 2 == 1)
    of = lambda odd: o.where(F.col("odd") == odd).groupBy(F.col("o_orderpriority").alias("arm"), F.col("o_custkey").alias("unit")).agg(F.avg("o_totalprice").alias("reward"))
    got = reports.paired_delta(of(False), of(True), ["arm"], "min")
    return got.select("arm", "n", F.round("delta", 4).alias("delta"), F.round("se", 4).alias("se"))


@query(sql("trades", "SELECT cand_id, round(actual - predicted, 4) AS prevented, round(coalesce((actual - predicted) / nullif(actual, 0), 0), 6) AS share, round(coalesce((actual - predicted) / nullif(degree, 0), 0), 4) AS per_action FROM cd", [_DEGREES]))
def blocking_metrics(spark, sf):
    actions = derived.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("cand_id")).agg(F.count("*").alias("actions"))
    plans = trades(spark, sf).join(actions, "cand_id", "left").select("cand_id", F.col("predicted").cast("double").alias("spread"), F.col("actual").cast("double").alias("unopposed"), F.coalesce("actions", F.lit(0)).alias("actions"))
    got = reports.blocking_metrics(plans)
    return got.select("cand_id", F.round("prevented", 4).alias("prevented"), F.round("share", 6).alias("share"), F.round("per_action", 4).alias("per_action"))


@query(sql("gu", "SELECT src, dst, row_number() OVER (ORDER BY md5(src || '-' || dst || '-7'), src, dst) AS rank FROM gu QUALIFY rank <= 50"))
def random_edge_cut(spark, sf):
    return reports.random_edges(users(spark, sf).edges, 50, 7)


@query(sql("trades", "SELECT count(*) AS steps, count(*) FILTER (delta > 0) AS naive, count(*) FILTER (delta > se) AS banded FROM (SELECT avg(predicted - actual / 1000) AS delta, coalesce(stddev_samp(predicted - actual / 1000), 0) / sqrt(count(*)) AS se FROM trades GROUP BY graph_id)"))
def acceptance_ledger(spark, sf):
    d = F.col("predicted") - F.col("actual") / 1000
    steps_of = trades(spark, sf).groupBy("graph_id").agg(F.avg(d).alias("delta"), (F.coalesce(F.stddev_samp(d), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("se"))
    return longs(ranking.acceptance_ledger(steps_of), "steps", "naive", "banded")
