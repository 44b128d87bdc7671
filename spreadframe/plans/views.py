"""SQL text of the derived graphs and cascades, and helpers that unroll iterations into common table expressions."""

from __future__ import annotations

from ..functions.coins import coin_sql

VIEWS: dict[str, tuple[list[str], str]] = {
    "user_arcs": ([], "SELECT DISTINCT u AS src, v AS dst FROM (SELECT user_id AS v, lag(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS u FROM events) WHERE u IS NOT NULL AND u <> v"),
    "gu": (["user_arcs"], "SELECT src, dst, 1e0 / count(*) OVER (PARTITION BY dst) AS ic_p FROM user_arcs"),
    "nu": (["user_arcs"], "SELECT src AS node FROM user_arcs UNION SELECT dst FROM user_arcs"),
    "uu": (["user_arcs"], "SELECT src, dst FROM user_arcs UNION SELECT dst, src FROM user_arcs"),
    "cs_arcs": ([], "SELECT DISTINCT o_custkey AS src, 1000000 + l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "gcs": (["cs_arcs"], "SELECT src, dst, 1e0 / count(*) OVER (PARTITION BY dst) AS ic_p FROM cs_arcs"),
    "ncs": (["cs_arcs"], "SELECT src AS node FROM cs_arcs UNION SELECT dst FROM cs_arcs"),
    "ev1": ([], "SELECT * FROM (SELECT event_type || '#' || CAST(CAST(ts AS DATE) AS VARCHAR) AS cascade_id, user_id, ts, event_id, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE), user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1"),
    "ad": (["ev1"], """SELECT cascade_id, CAST(floor(epoch(first_value(ts) OVER w)) AS BIGINT) AS publish_time, user_id AS adopter, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(first_value(ts) OVER w)) AS BIGINT) AS elapsed,
        row_number() OVER w - 1 AS seq, lag(user_id) OVER w AS parent FROM ev1 WINDOW w AS (PARTITION BY cascade_id ORDER BY ts, event_id)"""),
    # six hours of 30 minutes observed, a day in all
    "bins": (["ad"], "SELECT cascade_id, adopter AS node, min(CASE WHEN parent IS NULL AND seq = 0 THEN 0 ELSE elapsed // 1800 END) AS t FROM ad WHERE (CASE WHEN parent IS NULL AND seq = 0 THEN 0 ELSE elapsed // 1800 END) < 48 GROUP BY 1, 2"),
    "sizes": (["bins"], "SELECT cascade_id, sum(CASE WHEN t < 12 THEN 1 ELSE 0 END)::BIGINT AS observed, count(*) AS final FROM bins GROUP BY 1"),
    "waves": (["bins"], "SELECT c.cascade_id, s.t, coalesce(w.n, 0) AS n FROM (SELECT DISTINCT cascade_id FROM bins) c CROSS JOIN range(12) s(t) LEFT JOIN (SELECT cascade_id, t, count(*) AS n FROM bins WHERE t < 12 GROUP BY 1, 2) w ON w.cascade_id = c.cascade_id AND w.t = s.t"),
    "ratios": (["waves"], "SELECT cascade_id, t, n / was AS ratio FROM (SELECT cascade_id, t, CAST(n AS DOUBLE) AS n, lag(n) OVER (PARTITION BY cascade_id ORDER BY t) AS was FROM waves WHERE n > 0) WHERE was IS NOT NULL"),
    "trades": ([], "SELECT CAST(s_nationkey AS BIGINT) AS graph_id, s_suppkey AS cand_id, s_acctbal AS predicted, round(coalesce(sum(l_extendedprice * (1 - l_discount)), 0), 2) AS actual FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2, 3"),
    "flags": ([], "SELECT l_orderkey, l_linenumber, l_linestatus AS grp, l_discount * 10 AS p, l_returnflag = 'R' AS y, l_tax > 0.04 AS was FROM lineitem"),
    "inf": (["gu", "nu"], f"SELECT node, CASE WHEN {coin_sql('node', '1', '0', 'mask')} < 0.4 THEN 1e0 ELSE 0e0 END AS y FROM nu"),
    "top3u": (["user_arcs"], "SELECT node FROM (SELECT node, count(*) AS n FROM (SELECT src AS node FROM user_arcs UNION ALL SELECT dst FROM user_arcs) GROUP BY 1) ORDER BY n DESC, node LIMIT 3"),
    "next3u": (["user_arcs"], "SELECT node FROM (SELECT node, count(*) AS n FROM (SELECT src AS node FROM user_arcs UNION ALL SELECT dst FROM user_arcs) GROUP BY 1) ORDER BY n DESC, node LIMIT 3 OFFSET 3"),
}


def sql(names: str, body: str, more: list[tuple[str, str]] | None = None) -> str:
    """A query over the named views and further expressions, each computed once."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        if name not in done:
            deps, text = VIEWS[name]
            for d in deps:
                need(d)
            done[name] = text

    for n in names.split():
        need(n)
    parts = [*done.items(), *(more or [])]
    return ("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({t})" for n, t in parts) + "\n" if parts else "") + body


def unrolled(name: str, first: str, step, n: int) -> list[tuple[str, str]]:
    """``name0`` .. ``name{n}``, each from the one before; ``step(previous, i)`` is its text."""
    out = [(f"{name}0", first)]
    for i in range(1, n + 1):
        out.append((f"{name}{i}", step(f"{name}{i - 1}", i)))
    return out


def product_sql(x: str) -> str:
    return f"(CASE WHEN max(CASE WHEN {x} >= 1 THEN 1 ELSE 0 END) = 1 THEN 1e0 ELSE 1 - exp(sum(CASE WHEN {x} < 1 THEN ln(1 - ({x})) END)) END)"
