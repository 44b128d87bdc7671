"""Evaluators and regrets by hand, and against plain Python over drawn graphs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spreadframe.functions.coins import ADD1, ADD2, MIX, PRIME, SALT, S, U, V
from spreadframe.operators import evaluators, regrets
from spreadframe.sources import files


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def plain_coin(u, v, sample, salt):
    h = (u * U + v * V + sample * S + SALT.get(salt, salt)) % PRIME * MIX % PRIME
    h = (h * h + ADD1) % PRIME
    return (h * h + ADD2) % PRIME / PRIME


# --- evaluators


def test_refused_sources_give_the_first_reason(spark):
    named = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), ("a", 3, 9), ("a", 4, 2), ("a", 5, 3), ("b", 1, 1)], "instance string, rank int, node long")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    budgets = spark.createDataFrame([("a", 4)], "instance string, budget int")
    got = rows(evaluators.source_refusals(named, nodes, budgets), "instance", "rank", "reason")
    assert got == [("a", 1, None), ("a", 2, "duplicate"), ("a", 3, "range"), ("a", 4, None), ("a", 5, "budget"), ("b", 1, "budget")]


def test_consistency_is_zero_for_a_perfect_explanation(spark):
    seen = spark.createDataFrame([(i, n, float(n < 2)) for i in (1, 2) for n in range(4)], "instance int, node long, y double")
    again = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (2, 0, 0.5), (2, 3, 0.25)], "instance int, node long, p double")
    named = spark.createDataFrame([(1, 1, 0)], "instance int, rank int, node long")
    got = {r["instance"]: r for r in evaluators.consistency(named, seen, again).collect()}
    assert got[1]["consistency"] == 0 and got[1]["n_named"] == 1 and got[1]["n_over"] == got[1]["n_under"] == 0
    assert got[2]["resim_error"] == pytest.approx((0.25 + 1 + 0.0625) / 4) and (got[2]["n_named"], got[2]["n_over"], got[2]["n_under"]) == (0, 1, 2)


def test_label_scores_equal_counting_pairs(spark):
    draw = random.Random(3)
    named, truth, want, n = [], [], {}, 9
    for i in range(12):
        picks, src = draw.sample(range(n), draw.randint(0, 5)), draw.sample(range(n), draw.randint(0, n))
        named += [(i, r + 1, v) for r, v in enumerate(picks)]
        truth += [(i, v) for v in src]
        score = {v: 1 / (r + 1) for r, v in enumerate(picks)}
        pairs = [(score.get(a, 0), score.get(b, 0)) for a in src for b in range(n) if b not in src]
        tp = len(set(picks) & set(src))
        p, r = tp / len(picks) if picks else 0, tp / len(src) if src else 0
        want[i] = (p, r, 2 * p * r / (p + r) if p + r else 0, sum((v in picks) == (v in src) for v in range(n)) / n, sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs) if pairs else None)
    totals = spark.createDataFrame([(i, n) for i in range(12)], "instance int, n_nodes long")
    got = evaluators.localization_labels(spark.createDataFrame(named, "instance int, rank int, node long"), spark.createDataFrame(truth, "instance int, node long"), totals)
    for row in got.collect():
        for name, value in zip(("precision", "recall", "f1", "accuracy", "auc"), want[row["instance"]]):
            assert row[name] == (None if value is None else pytest.approx(value)), (row, name)
    one = evaluators.means(got, ["auc", "f1"]).first()
    has = [w[4] for w in want.values() if w[4] is not None]
    assert one["instances"] == 12 and one["auc"] == pytest.approx(sum(has) / len(has))


def test_decoded_rows_are_refused_with_a_reason(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node long")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (4, 3, 1.0)], "src long, dst long, ic_p double")
    cases = [(9, 0, None, "range"), (0, 0, None, None), (1, 1, 0, None), (2, 2, 0, "arc"), (2, 8, 1, "horizon"), (2, None, 1, "horizon"), (2, -1, 1, "horizon"), (1, 2, None, "orphan"), (1, 0, 0, "early"), (1, 2, 77, "parent"), (4, 0, None, "hidden"), (3, 1, 4, "hidden_parent")]
    decoded = spark.createDataFrame([(i, n, t, p) for i, (n, t, p, _) in enumerate(cases)], "instance int, node long, time int, parent long")
    hidden = decoded.select("instance", F.lit(4).cast("long").alias("node"))
    got = {r["instance"]: r["reason"] for r in evaluators.decoded_refusals(decoded, nodes, edges, 5, hidden).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}
    assert evaluators.decoded_refusals(decoded, nodes, edges, 5).where("reason like 'hidden%'").count() == 0


def test_reward_falls_back_to_events_without_a_tree(spark):
    schema = "instance int, node long, time int, parent long"
    truth = spark.createDataFrame([(1, 0, 0, None), (1, 1, 1, 0), (1, 2, 2, 1), (2, 0, 0, None), (2, 1, 1, None), (3, 0, 0, None), (3, 1, 1, 0)], schema)
    decoded = spark.createDataFrame([(1, 0, 0, None), (1, 1, 1, 0), (1, 2, 1, 0), (2, 0, 0, None), (2, 1, 1, 0)], schema)
    got = {r["instance"]: r for r in evaluators.reconstruction_rewards(decoded, truth).collect()}
    assert got[1]["path_precision"] == got[1]["path_recall"] == 0.5 and got[1]["event_f1"] == pytest.approx(2 / 3) and got[1]["order_accuracy"] == 1
    assert got[1]["reward"] == pytest.approx(0.6 * 0.5 + 0.4 * 2 / 3)
    assert got[2]["path_precision"] is None and got[2]["reward"] == got[2]["event_f1"] == 1
    assert got[3]["reward"] == 0 == got[3]["path_precision"]


def test_forecasts_that_are_all_declined_are_infinitely_wrong(spark):
    df = spark.createDataFrame([("x", 4.0, 2, 1), ("x", 16.0, 4, 4), ("x", None, 5, 2), ("y", None, 5, 2), ("y", float("nan"), 7, 2)], "kind string, predicted double, actual long, observed long")
    got = {(r["kind"], r["metric"]): r for r in evaluators.forecast_rewards(df, by=["kind"]).collect()}
    assert got["x", "msle"]["reward"] == pytest.approx((1 + 4) / 2) and got["x", "msle"]["se"] == pytest.approx(math.sqrt(4.5 / 2)) and got["x", "msle"]["n_failed"] == 1
    assert got["x", "male_increment"]["reward"] == pytest.approx((math.log2(4) - math.log2(2) + math.log2(13) - math.log2(1)) / 2)
    assert got["x", "wroperc"]["reward"] == 1 and got["x", "mape"]["reward"] == pytest.approx(((math.log2(5) - math.log2(3)) / 2 + (math.log2(17) - math.log2(5)) / math.log2(6)) / 2)
    assert all(got["y", m]["reward"] == math.inf and got["y", m]["n_scored"] == 0 for m in evaluators.TERMS)
    with pytest.raises(ValueError):
        evaluators.forecast_terms(df, "nothing")
    assert evaluators.forecast_rewards(df.limit(0), by=["kind"]).count() == 0


# --- regrets


def drawn_graphs(spark, seed):
    draw = random.Random(seed)
    arcs = {(g, u, v): draw.choice([0.2, 0.5, 1.0]) for g in ("p", "q") for u in range(14) for v in range(14) if u != v and draw.random() < 0.15}
    edges = spark.createDataFrame([(g, u, v, p) for (g, u, v), p in arcs.items()], "graph_id string, src long, dst long, ic_p double")
    return arcs, edges, edges.select("graph_id", F.col("src").alias("node")).union(edges.select("graph_id", "dst")).distinct()


def groups(df, value="node"):
    out = {}
    for r in df.collect():
        out.setdefault((r["graph_id"], r["state"]), set()).add(r[value])
    return out


def test_gains_equal_plain_python(spark):
    arcs, edges, nodes = drawn_graphs(spark, 1)
    active = regrets.drawn_states(nodes, 3, 0.2).cache()
    candidates = regrets.drawn_candidates(nodes, active, 5).cache()
    on, open_ = groups(active), groups(candidates)
    assert len(on) == 6 and all(len(c) == 5 and not c & on[k] for k, c in open_.items())
    model = {(r["graph_id"], r["state"], r["node"]): r["predicted"] for r in regrets.predicted_gain(edges, active, candidates).collect()}
    truth = {(r["graph_id"], r["state"], r["node"]): r["truth"] for r in regrets.sampled_gain(edges, active, candidates, 6).collect()}
    for (g, s), picks in open_.items():
        out = lambda u, g=g: [(v, p) for (h, a, v), p in arcs.items() if h == g and a == u]
        def expected(start):
            miss = {}
            for u in start:
                for v, p in out(u):
                    miss[v] = miss.get(v, 1) * (1 - p)
            return len(start) + sum(1 - m for v, m in miss.items() if v not in start)
        def sampled(start):
            return sum(len(start | {v for u in start for v, p in out(u) if plain_coin(u, v, r, "arc") < p}) for r in range(6)) / 6
        base = on[g, s]
        for c in picks:
            assert model[g, s, c] == pytest.approx(expected(base | {c}) - expected(base), abs=1e-9)
            assert truth[g, s, c] == pytest.approx(sampled(base | {c}) - sampled(base))


@pytest.mark.parametrize("spreads", [True, False])
def test_prevention_equals_plain_python(spark, spreads):
    arcs, edges, nodes = drawn_graphs(spark, 2)
    active = regrets.drawn_states(nodes, 2, 0.1).cache()
    candidates = regrets.drawn_candidates(nodes, active, 4).cache()
    on = groups(active)

    def reach(g, start, blocker, r):
        side = {u: 0 for u in start} | ({blocker: 1} if blocker is not None else {})
        front = dict(side)
        for _ in range(3):
            new = {}
            for u, of in front.items():
                for (h, a, v), p in arcs.items():
                    if h == g and a == u and v not in side and (spreads or of == 0) and plain_coin(u, v, r, regrets.SIDES[of]) < p:
                        new[v] = max(new.get(v, 0), of)
            side |= new
            front = new
        return sum(of == 0 for of in side.values())

    for row in regrets.sampled_prevention(edges, active, candidates, 4, 3, spreads).collect():
        g, base, c = row["graph_id"], on[row["graph_id"], row["state"]], row["node"]
        assert row["truth"] == pytest.approx(sum(reach(g, base, None, r) - reach(g, base, c, r) for r in range(4)) / 4)


def test_choosers_fall_back_and_regrets_are_averaged_over_graphs(spark):
    judged = spark.createDataFrame([("p", 0, 1, 3.0, 0.1, 5, None), ("p", 0, 2, 1.0, 0.9, 9, None), ("p", 1, 1, 2.0, 0.5, 1, 1), ("p", 1, 2, 6.0, 0.5, 7, None), ("q", 0, 4, 0.0, None, 1, None)], "graph_id string, state int, node long, truth double, predicted double, degree long, near int")
    got = regrets.choice_regrets(judged, {"model": [F.col("predicted")], "near": [F.col("near"), F.col("degree")]})
    assert rows(got, "graph_id", "state", "chooser", "regret") == [("p", 0, "model", 2.0), ("p", 0, "near", 2.0), ("p", 1, "model", 4.0), ("p", 1, "near", 4.0), ("q", 0, "model", 0.0), ("q", 0, "near", 0.0)]
    assert rows(regrets.over_graphs(got), "chooser", "graphs", "mean", "std") == [("model", 2, 1.5, 1.5), ("near", 2, 1.5, 1.5)]
    assert regrets.choice_regrets(judged.limit(0), {"model": [F.col("predicted")]}).count() == 0


def test_written_cascades_are_read_back(spark, tmp_path):
    a = spark.createDataFrame([("x", 7, 1, 0, 0, None), ("x", 7, 2, 5, 1, 1), ("x", 7, 3, 5, 2, 2), ("y", 9, 4, 0, 0, None)], "cascade_id string, publish_time long, adopter long, elapsed long, seq long, parent long")
    files.write_cascades(a, str(tmp_path / "lines"))
    got = rows(files.read_cascades(spark, str(tmp_path / "lines")), "cascade_id", "root", "publish_time", "adopter", "elapsed", "parent", "seq")
    assert got == [("x", "1", 7, "1", 0, None, 0), ("x", "1", 7, "2", 5, "1", 1), ("x", "1", 7, "3", 5, "2", 2), ("y", "4", 9, "4", 0, None, 0)]


def test_a_cascade_line_is_cut_once_and_not_again_for_each_path(spark):
    lines = spark.createDataFrame([("c\t1\t5\t2\t1:0 1/2:3",)], "value string")
    plan = files.parse_cascade_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "value#" not in above and "value#" in below
