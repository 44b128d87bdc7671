"""Effects of actions and action logs against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadframe.functions.coins import coin
from spreadframe.operators import effects, plan_checks

from .test_graph_operators import graph, ids


def test_effect_scores_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [(s, a, n, rng.choice([0.1, 0.2, rng.random()]), rng.choice([0.1, 0.1004, rng.random()])) for s in range(4) for a in range(9) for n in range(3) if rng.random() < 0.9]
    df = spark.createDataFrame(rows + [(9, 1, 1, None, 0.3)], "state long, action long, node long, predicted double, true double")
    got = effects.counterfactual_effect(df).first()
    dp, dt = [], []
    for x, y in itertools.combinations(sorted(rows, key=lambda r: r[1]), 2):
        if x[0] == y[0] and x[2] == y[2] and x[1] != y[1]:
            dp.append(x[3] - y[3])
            dt.append(x[4] - y[4])
    dp, dt = np.array(dp), np.array(dt)
    real = np.abs(dt) > effects.NOISE
    assert got["scored"] == len(dp)
    assert got["pearson"] == pytest.approx(np.corrcoef(dp, dt)[0, 1])
    assert got["mae"] == pytest.approx(np.abs(dp - dt).mean())
    assert got["magnitude_ratio"] == pytest.approx(np.abs(dp).mean() / np.abs(dt).mean())
    assert got["sign_agree"] == pytest.approx((np.sign(dp[real]) == np.sign(dt[real])).mean())


def test_effect_of_nothing(spark):
    got = effects.counterfactual_effect(spark.createDataFrame([(1, 1, 1, 0.1, 0.2)], "state long, action long, node long, predicted double, true double")).first()
    assert (got["pairs"], got["scored"], got["pearson"], got["mae"], got["sign_agree"]) == (0, 0, None, None, None)


def test_derangement_gives_every_action_away_once(spark):
    rows = [(i, i % 3 if i < 300 else 7, i) for i in range(301)]
    df = spark.createDataFrame(rows, "rec long, grp long, action long")
    got = effects.deranged(df, coin(F.col("rec"), 1), ["rec"], by=["grp"]).collect()
    assert all(r["swapped"] != r["action"] for r in got if r["grp"] != 7) and [r["swapped"] for r in got if r["grp"] == 7] == [None]
    for g in range(3):
        mine = [r for r in got if r["grp"] == g]
        assert sorted(r["swapped"] for r in mine) == sorted(r["action"] for r in mine)


def test_ablation_of_a_model_that_ignores_or_reads_actions(spark):
    df = spark.range(200).select(F.col("id").alias("rec"), (F.col("id") % 2).alias("action"), (F.col("id") % 2).cast("double").alias("y"))
    run = lambda p: {r["arm"]: r for r in effects.action_ablation(df, lambda d: d.withColumn("p", p), coin(F.col("rec"), 2), ["rec"]).collect()}
    blind = run(F.lit(0.4))
    assert all(r["brier_rise"] == 0 and r["f1_drop"] == 0 for r in blind.values())
    sharp = run(F.coalesce(F.col("action").cast("double"), F.lit(0.5)))
    assert sharp["null"]["brier_rise"] == 0.25 and 0.3 < sharp["shuffle"]["brier_rise"] < 0.7


LOG = [
    ("a", 0, 1, "remove_node", 1, None, None), ("a", 0, 2, "remove_node", 0, None, None), ("a", 1, 1, "remove_node", 1, None, None), ("a", 1, 2, "add_node", 2, None, None), ("a", 2, 1, "remove_node", 9, None, None),
    ("a", 2, 2, "set_edge_weight", 0, 1, 0.4), ("a", 2, 3, "set_edge_weight", 0, 1, 0.9), ("a", 2, 4, "set_edge_weight", 3, 0, 0.1), ("a", 3, 1, "remove_node", 2, None, None), ("a", 3, 2, "remove_node", 3, None, None), ("b", 0, 1, "remove_node", 3, None, None),
]


def log(spark):
    return spark.createDataFrame(LOG, "plan string, t long, seq long, op string, target long, destination long, weight double")


def test_refusals_in_order(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 3)], 4, p=0.5)
    got = plan_checks.checked_actions(log(spark), g.nodes, g.edges, ["remove_node", "set_edge_weight"], "remove_node", 3, ids(spark, 0))
    assert [(r["reason"], r["spent"]) for r in got.orderBy("plan", "t", "seq").collect()] == [(None, 1), ("protected", 2), ("repeat", 2), ("op", 2), ("range", 3), (None, 3), ("weight", 3), ("arc", 3), ("budget", 4), ("budget", 5), (None, 1)]
    assert [tuple(r) for r in plan_checks.plan_verdicts(got).orderBy("plan").collect()] == [("a", False, 0, 2, "protected", 5), ("b", True, None, None, None, 1)]


def test_removals_take_their_arcs_along(spark):
    g = graph(spark, [(0, 1), (1, 2)], 3)
    one = log(spark).where("plan = 'a' and t = 0")
    rows = plan_checks.expanded_actions(one, g.edges)
    got = [(r["op"], r["target"], r["destination"]) for r in rows.orderBy("seq", "sub").collect()]
    assert got == [("remove_node", 1, None), ("remove_edge", 1, 0), ("remove_edge", 0, 1), ("remove_edge", 1, 2), ("remove_edge", 2, 1), ("remove_node", 0, None)]
    again = plan_checks.expanded_actions(rows, g.edges).select("op", "target", "destination")
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.select("op", "target", "destination").collect()))
    assert plan_checks.expanded_actions(one, g.edges, isolate=True).where("op = 'remove_node'").count() == 0


def test_plans_are_filled(spark):
    picks = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 0), ("a", 4, 6), ("b", 1, 4), ("b", 2, 3), ("b", 3, 2), ("b", 4, 1)], "plan string, rank long, node long")
    scores = spark.createDataFrame([(i, float(10 - i)) for i in range(8)], "node long, score double")
    got = plan_checks.filled_plans(picks, scores, 3, ids(spark, 0)).orderBy("plan", "turn").collect()
    assert [(r["plan"], r["node"]) for r in got] == [("a", 5), ("a", 6), ("a", 1), ("b", 4), ("b", 3), ("b", 2)]
    assert [(r["plan"], r["node"]) for r in plan_checks.targets_in_order(log(spark)).orderBy("plan", "turn").collect()] == [("a", 1), ("a", 0), ("a", 9), ("a", 2), ("a", 3), ("b", 3)]


def test_weak_runs_and_persistence(spark):
    weak = {"x": [0, 1, 1, 0, 1, 1], "y": [1, 1, 1, 1, 1, 1], "z": [0, 0, 0, 1, 0, 1]}
    df = spark.createDataFrame([(r, t, t / 10, bool(w)) for r, ws in weak.items() for t, w in enumerate(ws)], "region string, turn long, coverage double, weak boolean")
    assert sorted((r["region"], r["first"], r["last"], r["turns"]) for r in plan_checks.weak_runs(df).collect()) == [("x", 1, 2, 2), ("x", 4, 5, 2), ("y", 0, 5, 6), ("z", 3, 3, 1), ("z", 5, 5, 1)]
    assert {r["region"]: r["max_coverage"] for r in plan_checks.persistent_weakness(df, 2).collect()} == {"x": 0.5, "y": 0.5}
    assert plan_checks.persistent_weakness(df, 7).count() == 0


def test_expanded_removals_send_neighbours_in_lists(spark):
    """Each pair of a step once, with the earliest of what removes it, and no exchange of rows a pair."""
    from spreadframe.operators import plan_checks

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "src long, dst long")
    log = spark.createDataFrame(
        [("p", 0, 5, "remove_node", 1, None), ("p", 0, 3, "remove_node", 2, None), ("p", 0, 4, "remove_edge", 1, 2), ("p", 0, 2, "remove_edge", 3, 1), ("p", 0, 7, "remove_node", 2, None), ("p", 1, 8, "remove_edge", 2, None), ("p", 1, 9, "remove_edge", 4, 4), ("p", 1, 1, "add_node", 9, 9)],
        "plan string, t long, seq long, op string, target long, destination long",
    )
    got = plan_checks.expanded_actions(log, edges)
    want = {
        (0, 5, 0, "remove_node", 1, None), (0, 3, 0, "remove_node", 2, None),
        (0, 3, 3, "remove_edge", 2, 1), (0, 3, 4, "remove_edge", 1, 2), (0, 3, 7, "remove_edge", 2, 3), (0, 3, 8, "remove_edge", 3, 2), (0, 2, 0, "remove_edge", 3, 1), (0, 5, 7, "remove_edge", 1, 3),
        (1, 8, 0, "remove_edge", 2, None), (1, 9, 0, "remove_edge", 4, 4), (1, 1, 0, "add_node", 9, None),
    }
    rows = [(r["t"], r["seq"], r["sub"], r["op"], r["target"], r["destination"]) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(plan" in plan and not any("Exchange" in line and "lo#" in line for line in plan.splitlines())
    assert any("Exchange" in line and "REPARTITION_BY_NUM" in line for line in plan.splitlines())
