"""Dominators counted by order against all pairs."""

import math

import numpy as np

from spreadframe.operators import ranking


def test_dominators_over_many_ranges_equal_all_pairs(spark):
    r = np.random.default_rng(4)
    values = [None, math.nan, math.inf, -0.0, 0.0, *np.round(r.normal(size=40), 1).tolist()]
    rows = [(i, values[a], values[b]) for i, (a, b) in enumerate(r.integers(0, len(values), (400, 2)).tolist())]
    df = spark.createDataFrame(rows, "name long, p double, c double").repartition(3)
    plan = ranking.pareto_front(df, {"p": "max", "c": "min"}, group=20)
    assert "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()
    # nan is above all numbers, also when its sign is turned
    place = lambda x: (1, 0.0) if math.isnan(x) else (0, x)
    signed = [None if p is None or c is None else (place(p), place(-c)) for _, p, c in rows]
    want = {i: 0 if a is None else sum(b is not None and b != a and b[0] >= a[0] and b[1] >= a[1] for b in signed) for i, a in enumerate(signed)}
    assert {x["name"]: x["dominated_by"] for x in plan.collect()} == want
