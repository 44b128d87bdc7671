"""The corrected forecast against a plain ridge of the other folds."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spreadframe.operators import cascades

WINDOW = 4


def inputs(spark, n, seed=5):
    rng = random.Random(seed)
    waves = [(f"c{i}", t, rng.choice([0, 1, 2, 3, 5]) if t else 1 + rng.randrange(4)) for i in range(n) for t in range(WINDOW)]
    feats = [(f"c{i}", *([float(sum(w[2] for w in waves if w[0] == f"c{i}"))] + [rng.random() for _ in cascades.FEATURES[1:]])) for i in range(n)]
    finals = [(f"c{i}", rng.choice([None, 0, 9, 30, 80]) if i % 5 == 0 else 5 + rng.randrange(60)) for i in range(n)]
    return (
        spark.createDataFrame(feats, "cascade_id string, " + ", ".join(f"{f} double" for f in cascades.FEATURES)),
        spark.createDataFrame(waves, "cascade_id string, t long, n long"),
        spark.createDataFrame(finals, "cascade_id string, final long"),
    )


def test_correction_equals_a_plain_ridge(spark):
    feats, waves, finals = inputs(spark, 60)
    core = {r["cascade_id"]: r["predicted"] for r in cascades.hawkes(waves).collect()}
    shape = {r["cascade_id"]: (r["ratio"] or 0.0, r["decay"]) for r in cascades.hawkes_decay(waves).collect()}
    rows = {r["cascade_id"]: [r[f] for f in cascades.FEATURES] for r in feats.collect()}
    final = {r["cascade_id"]: r["final"] for r in finals.collect()}
    fold = lambda c: zlib.crc32(c.encode()) % 5
    x = {c: np.array([*rows[c], *shape[c], math.log(max(core[c], 1.0)), 1.0]) for c in rows if core[c] is not None}
    got = {r["cascade_id"]: r["predicted"] for r in cascades.hawkes_hybrid(feats, waves, finals).collect()}
    assert set(got) == set(rows) and any(v is None for v in core.values())
    for c in rows:
        if core[c] is None:
            assert got[c] is None
            continue
        others = [o for o in x if fold(o) != fold(c) and (final[o] or 0) >= 1]
        a = np.array([x[o] for o in others])
        y = np.array([math.log(final[o]) - math.log(max(core[o], 1.0)) for o in others])
        w = np.linalg.solve(a.T @ a + np.diag([1.0] * (a.shape[1] - 1) + [0.0]), a.T @ y)
        assert got[c] == pytest.approx(max(rows[c][0], core[c] * math.exp(min(5, max(-5, x[c] @ w)))), rel=1e-6)


def test_few_or_no_known_sizes_leave_the_forecast(spark):
    feats, waves, finals = inputs(spark, 12)
    core = {r["cascade_id"]: r["predicted"] for r in cascades.hawkes(waves).collect()}
    for known in (finals.where("false"), finals.where("final >= 1").limit(3)):
        assert {r["cascade_id"]: r["predicted"] for r in cascades.hawkes_hybrid(feats, waves, known).collect()} == core
    assert cascades.hawkes_hybrid(feats.where("false"), waves, finals).count() == 0


def test_a_cascade_does_not_see_its_own_size(spark):
    feats, waves, finals = inputs(spark, 40)
    changed = finals.withColumn("final", F.when(F.col("cascade_id") == "c7", 5000).otherwise(F.col("final")))
    a, b = ({r["cascade_id"]: r["predicted"] for r in cascades.hawkes_hybrid(feats, waves, f).collect()} for f in (finals, changed))
    same = {c for c in a if zlib.crc32(c.encode()) % 5 == zlib.crc32(b"c7") % 5}
    assert all(a[c] == b[c] for c in same) and any(a[c] != b[c] for c in set(a) - same)
