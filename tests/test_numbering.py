"""Places and running values over ranges equal those of a plain pass, with ties, nulls and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from spreadframe.core import numbered, over_earlier
from spreadframe.operators import metrics


def drawn(spark, n, parts=7):
    draw = random.Random(n)
    data = [(i, draw.choice([None, 1.0, 1.0, 2.0, draw.random() * 9]), draw.randint(0, 50)) for i in range(n)]
    return data, spark.createDataFrame(data, "id int, x double, v int").repartition(parts)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_places_follow_the_order(spark, n):
    data, df = drawn(spark, n)
    want = sorted(data, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
    got = {r["id"]: r["place"] for r in numbered(df, [F.desc_nulls_first("x"), F.asc("id")]).collect()}
    assert got == {r[0]: i for i, r in enumerate(want)}


@pytest.mark.parametrize("of, plain", [(F.sum, sum), (F.max, max)])
def test_earlier_values(spark, of, plain):
    data, df = drawn(spark, 300)
    got = {r["id"]: r["got"] for r in over_earlier(df, [F.desc("id")], F.col("v"), "got", of).collect()}
    assert got == {i: plain(data[j][2] for j in range(i + 1, 300)) if i < 299 else None for i in range(300)}


def test_ranks_without_groups_equal_ranks_within_one(spark):
    _, df = drawn(spark, 400)
    df = df.withColumn("g", F.lit(1))
    assert metrics.spearman(df, "x", "v").first()["rho"] == pytest.approx(metrics.spearman(df, "x", "v", ["g"]).first()["rho"])


def test_mean_gap_of_sorted_samples(spark):
    data = [(float(a), float(b)) for a, b in zip(random.Random(1).sample(range(900), 60), random.Random(2).sample(range(900), 60))]
    got = metrics.wasserstein(spark.createDataFrame(data, "a double, b double").repartition(5), "a", "b").first()["w1"]
    assert got == pytest.approx(sum(abs(x - y) for x, y in zip(sorted(a for a, _ in data), sorted(b for _, b in data))) / 60)
