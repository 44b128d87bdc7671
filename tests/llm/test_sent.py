from pyspark.sql import functions as F

from spreadframe.llm import simhash, toxicity


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_signatures_are_not_broadcast(spark):
    # Spark sizes the exploded signatures like the fingerprints, some 64 times too low
    prints = spark.range(50).select((F.col("id") * 7919).alias("fp"))
    pairs = simhash.near_pairs(prints)
    assert "BroadcastHashJoin" not in plan(pairs)
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    values = [7919 * i for i in range(50)]
    assert found == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}


def test_tables_of_grams_are_not_broadcast(spark):
    grams = spark.createDataFrame([("all", g, 1, 2) for g in ("ab", "abc", "bcd", "xbc")], "part string, gram string, n_toxic long, n_ordinary long")
    # the only tables sent have a row for each part, or for each part and length
    assert plan(toxicity.shared_probabilities(grams)).count("BroadcastHashJoin") == 1
    assert plan(toxicity.log_ratios(grams)).count("BroadcastHashJoin") == 2
    model = spark.createDataFrame([("ab", 0.5)], "key string, value double")
    docs = spark.createDataFrame([(1, "ab abc")], "doc_id long, text string")
    assert "BroadcastHashJoin" not in plan(toxicity.joined_features(docs, model))
