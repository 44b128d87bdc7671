import math

from pyspark.sql import functions as F

from spreadframe.operators import cascades, metrics, ranking
from spreadframe.sources import files
from spreadframe.streaming import live


def test_auc_by_hand(spark):
    y = [1, 1, 0, 0, 0, 0]
    for scores, want in (([1.0] * 6, 0.5), ([1, 0.9, 0.1, 0.2, 0, 0.05], 1.0), ([0, 0.05, 1, 0.9, 0.5, 0.6], 0.0)):
        df = spark.createDataFrame([(float(s), bool(t)) for s, t in zip(scores, y)], "score double, y boolean")
        assert metrics.roc_auc(df).first()["auc"] == want
    assert metrics.roc_auc(df.where("y")).first()["auc"] is None


def test_popularity_by_hand(spark):
    df = spark.createDataFrame([(4.0, 2, 1), (16.0, 8, 4)], "predicted double, actual long, observed long")
    m = metrics.popularity(df).first()
    assert abs(m["msle"] - 1) < 1e-12 and abs(m["male"] - 1) < 1e-12 and abs(m["msle_natural"] - math.log(2) ** 2) < 1e-12 and m["mrse"] == 1 and m["wrong"] == 1 and m["doubling"] == 1
    ids = df.withColumn("id", F.col("actual"))
    assert metrics.coverage_at_k(ids).first()["coverage"] is None
    forty = spark.range(1, 41).select("id", F.col("id").alias("predicted"), F.col("id").alias("actual"))
    assert metrics.coverage_at_k(forty).first()["coverage"] == 1
    declined = df.unionByName(spark.createDataFrame([(None, 5, 2)], df.schema))
    assert abs(metrics.popularity(declined).first()["decline_rate"] - 1 / 3) < 1e-12


def test_curves_by_hand(spark):
    c = spark.createDataFrame(list(enumerate([0.0, 2.0, 6.0, 14.0, 25.0, 18.0, 9.0, 4.0, 1.0, 0.0])), "t int, value double")
    m = metrics.epidemic_curve(c).first()
    assert (m["peak"], m["time_to_peak"], m["area"]) == (25, 4, 79)
    flat = spark.range(20).select(F.col("id").cast("int").alias("t"), F.when(F.col("id") < 10, 10.0).otherwise(4.0).alias("value"))
    assert metrics.epidemic_curve(flat).first()["endemic"] == 4.0


def test_f1_and_mcc_where_nothing_is_true(spark):
    df = spark.createDataFrame([(False, False)] * 3, "a boolean, b boolean")
    assert metrics.binary_f1(df, "a", "b").first()["f1"] == 1.0 and metrics.matthews(df, "a", "b").first()["mcc"] == 0.0


def test_spearman_of_reversed_ranks(spark):
    df = spark.range(10).select(F.col("id").alias("a"), (-F.col("id")).alias("b"), F.lit(1).alias("c"))
    assert abs(metrics.spearman(df, "a", "b").first()["rho"] + 1) < 1e-12
    assert metrics.spearman(df, "a", "c").first()["rho"] == 0.0


def test_pareto_front_with_missing_values(spark):
    p = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 3.0, None), ("d", 2.0, 2.0)], "name string, x double, y double")
    got = {r["name"]: r["dominated_by"] for r in ranking.pareto_front(p, {"x": "max", "y": "max"}).collect()}
    assert got == {"a": 2, "b": 0, "c": 0, "d": 0}
    assert ranking.hypervolume(p.where("y is not null"), "x", "y", (0.0, 0.0)).first()[0] == 4.0


def test_search_history(spark):
    h = spark.createDataFrame([(i, float(b)) for i, b in enumerate([1, 2, 2, 2, 3, 3])], "step int, best double")
    assert ranking.flat_generations(h).first()["flat"] == 1
    assert {r["step"]: r["status"] for r in ranking.stagnation(h, 2).collect()} == {0: "WARMING_UP", 1: "WARMING_UP", 2: "IMPROVING", 3: "STAGNANT", 4: "IMPROVING", 5: "IMPROVING"}


def corpus(spark):
    rows = [(f"c{i:02d}", 100 * i, (i + s) % 30 + 5 if s else i % 30, 10 * s, s) for i in range(60) for s in range(12)]
    return spark.createDataFrame(rows, "cascade_id string, publish_time long, adopter long, elapsed long, seq long").withColumn("parent", F.when(F.col("seq") > 0, F.col("adopter") * 0))


def test_chronological_split_leaks_nothing(spark):
    s = cascades.assign_splits(corpus(spark).select("cascade_id", "publish_time").distinct(), 200).collect()
    first = min(r["publish_time"] for r in s if r["split"] == "test")
    assert all(r["publish_time"] + 200 <= first for r in s if r["split"] == "train") and sum(r["split"] == "test" for r in s) == 9


def test_binning_forces_the_root_and_drops_the_late(spark):
    b = cascades.bin_events(corpus(spark).where("cascade_id = 'c00'"), 30, 3)
    assert {r["node"]: r["t"] for r in b.collect()}[0] == 0 and b.agg(F.max("t")).first()[0] == 2
    assert b.count() == 9
    r = cascades.replay(b).orderBy("t").collect()
    assert [x["infected"] for x in r] == [3, 6, 9] and [x["frontier"] for x in r] == [3, 3, 3]


def test_forecasts_decline_above_one(spark):
    w = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 4), ("b", 0, 8), ("b", 1, 4), ("b", 2, 2)], "cascade_id string, t long, n long")
    got = {r["cascade_id"]: r["predicted"] for r in cascades.branching_factor(w).collect()}
    assert got["a"] is None and got["b"] == 14 + 2 * 0.5 / 0.5


def test_edge_list_lines(spark, tmp_path):
    (tmp_path / "e.txt").write_text("src dst\n# note\n% note\n\n1 2 0.5\n3,4\n5.0\t6\nx y\n7\n")
    assert {(r["src"], r["dst"]) for r in files.read_pairs(spark, str(tmp_path / "e.txt"), 1).collect()} == {(1, 2), (3, 4), (5, 6)}


def test_cascade_lines(spark):
    lines = ["c1\tu\t100\t3\tu:0 u/v:5 u/v/w:9 u/v:3", "c2\tu\t2016-01-02\t1\tu:0 noproblem x:bad", "short\tline", ""]
    got = files.parse_cascade_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["adopter"], r["elapsed"], r["parent"], r["seq"]) for r in sorted(got, key=lambda r: (r["cascade_id"], r["seq"])) if r["cascade_id"] == "c1"] == [("u", 0, None, 0), ("v", 5, "u", 1), ("w", 9, "v", 2)]
    assert [r["publish_time"] for r in got if r["cascade_id"] == "c2"] == [16802]


def test_stores_round_trip(spark, tmp_path):
    from spreadframe.core import Graph

    g = Graph(spark.range(3).withColumnRenamed("id", "node"), spark.createDataFrame([(0, 1, 0.5)], "src long, dst long, ic_p double"))
    files.save_graph(g, "g1", str(tmp_path / "s"))
    assert files.load_graph(spark, str(tmp_path / "s"), "g1").edges.count() == 1
    h = spark.createDataFrame([(0, 0, 0), (0, 1, 1)], "sample int, node long, t int")
    rec = files.transition_records(h, "g1", "ic", "degree").withColumn("split", F.lit("train"))
    files.write_transitions(rec, str(tmp_path / "t"))
    back = files.read_transitions(spark, str(tmp_path / "t"), "ic", "train")
    assert back.count() == 2 and back.orderBy("t").first()["reward"] == 1.0
    assert {r["node"]: r["time"] for r in files.episode_histories(back).collect()} == {0: 0, 1: 1}
    assert files.straddling_graphs(back).count() == 0 and files.dataset_checks(back).first()["monotone"] == 1.0


def test_report_pieces(spark):
    df = spark.createDataFrame([("celf_auto@mc", "# EXPECTED: Δ +1.5"), ("plain", "none")], "arm string, script string")
    got = df.select(*files.parse_arm(F.col("arm")), files.expected_change(F.col("script")).alias("e")).collect()
    assert (got[0]["method"], got[0]["mode"], got[0]["evaluator"], got[0]["e"]) == ("celf", "auto", "mc", 1.5) and got[1]["e"] is None
    assert files.markdown(df.select("arm"), "t").startswith("## t")


def test_live_counts_equal_the_batch_answer(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet").select("ts", "user_id", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    live.adoption_counts(stream).writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = {tuple(r) for r in events.withColumn("w", F.window("ts", "30 minutes")).groupBy("event_type", F.col("w.start").alias("start")).agg(F.count_distinct("user_id").alias("n")).collect()}
    got = {tuple(r) for r in spark.table("counts").collect()}
    assert got <= want and len(got) > 0.9 * len(want)
    assert live.sessions(events).count() > 0


def test_degrees_join_the_orders_once_and_weigh_no_arc(spark, tiny):
    from spreadframe.plans import catalog

    plan = catalog.compute_degree(spark, tiny)._jdf.queryExecution().toString()
    assert "l_orderkey" not in plan and "ic_p" not in plan
