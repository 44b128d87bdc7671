"""Graphs and cascades that the supplied tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import Graph
from ..operators.build import weighted_cascade


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs from each user to the next one in a day's events of one type."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    hops = e.select(F.lag("user_id").over(order).alias("src"), F.col("user_id").alias("dst"))
    return hops.where("src is not null and src <> dst").distinct()


def user_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_edges(weighted_cascade(user_arcs(spark, sf_dir)))


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``graph_id, src, dst, ic_p``: a graph of users for each type of event, arcs as in :func:`user_arcs`."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    hops = e.select(F.col("event_type").alias("graph_id"), F.lag("user_id").over(order).alias("src"), F.col("user_id").alias("dst"))
    arcs = hops.where("src is not null and src <> dst").distinct()
    heads = arcs.groupBy("graph_id", "dst").agg((1.0 / F.count("*")).alias("ic_p"))
    return arcs.join(heads, ["graph_id", "dst"]).select("graph_id", "src", "dst", "ic_p")


def customer_supplier_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs from customers to the suppliers of what they ordered (numbered from 1,000,000)."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).distinct()


def customer_supplier_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_edges(weighted_cascade(customer_supplier_arcs(spark, sf_dir)))


def nation_arcs(spark: SparkSession, sf_dir: str, keep: int = 3) -> DataFrame:
    """From each customers' nation to the ``keep`` nations that most of their goods come from."""
    o, li, c, s = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "supplier"))
    pairs = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    counted = pairs.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).count().where("src <> dst")
    return counted.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("count"), "dst"))).where(F.col("r") <= keep).select("src", "dst")


def nation_graph(spark: SparkSession, sf_dir: str) -> Graph:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    return Graph(nodes, weighted_cascade(nation_arcs(spark, sf_dir)))


def adoptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cascade_id, publish_time, adopter, elapsed (seconds), seq, parent: a day's first events of one type."""
    e = table(spark, sf_dir, "events").select((F.concat_ws("#", "event_type", F.to_date("ts").cast("string"))).alias("cascade_id"), "user_id", "ts", "event_id")
    first = e.withColumn("r", F.row_number().over(Window.partitionBy("cascade_id", "user_id").orderBy("ts", "event_id"))).where("r = 1")
    w = Window.partitionBy("cascade_id").orderBy("ts", "event_id")
    secs = F.unix_timestamp("ts")
    return first.select("cascade_id", F.first(secs).over(w).alias("publish_time"), F.col("user_id").alias("adopter"), (secs - F.first(secs).over(w)).alias("elapsed"), (F.row_number().over(w) - 1).cast("long").alias("seq"), F.lag("user_id").over(w).alias("parent"))
