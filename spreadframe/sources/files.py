"""Scans and sinks: text edge lists, cascade lines, graph stores, transition records."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..core import Graph

# --- edge lists


def read_pairs(spark: SparkSession, path: str, skip_rows: int = 0) -> DataFrame:
    """``src, dst`` from lines of two ids split by commas or white space.

    Comments (# or %), blank lines and lines without two numbers are dropped, further
    columns ignored; float-looking ids count as whole numbers. ``skip_rows`` header rows of each
    file go first. Reads what Spark's text reader opens, compressed files too.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    if skip_rows:
        lines = lines.withColumn("r", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where(F.col("r") > skip_rows)
    ids = lines.where("line <> '' and not line rlike '^[#%]'").select(*(F.expr(f"try_cast(try_cast(try_element_at(split(line, '[,\\\\s]+'), {i}) AS double) AS bigint)").alias(c) for i, c in ((1, "src"), (2, "dst"))))
    return ids.dropna()


def write_edge_list(graph: Graph, path: str) -> None:
    graph.edges.select("src", "dst").write.option("sep", " ").csv(path)


# --- cascade lines


def parse_cascade_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``cascade_id, root, publish_time, adopter, elapsed, parent, seq`` from tab-separated lines.

    Fields: id, root, publish time (a number, or an ISO date as its day), count, and paths
    ``a/b/c:elapsed``, where c adopts from b. A user's first path in the line counts; lines of
    fewer fields and paths without a time or with a bad one are dropped. Ids are strings.
    """
    f = F.split(column, "\t")
    # the fields are cut before the paths are laid out, so that a line is not split again for each of its paths
    fields = lines.where(F.size(f) >= 5).select(f[0].alias("cascade_id"), f[1].alias("root"), f[2].alias("published"), f[4].alias("paths"))
    rows = fields.select("cascade_id", "root", "published", F.posexplode(F.split("paths", " ")).alias("place", "path"))
    time = F.coalesce(F.expr("try_cast(published AS bigint)"), F.datediff(F.expr("try_cast(published AS date)"), F.lit("1970-01-01")).cast("long"))
    hop = F.split(F.substring_index("path", ":", 1), "/")
    parsed = rows.where("path like '%:%'").select("cascade_id", "root", time.alias("publish_time"), "place", F.element_at(hop, -1).alias("adopter"), F.when(F.size(hop) > 1, F.element_at(hop, -2)).alias("parent"), F.expr("try_cast(substring_index(path, ':', -1) AS bigint)").alias("elapsed"))
    ok = parsed.where("elapsed is not null and publish_time is not null and adopter <> ''")
    first = ok.withColumn("r", F.row_number().over(Window.partitionBy("cascade_id", "adopter").orderBy("place"))).where("r = 1")
    seq = F.row_number().over(Window.partitionBy("cascade_id").orderBy("elapsed", "place")) - 1
    return first.select("cascade_id", "root", "publish_time", "adopter", "elapsed", "parent", seq.cast("long").alias("seq"))


def read_cascades(spark: SparkSession, path: str) -> DataFrame:
    return parse_cascade_lines(spark.read.text(path))


def write_cascades(adoptions: DataFrame, path: str) -> None:
    """Lines that :func:`read_cascades` reads, from ``cascade_id, publish_time, adopter, elapsed, seq, parent``.

    A line holds its cascade whole, as the format wants it; paths name an adopter and its parent.
    """
    hop = F.concat(F.concat_ws("/", F.col("parent").cast("string"), F.col("adopter").cast("string")), F.lit(":"), F.col("elapsed").cast("string"))
    one = adoptions.groupBy("cascade_id").agg(F.min_by("adopter", "seq").cast("string").alias("root"), F.min("publish_time").cast("string").alias("published"), F.count("*").cast("string").alias("n"), F.array_sort(F.collect_list(F.struct("seq", hop.alias("hop")))).alias("hops"))
    one.select(F.concat_ws("\t", "cascade_id", "root", "published", "n", F.concat_ws(" ", F.col("hops.hop"))).alias("value")).write.text(path)


def published_in(df: DataFrame, first_hour: int | None = None, last_hour: int | None = None, month: int | None = None, year: int | None = None) -> DataFrame:
    """Cascades by hour of day, month and year of their publish time (seconds since 1970, UTC)."""
    ts = F.timestamp_seconds("publish_time")
    cond = F.lit(True)
    if first_hour is not None:
        cond = cond & F.hour(ts).between(first_hour, 23 if last_hour is None else last_hour)
    if month is not None:
        cond = cond & (F.month(ts) == month)
    if year is not None:
        cond = cond & (F.year(ts) == year)
    return df.where(cond)


# --- graph store


def save_graph(graph: Graph, graph_id: str, path: str) -> None:
    """Append one graph to a store partitioned by graph_id."""
    graph.edges.select("src", "dst", "ic_p", F.lit(graph_id).alias("graph_id")).write.mode("append").partitionBy("graph_id").parquet(f"{path}/edges")
    graph.nodes.select("node", F.lit(graph_id).alias("graph_id")).write.mode("append").partitionBy("graph_id").parquet(f"{path}/nodes")


def load_graph(spark: SparkSession, path: str, graph_id: str) -> Graph:
    """One graph of a store; only its partition is read."""
    at = lambda t: spark.read.parquet(f"{path}/{t}").where(F.col("graph_id") == graph_id).drop("graph_id")
    return Graph(at("nodes"), at("edges"))


# --- transitions

_LONGS = T.ArrayType(T.LongType())
_STATE = T.StructType([T.StructField(n, t) for n, t in (("infected", _LONGS), ("frontier", _LONGS), ("infected_count", T.IntegerType()), ("frontier_count", T.IntegerType()), ("pos_infected", _LONGS), ("pos_frontier", _LONGS), ("exposed", _LONGS), ("recovered", _LONGS))])
_MARGINAL = T.MapType(T.StringType(), T.DoubleType())
_ACTION = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("target", T.LongType()), T.StructField("destination", T.LongType()), T.StructField("weight", T.DoubleType())]))
#: One transition of an episode; fields that a layout does not have are null.
TRANSITION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("graph_id", "diffusion_model", "episode_id", "algorithm", "branch")]
    + [T.StructField("t", T.IntegerType()), T.StructField("state", _STATE), T.StructField("action", _ACTION), T.StructField("next_state", _STATE), T.StructField("reward", T.DoubleType())]
    + [T.StructField(f"next_marginal_{n}", _MARGINAL) for n in ("infected", "frontier", "pos_infected", "pos_frontier", "incidence", "exposed", "infectious", "recovered")]
    + [T.StructField("negative_seeds", _LONGS), T.StructField("parents", T.MapType(T.StringType(), _LONGS))]
)


def write_transitions(records: DataFrame, path: str) -> None:
    """JSON lines, a folder for each diffusion_model and split."""
    records.withColumn("model", F.col("diffusion_model")).write.mode("append").partitionBy("model", "split").json(path)


def read_transitions(spark: SparkSession, path: str, model: str | None = None, split: str | None = None) -> DataFrame:
    df = spark.read.schema(T.StructType([*TRANSITION.fields, T.StructField("model", T.StringType()), T.StructField("split", T.StringType())])).json(path)
    df = df if model is None else df.where(F.col("model") == model)
    return df if split is None else df.where(F.col("split") == split)


def transition_records(history: DataFrame, graph_id: str, model: str, algorithm: str) -> DataFrame:
    """Main-branch records of episodes from ``sample, node, t`` histories: states, new nodes, reward.

    A step's nodes are gathered into arrays here only, at the sink: a record holds its state whole.
    """
    last = history.groupBy("sample").agg(F.max("t").alias("last"))
    steps = last.select("sample", F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("t"))
    on = steps.join(history.select("sample", "node", F.col("t").alias("at")), "sample")
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("node"))))
    per = on.groupBy("sample", "t").agg(pick(F.col("at") <= F.col("t")).alias("infected"), pick(F.col("at") == F.col("t")).alias("frontier"), pick(F.col("at") <= F.col("t") + 1).alias("next_infected"), pick(F.col("at") == F.col("t") + 1).alias("next_frontier"))
    state = lambda i, f: F.struct(F.col(i).alias("infected"), F.col(f).alias("frontier"), F.size(i).alias("infected_count"), F.size(f).alias("frontier_count"))
    return per.select(F.lit(graph_id).alias("graph_id"), F.lit(model).alias("diffusion_model"), F.concat_ws("|", F.lit(graph_id), F.lit(model), F.lit(algorithm), F.concat(F.lit("r"), F.col("sample"))).alias("episode_id"), F.lit(algorithm).alias("algorithm"), F.lit("main").alias("branch"), "t", state("infected", "frontier").alias("state"), state("next_infected", "next_frontier").alias("next_state"), (F.size("next_infected") - F.size("infected")).cast("double").alias("reward"))


def split_membership(records: DataFrame) -> DataFrame:
    """``graph_id, splits``: how many splits a graph's records lie in."""
    return records.select("graph_id", "split").distinct().groupBy("graph_id").agg(F.count("*").alias("splits"))


def straddling_graphs(records: DataFrame) -> DataFrame:
    return split_membership(records).where("splits > 1").select("graph_id")


def episode_endpoints(records: DataFrame) -> DataFrame:
    """``episode_id, sources, final, final_marginal`` of main branches: what was added at step 0, and the last state."""
    main = records.where("branch = 'main'")
    first = main.where("t = 0").select("episode_id", F.transform(F.filter("action", lambda a: a["op"] == "add_node"), lambda a: a["target"]).alias("sources"))
    last = main.groupBy("episode_id").agg(F.max_by("next_state", "t").alias("s"), F.max_by("next_marginal_infected", "t").alias("final_marginal"))
    return last.join(first, "episode_id", "left").select("episode_id", "sources", F.col("s.infected").alias("final"), "final_marginal")


def episode_histories(records: DataFrame) -> DataFrame:
    """``episode_id, node, time``: the first step at which each node of a main branch is in the frontier."""
    main = records.where("branch = 'main'")
    now = main.select("episode_id", F.col("t"), F.explode("state.frontier").alias("node"))
    nxt = main.select("episode_id", (F.col("t") + 1).alias("t"), F.explode("next_state.frontier").alias("node"))
    return now.unionByName(nxt).groupBy("episode_id", "node").agg(F.min("t").alias("time"))


def dataset_checks(records: DataFrame) -> DataFrame:
    """One row: share of transitions that keep all infected nodes, reward moments, final sizes."""
    keep = F.size(F.array_except("state.infected", "next_state.infected")) == 0
    return records.agg(F.count("*").alias("records"), F.avg(keep.cast("double")).alias("monotone"), F.avg("reward").alias("mean_reward"), F.stddev_samp("reward").alias("std_reward"), F.max(F.size("next_state.infected")).alias("largest"))


# --- result relations


def write_summary(results: DataFrame, path: str) -> None:
    """Result rows in (budget, condition, arm) order as CSV and JSON; a report has some hundreds of rows."""
    rows = results.orderBy("budget", "condition", "arm").coalesce(1)
    rows.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    rows.write.mode("overwrite").json(f"{path}/json")


def parse_arm(spec: Column) -> list[Column]:
    """method, mode and evaluator of an arm written ``method_mode@evaluator``."""
    part = lambda i: F.nullif(F.regexp_extract(spec, r"^(.+?)_([a-z]+)(?:@(.+))?$", i), F.lit(""))
    return [part(1).alias("method"), part(2).alias("mode"), part(3).alias("evaluator")]


def expected_change(script: Column) -> Column:
    """The number after ``# EXPECTED: Δ`` in a script, null without one."""
    found = F.regexp_extract(script, r"# EXPECTED:\s*Δ?\s*([+-]?[0-9]*\.?[0-9]+)", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def markdown(results: DataFrame, title: str, most: int = 500) -> str:
    """A markdown table of a small relation; more than ``most`` rows are refused."""
    rows = results.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("a report is for small relations")
    head = "| " + " | ".join(results.columns) + " |\n|" + "---|" * len(results.columns)
    return f"## {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows) + "\n"


def environment_record(spark: SparkSession) -> str:
    """Provenance as JSON: versions and the settings that results depend on."""
    return json.dumps({"spark": spark.version, "timezone": spark.conf.get("spark.sql.session.timeZone"), "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}, sort_keys=True)
