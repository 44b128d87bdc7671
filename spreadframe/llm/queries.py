"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, conversations, licences, mixing, nearest, neardup_vectors, packing, pii, rans, sharding, simhash, substrings, toxicity


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score_toxicity(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.vector_groups(_table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file())


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.token_files_roundtrip(_table(spark, sf_dir, "documents"), tokenizer_file())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_rows(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return sharded.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), "law", "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "pii")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(conversations.repair_conversations(conversations.damage(_table(spark, sf_dir, "conversations"))))


def digested(repairs: DataFrame) -> DataFrame:
    """Repaired conversations with the hash of their turns in place of them."""
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return repairs.withColumn("repaired_sha256", F.sha2(F.concat_ws("\n", lines).cast("binary"), 256)).drop("repaired")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda g: F.when(g == "", "").otherwise(F.sha2(g.cast("binary"), 256))
    return alignment.align_tokens(_table(spark, sf_dir, "documents"), tokenizer_file(), piece_file(), digest).withColumnRenamed("groups", "groups_sha256")


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_nearest, op2_licences, op3_mixing, op4_toxicity, op5_vector_near_dedup, op6_packing, op7_token_files, op8_sharding, op9_pii, op10_simhash, op11_conversations, op12_alignment, op13_substrings)}
OP3_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
drawn AS (SELECT *, (CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || CAST(size AS VARCHAR)), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u FROM sized),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (WHERE size > 0) AS docs FROM sized GROUP BY 1),
weighted AS (SELECT *, CAST(list_value(3, 1, 2)[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS weight FROM totals),
levels AS (SELECT *, (1.5e0 * sum(source_size) OVER () - 2e0 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER w AS place
  FROM weighted WINDOW w AS (ORDER BY source_size / weight, source IS NULL, source)),
fulls AS (SELECT *, 2e0 * source_size <= weight * level AS is_full FROM levels),
targets AS (SELECT source, source_size, docs, CASE WHEN is_full OR (SELECT count(*) FROM fulls WHERE NOT is_full) = 0 THEN 2e0 * source_size ELSE weight * (SELECT level FROM fulls WHERE NOT is_full ORDER BY place LIMIT 1) END AS target FROM fulls),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS goal FROM targets),
ranked AS (SELECT d.doc_id, d.size, p.*, (d.u / (1 - d.u)) / ((p.goal / p.source_size) / (1 - p.goal / p.source_size) * (d.size / (p.source_size / p.docs))) AS odds FROM drawn d JOIN plan p ON p.source IS NOT DISTINCT FROM d.source WHERE d.size > 0 AND p.goal > 0),
running AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far FROM ranked),
missing AS (SELECT source, max(goal) - coalesce(max(CASE WHEN so_far <= goal THEN so_far END), 0) AS missing FROM running GROUP BY 1),
filler AS (SELECT source, doc_id FROM (SELECT r.source, r.doc_id, abs(m.missing - r.size) AS off, m.missing, row_number() OVER (PARTITION BY r.source ORDER BY abs(m.missing - r.size), r.odds, r.doc_id) AS k FROM running r JOIN missing m ON m.source IS NOT DISTINCT FROM r.source WHERE r.so_far > r.goal) WHERE k = 1 AND off < missing),
extra AS (SELECT source, doc_id FROM running WHERE so_far <= goal UNION ALL SELECT * FROM filler)
SELECT d.doc_id, d.size, p.source_size, p.target, CAST((p.whole + CASE WHEN e.doc_id IS NOT NULL THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM drawn d JOIN plan p ON p.source IS NOT DISTINCT FROM d.source LEFT JOIN extra e ON e.doc_id = d.doc_id
"""
ORACLES: dict[str, str] = {"op3_mixing": OP3_SQL}
