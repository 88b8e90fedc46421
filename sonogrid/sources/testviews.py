"""Annotations, spectrogram files, metrics and patches read out of the driver's tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000
TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def units(spark: SparkSession, d: str) -> DataFrame:
    """stem, bird_id, onset_ms, offset_ms, id (0 to 4) and ordinal."""
    onset = (F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / F.lit(6e8)
    return table(spark, d, "events").select(
        F.concat(F.lit("u"), "user_id").alias("stem"),
        F.concat(F.lit("b"), (F.col("user_id") % 7).cast("string")).alias("bird_id"),
        onset.alias("onset_ms"),
        (onset + F.col("value")).alias("offset_ms"),
        (F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1).alias("id"),
        F.col("event_id").alias("ordinal"),
    )


def specs(spark: SparkSession, d: str) -> DataFrame:
    """Spectrogram files: stem, bird_id, species and n_timebins."""
    return table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("stem"), F.col("source").alias("bird_id"), F.col("lang").alias("species"), F.col("n_chars").alias("n_timebins"), "doc_id")


def metrics(spark: SparkSession, d: str) -> DataFrame:
    """Runs and their scores."""
    li = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rank, lr = F.col("l_linenumber"), F.col("l_discount")
    name = F.concat_ws("_", F.col("p_brand"), F.col("l_orderkey").cast("string"), F.concat(F.lit("r"), rank.cast("string")), F.concat(F.lit("lr"), F.format_string("%.2f", lr)))
    return li.select(
        F.col("p_brand").alias("species"), F.col("l_suppkey").alias("bird"), F.col("l_returnflag").alias("probe_mode"), F.col("l_linestatus").alias("mode"),
        rank.alias("lora_rank"), lr.alias("lr"), F.when(F.col("l_quantity") == 50, "MAX").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("train_seconds"),
        (F.col("l_extendedprice") / 1100).alias("f1"), (F.col("l_tax") * 100).alias("fer"),
        (F.col("l_orderkey") % 3).alias("num_classes"), (F.col("l_partkey") % 3).alias("num_classes_train"), (F.col("l_suppkey") % 3).alias("num_classes_val"),
        name.alias("run_name"), F.col("l_orderkey").alias("run_id"),
    )


def patches(spark: SparkSession, d: str) -> DataFrame:
    """patch_ix, pos_id, bird, label (0 is silence: -1) and h."""
    label = F.when(F.col("label") == 0, -1).otherwise(F.col("label")).cast("bigint")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("patch_ix"), (F.col("vec_id") % 16).alias("pos_id"), (F.col("vec_id") % 8).alias("bird"), label.alias("label"), F.col("embedding").cast("array<double>").alias("h"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Snippets: species, recording, start and end (seconds), dst."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    start = F.floor(F.col("o_totalprice")).cast("bigint") % 600
    return o.select(F.col("c_mktsegment").alias("species"), F.concat(F.lit("XC"), F.col("o_custkey").cast("string")).alias("recording"), start.cast("double").alias("start"), (start + 1 + F.col("o_orderkey") % 30).cast("double").alias("end"), F.concat(F.lit("/clips/XC"), F.col("o_orderkey").cast("string"), F.lit(".WAV")).alias("dst"))


UNITS = """v_units AS (SELECT 'u' || user_id AS stem, 'b' || (user_id % 7) AS bird_id, (epoch_us(ts) - 1704067200000000) / 6e8::DOUBLE AS onset_ms,
  (epoch_us(ts) - 1704067200000000) / 6e8::DOUBLE + value AS offset_ms, (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::BIGINT AS id, event_id AS ordinal FROM events)"""
SPECS = "v_specs AS (SELECT 'd' || doc_id AS stem, source AS bird_id, lang AS species, n_chars AS n_timebins, doc_id FROM documents)"
METRICS = """v_metrics AS (SELECT p_brand AS species, l_suppkey AS bird, l_returnflag AS probe_mode, l_linestatus AS mode, l_linenumber AS lora_rank, l_discount AS lr,
  CASE WHEN l_quantity = 50 THEN 'MAX' ELSE l_quantity::INT::VARCHAR END AS train_seconds, l_extendedprice / 1100 AS f1, l_tax * 100 AS fer, l_orderkey % 3 AS num_classes, l_partkey % 3 AS num_classes_train,
  l_suppkey % 3 AS num_classes_val, p_brand || '_' || l_orderkey || '_r' || l_linenumber || '_lr' || printf('%.2f', l_discount) AS run_name, l_orderkey AS run_id FROM lineitem JOIN part ON l_partkey = p_partkey)"""
PATCHES = "v_patches AS (SELECT vec_id AS patch_ix, vec_id % 16 AS pos_id, vec_id % 8 AS bird, CASE WHEN label = 0 THEN -1 ELSE label END::BIGINT AS label, embedding::DOUBLE[] AS h FROM embeddings)"
MANIFEST = """v_manifest AS (SELECT c_mktsegment AS species, 'XC' || o_custkey AS recording, (floor(o_totalprice)::BIGINT % 600)::DOUBLE AS start, (floor(o_totalprice)::BIGINT % 600 + 1 + o_orderkey % 30)::DOUBLE AS "end",
  '/clips/XC' || o_orderkey || '.WAV' AS dst FROM orders JOIN customer ON o_custkey = c_custkey)"""
