"""The training corpus: documents filtered, deduplicated, decontaminated, cleared of secrets and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of
documents. Decisions reach rows by doc_id and text together, so rows with a null or
repeated doc_id are judged like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonogrid.llm import simhash
from sonogrid.llm.common import documents, written
from sonogrid.llm.decontamination import decontamination
from sonogrid.llm.packing import packing
from sonogrid.llm.quality_classifier import good
from sonogrid.llm.secrets import ledger_scan, redact


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def row_key(doc_id: Column, key: Column) -> Column:
    """What rows of the same doc_id (null too) and text have in common; key is of the text."""
    return F.substring(F.unhex(F.sha2(F.concat(key, F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")).cast("binary")), 256)), 1, 16)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, row_key(F.col("doc_id"), simhash.text_key(F.col("text"))).alias("row_key"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good ones."""
    return good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id (null last), of each group of near-duplicates: shingles of five words, a similarity of 0.8."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("x")
    kept = simhash.near_groups(docs).groupBy("root").agg(first).select(row_key(F.col("x.doc_id"), F.col("x.key")).alias("row_key"))
    return keyed(docs).join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    rows = keyed(docs)
    judged = decontamination(rows.select(F.col("row_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    held = judged.where("contaminated").select(F.col("doc_id").alias("row_key")).distinct()
    return rows.join(held, "row_key", "left_anti").select(*COLUMNS)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars brought in line."""
    spans = ledger_scan(docs, keep=COLUMNS)
    text = F.when(F.size("spans") > 0, redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    out = spans.withColumn("text", text)
    return out.select("doc_id", "text", "lang", "source", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in training windows."""
    return packing(docs)


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark_free), ("secret scans", secrets_out), ("packing", packed)]

#: SQL can't express learning, fingerprints of bit counts, or token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
