"""The operators over their whole tables, and DuckDB's SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sonogrid.llm import decontamination, licenses, secrets, url_filters
from sonogrid.llm.codebooks import vector_codes
from sonogrid.llm.common import documents
from sonogrid.llm.language_id import language_id
from sonogrid.llm.ngram_join import ngram_groups
from sonogrid.llm.packing import packing
from sonogrid.llm.quality_classifier import quality_classifier
from sonogrid.llm.quality_rules import quality_rules
from sonogrid.llm.runs import run_digests
from sonogrid.llm.simhash import simhash_groups
from sonogrid.llm.suffix_dedup import suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Query] = {
    "op1_quality_rules": lambda s, d: quality_rules(documents(s, d), table(s, d, "labels")),
    "op2_quality_classifier": lambda s, d: quality_classifier(documents(s, d), table(s, d, "labels")),
    "op3_url_filters": lambda s, d: url_filters.url_filters(table(s, d, "pages")),
    "op4_language_id": lambda s, d: language_id(documents(s, d)),
    "op5_decontamination": lambda s, d: decontamination.decontamination(documents(s, d), table(s, d, "benchmark")),
    "op6_packing": lambda s, d: packing(documents(s, d)),
    "op7_suffix_dedup": lambda s, d: suffix_dedup(documents(s, d)),
    "op8_simhash": lambda s, d: simhash_groups(documents(s, d)),
    "op9_license_scans": lambda s, d: licenses.license_scans(documents(s, d)),
    "op10_secret_scans": lambda s, d: secrets.secret_scans(documents(s, d)),
    "op11_runs": lambda s, d: run_digests(documents(s, d)),
    "op12_ngram_join": lambda s, d: ngram_groups(documents(s, d)),
    "op13_vector_codes": lambda s, d: vector_codes(table(s, d, "embeddings")),
}

ORACLES: dict[str, str] = {
    "op3_url_filters": url_filters.SQL,
    "op5_decontamination": decontamination.sql(),
    "op9_license_scans": licenses.sql(),
    "op10_secret_scans": secrets.sql(),
}
