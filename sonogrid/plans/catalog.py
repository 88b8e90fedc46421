"""Every query of the library by name, and its equivalent in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sonogrid.plans import arrays, sampling, settings, tables, timeline

FLAGSHIP = "A08_resolution_limit_f1"
_PLANS = [timeline, arrays, tables, sampling, settings]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for p in _PLANS for k, q in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for p in _PLANS for k, s in p.ORACLES.items()}
