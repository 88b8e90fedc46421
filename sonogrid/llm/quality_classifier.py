"""Operator 2: quality classifier over hashed word n-grams, learned by follow-the-regularised-leader updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonogrid.llm.common import fold, whole
from sonogrid.llm.linear import FIT_CHARS, fit, labelled, score

#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 4000
THRESHOLD = 0.7


def quality_classifier(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD, fit_chars: int = FIT_CHARS) -> DataFrame:
    """One row for each document: doc_id, held_out, score and predicted.

    The model learns from folds 0, 1 and 3 only, and only from texts, of at most fit_chars characters. A null text
    counts as empty; an empty text has the score of the bias. Rows with a null or
    repeated doc_id are scored one by one. Without usable labels all scores are 0.5.
    """
    model = fit(labelled(docs, labels, "quality", fit_rows, chars=fit_chars), False, "ftrl", False)
    out = score(whole(docs, "doc_id"), model, False)
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD, fit_chars: int = FIT_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, that quality_classifier() predicts 1 for."""
    model = fit(labelled(docs, labels, "quality", fit_rows, chars=fit_chars), False, "ftrl", False)
    return score(docs, model, False, docs.columns).where(F.col("score") >= threshold).drop("score")
