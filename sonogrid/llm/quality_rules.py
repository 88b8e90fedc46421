"""Operator 1: quality rules, and a calibrated model of hashed word and character n-grams for what the rules let through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sonogrid.llm.common import blocks, sums, whole
from sonogrid.llm.linear import FIT_CHARS, ODD, Features, fit, labelled, sigmoid

#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 4000
KEEP = 0.5
FEWEST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SIGNS = b"#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"


def repeated_words(ids: np.ndarray, lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, its words in windows found twice or more in that text. Windows meet by a hash and are then compared word by word."""
    n, texts = len(ids), np.repeat(np.arange(len(lengths)), lengths)
    if n < window:
        return np.zeros(len(lengths), np.int64)
    last = n - window + 1
    inside = texts[:last] == texts[window - 1 :]
    key = texts[:last].astype(np.uint64) * ODD[1]
    for k in range(window):
        key = (key ^ ids[k : last + k].astype(np.uint64)) * ODD[0]
        key ^= key >> np.uint64(31)
    at = np.flatnonzero(inside)
    at = at[np.argsort(key[at], kind="stable")]
    a, b = at[:-1], at[1:]
    same = key[a] == key[b]
    a, b = a[same], b[same]
    equal = texts[a] == texts[b]
    for k in range(window):
        equal &= ids[a + k] == ids[b + k]
    starts = np.zeros(n + 1, np.int64)
    hit = np.unique(np.concatenate([a[equal], b[equal]]))
    starts[hit] += 1
    np.subtract.at(starts, hit + window, 1)
    return sums((np.cumsum(starts[:-1]) > 0).astype(np.int64), lengths)


def counts(texts: list[str]) -> dict[str, np.ndarray]:
    """The base figures of a list of texts."""
    ids: dict[bytes, int] = {}
    out = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines")}
    words: list[int] = []
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        found = raw.split()
        words += [ids.setdefault(w, len(ids)) for w in found]
        out["n_words"].append(len(found))
        out["word_chars"].append(len(text) - sum(map(text.count, BLANKS)))
        out["n_symbols"].append(len(raw) - len(raw.translate(None, SIGNS)))
        lines = [x for x in text.split("\n") if x.strip(BLANKS)]
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    columns = {k: np.array(v, dtype=np.int64) for k, v in out.items()}
    return columns | {"n_repeat_words": repeated_words(np.array(words, dtype=np.int64), columns["n_words"])}


def quality_rules(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep: float = KEEP, fit_chars: int = FIT_CHARS) -> DataFrame:
    """One row for each document: doc_id, the base figures, base_failed, score and kept.

    Null texts count as empty: no words, base_failed. Rows with a null or repeated
    doc_id are judged one by one like any other. Other columns are not read.
    The model learns from texts of at most fit_chars characters. Without usable labels it has score 0.5 for all, which is kept.
    """
    weights, bias, a, b = fit(labelled(docs, labels, "quality", fit_rows, (0, 1, 2, 3), fit_chars), True, "adagrad", True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(True)
        for part, texts in blocks(batches):
            c = counts(texts)
            failed = (c["n_words"] < FEWEST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
            p = sigmoid(a * features.margins(texts, weights, bias) + b)
            c |= {"base_failed": failed, "kept": ~failed & (p >= keep), "score": p}
            yield pa.RecordBatch.from_arrays([part["doc_id"], *map(pa.array, c.values())], ["doc_id", *c])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double")
