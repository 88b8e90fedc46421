"""Hashed n-gram features of texts and the linear models over them.

A feature's value is its count over the number of n-grams of its family in the
text, so that a text's score is a mean of weights: a gather and a sum for each
family, with no table of counts per text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonogrid.llm.common import blocks, fold, sums

BITS = 18
#: Values are multiplied by this before learning, for the step sizes to fit.
SCALE = 16.0
#: Characters of a labelled text that serves learning, at most.
FIT_CHARS = 1 << 17
TOKEN = re.compile(r"\w+|[^\w\s]+")
ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]


def bucket(codes: np.ndarray, family: int) -> np.ndarray:
    """Multiply-shift hash of 64-bit codes; families are kept apart by their multiplier and offset."""
    h = (codes + np.uint64(family * 0x51ED27)) * ODD[family]
    h ^= h >> np.uint64(29)
    return ((h * ODD[0]) >> np.uint64(64 - BITS)).astype(np.int64)


def shape(token: str) -> int:
    """Of a token: 1 to 4 for words (lower case, title, capitals, others), 5 to 7 by the length of a run of signs."""
    if token[0].isalnum() or token[0] == "_":
        return 1 if token.islower() else 3 if token.isupper() and len(token) > 1 else 2 if token.istitle() else 4
    return 4 + min(len(token), 3)


class Tokens:
    """Codes of tokens, remembered for the most recent ones."""

    def __init__(self, most: int = 300_000):
        self.most, self.codes = most, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all tokens (hash and shape), and the number of tokens of each text."""
        codes, out, lengths = self.codes, [], []
        if len(codes) > self.most:
            codes.clear()
        for text in texts:
            found = TOKEN.findall(text)
            lengths.append(len(found))
            try:
                out += [codes[t] for t in found]
            except KeyError:
                for t in found:
                    if t not in codes:
                        codes[t] = zlib.crc32(t.encode("utf-8", "surrogatepass")) << 3 | shape(t)
                out += [codes[t] for t in found]
        return np.array(out, dtype=np.uint64), np.array(lengths, dtype=np.int64)


def word_families(codes: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of words, of pairs of words, and of shapes in threes in which a repeated word is marked; with each text's number of them."""
    first = np.zeros(len(codes), bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    before = np.where(first, np.uint64(0), np.roll(codes, 1))
    shapes = np.where(codes == before, np.uint64(8), codes & np.uint64(7))
    s1 = np.where(first, np.uint64(0), np.roll(shapes, 1))
    s2 = np.where(first, np.uint64(0), np.roll(s1, 1))
    three = shapes | s1 << np.uint64(4) | s2 << np.uint64(8)
    return [(bucket(codes, 0), lengths), (bucket(codes * ODD[3] + before, 1), lengths), (bucket(three, 2), lengths)]


def char_family(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the four-byte strings of each text with a space before and some after it; strings that would run into the next text are spaces."""
    raw = [b" " + t.encode("utf-8", "surrogatepass") + b" " * 4 for t in texts]
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    grams = np.zeros(len(b), np.uint64)
    grams[:-3] = b[:-3] | b[1:-2] << np.uint64(8) | b[2:-1] << np.uint64(16) | b[3:] << np.uint64(24)
    lengths = np.array([len(x) for x in raw], dtype=np.int64)
    for k in (1, 2, 3):
        grams[np.cumsum(lengths) - k] = 0x20202020
    return bucket(grams, 3), lengths


class Features:
    """Families of n-grams of a list of texts: of words, and of characters if asked for."""

    def __init__(self, chars: bool):
        self.chars, self.tokens = chars, Tokens()

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = word_families(*self.tokens(texts))
        return [*out, char_family(texts)] if self.chars else out

    def sparse(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and values of one text, each bucket once."""
        at, value = [], []
        for buckets, lengths in self([text]):
            if lengths[0]:
                i, n = np.unique(buckets[: lengths[0]], return_counts=True)
                at.append(i)
                value.append(n * (SCALE / lengths[0]))
        if not at:
            return np.zeros(0, np.int64), np.zeros(0)
        at, value = np.concatenate(at), np.concatenate(value)
        i, where = np.unique(at, return_inverse=True)
        return i, np.bincount(where, value)

    def margins(self, texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
        out = np.full(len(texts), bias)
        for buckets, lengths in self(texts):
            out += SCALE * sums(weights[buckets], lengths) / np.maximum(lengths, 1)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.02) -> tuple[np.ndarray, float]:
    """Logistic regression by follow-the-regularised-leader updates, one row at a time. The last coordinate is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, value, label in rows:
            at, value = np.append(at, 1 << BITS), np.append(value, 1.0)
            w = weights(at)
            g = (sigmoid(w @ value) - label) * value
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1].astype(np.float32), float(w[-1])


def adagrad(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 4, rate: float = 0.3, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression by stochastic gradients with a step size for each coordinate."""
    w, n = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-2)
    for _ in range(epochs):
        for at, value, label in rows:
            at, value = np.append(at, 1 << BITS), np.append(value, 1.0)
            g = (sigmoid(w[at] @ value) - label) * value + l2 * w[at]
            n[at] += g * g
            w[at] -= rate * g / np.sqrt(n[at])
    return w[:-1].astype(np.float32), float(w[-1])


def platt(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities: Newton steps on the log loss with smoothed targets."""
    if not len(labels):
        return 1.0, 0.0
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, a = np.stack([margins, np.ones_like(margins)]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(a @ x)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - target) + 1e-3 * (a - [1, 0]))
        a = a - np.clip(step, -1, 1)
    return float(a[0]), float(a[1])


def labelled(docs: DataFrame, labels: DataFrame, column: str, rows: int, folds: tuple[int, ...] = (0, 1, 3), chars: int = FIT_CHARS) -> DataFrame:
    """Texts (null: empty) and labels of at most `rows` labelled documents of the folds, chosen by hashes of the id and the text.

    Rows without an id or label, labels without a document, and texts of more than `chars` characters don't count; equal rows count once.
    Labels meet the ids of documents before any are chosen, so that those of other documents take no place.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= chars)
    chosen = (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & fold(F.col("doc_id")).isin(*folds))
        .distinct()
        .join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "label")
        .limit(rows)
    )
    found = texts.join(F.broadcast(chosen), "doc_id").withColumn("order", F.xxhash64("doc_id", "text", "label", F.lit(7)))
    # Documents can repeat an id: the bound holds for what the join gives.
    once = found.groupBy("order").agg(F.min(F.struct("doc_id", "text", "label")).alias("x"))
    return once.orderBy("order").limit(rows).select("x.*")


def fit(sample: DataFrame, chars: bool, learner: str, calibrated: bool) -> tuple[np.ndarray, float, float, float]:
    """Weights, bias, slope and offset, learned in one task from a sample of bounded size.

    With `calibrated`, every fourth row serves the slope and offset only. No rows, or rows of one label, give zero weights and the smoothed prior.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, rows = Features(chars), []
        for batch in batches:
            for i, text, label in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "label")), strict=True):
                rows.append((zlib.crc32(str(i).encode()), text, label))
        rows.sort()
        data = [(*features.sparse(text), label) for _, text, label in rows]
        held = [k % 4 == 3 for k in range(len(data))] if calibrated else [False] * len(data)
        learn = [x for x, h in zip(data, held, strict=True) if not h]
        y = sum(x[2] for x in learn)
        if 0 < y < len(learn):
            w, bias = {"ftrl": ftrl, "adagrad": adagrad}[learner](learn)
        else:
            w, bias = np.zeros(1 << BITS, np.float32), float(np.log((y + 1) / (len(learn) - y + 1)))
        rest = [x for x, h in zip(data, held, strict=True) if h]
        a, b = platt(np.array([w[i] @ v + bias for i, v, _ in rest]), np.array([x[2] for x in rest])) if calibrated and 0 < y < len(learn) else (1.0, 0.0)
        yield pa.RecordBatch.from_pydict({"weights": [w.tobytes()], "rest": [[bias, a, b]]})

    row = sample.repartition(1).mapInArrow(train, "weights binary, rest array<double>").first()
    if row is None:
        return np.zeros(1 << BITS, np.float32), 0.0, 1.0, 0.0
    return np.frombuffer(row["weights"], np.float32), *row["rest"]


def score(docs: DataFrame, model: tuple[np.ndarray, float, float, float], chars: bool, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (doc_id if not said) of docs with score, a probability; a null text counts as empty. Arrow batches are cut to blocks of a few MB."""
    weights, bias, a, b = model
    keep = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(chars)
        for part, texts in blocks(batches, "_text"):
            p = sigmoid(a * features.margins(texts, weights, bias) + b)
            yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), pa.array(p)], [*keep, "score"])

    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double")
