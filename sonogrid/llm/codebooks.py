"""Operator 13: product codes of vectors by Heap Lloyd, in integers.

A chunk of vectors is a row of a table, with the state of its parts: for each entry of a
codebook a binary heap of the parts assigned to it, keyed by the gap between the bound
of the second nearest entry (lower) and that of the own one (upper). When entries move, an
entry's drift grows by its own move and the largest of the others, and a part is safe
while its key, to which the drift at its scan was added, is above the drift. So a round
visits, in each heap, the violated top only; those parts are scanned exactly against all
entries and pushed to the heap of the nearest. What changed hands goes into sums for
each entry, which Spark adds up; codebooks alone (bounded by entries times width) pass
the driver. A round's table replaces the one before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonogrid.llm.common import grouped_join, removed, scratch, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of a chunk at most, and the largest component, once scaled, that exact sums of squares in 64 bits allow.
CHUNK, LARGEST = 8192, 1 << 26
#: What rounding may add to a bound, for each unit of drift and one.
SLACK = 1e-6


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances (long) of rows of x to the entries of a codebook."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:  # every sum is a whole number that a double holds
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    a, b = x.astype(np.int64), book.astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    for c in range(a.shape[1]):
        out += (a[:, c, None] - b[None, :, c]) ** 2
    return out


def scanned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (ties: the lower index) of each row, and how much farther the next one is."""
    entry, gap = np.zeros(len(x), np.int64), np.zeros(len(x))
    for at in range(0, len(x), 4096):
        far = distances(x[at : at + 4096], book)
        k = far.argmin(axis=1)
        near = far[np.arange(len(k)), k]
        far[np.arange(len(k)), k] = np.iinfo(np.int64).max
        entry[at : at + 4096], gap[at : at + 4096] = k, np.sqrt(far.min(axis=1)) - np.sqrt(near) if len(book) > 1 else np.inf
    return entry, gap


class Heaps:
    """For each entry a heap of parts: `rows` and `keys` stand heap after heap, `sizes` says how many each has."""

    def __init__(self, rows: np.ndarray, keys: np.ndarray, sizes: np.ndarray):
        self.rows, self.keys, self.sizes = rows, keys, sizes

    @staticmethod
    def of(entry: np.ndarray, keys: np.ndarray, entries: int) -> Heaps:
        rows = np.lexsort((keys, entry)).astype(np.int32)  # what is sorted is a heap
        return Heaps(rows, keys[rows], np.bincount(entry, minlength=entries).astype(np.int32))

    def violated(self, drift: np.ndarray) -> np.ndarray:
        """Places in `rows` of the parts whose key the drift of their entry has reached: level by level from the top, below violated ones only."""
        first, limit, found = np.cumsum(self.sizes) - self.sizes, drift + SLACK * (1 + drift), [np.zeros(0, np.int64)]
        heap = np.flatnonzero(self.sizes)
        at = np.zeros(len(heap), np.int64)
        while len(heap):
            bad = self.keys[first[heap] + at] <= limit[heap]
            heap, at = heap[bad], at[bad]
            found.append(first[heap] + at)
            heap, at = np.concatenate([heap, heap]), np.concatenate([2 * at + 1, 2 * at + 2])
            inside = at < self.sizes[heap]
            heap, at = heap[inside], at[inside]
        return np.concatenate(found)

    def entry(self) -> np.ndarray:
        """The entry of each part, by row."""
        out = np.zeros(len(self.rows), np.int64)
        out[self.rows] = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return out


def moved(x: np.ndarray, book: np.ndarray, drift: np.ndarray, heaps: Heaps | None) -> tuple[Heaps, np.ndarray, np.ndarray, np.ndarray]:
    """Heaps after a round, and of the parts that were scanned: row, entry before (-1: none) and entry now."""
    if heaps is None:
        rows, before = np.arange(len(x)), np.full(len(x), -1)
    else:
        at = heaps.violated(drift)
        rows, own = heaps.rows[at].astype(np.int64), heaps.entry()
        before = own[rows]
    now, gap = scanned(x[rows], book)
    if heaps is None:
        return Heaps.of(now, gap + drift[now], len(book)), rows, before, now
    if len(rows):
        keys = np.empty(len(x))
        keys[heaps.rows] = heaps.keys
        own[rows], keys[rows] = now, gap + drift[now]
        heaps = Heaps.of(own, keys, len(book))
    return heaps, rows, before, now


def drifted(old: np.ndarray, new: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """The drift of entries (part, entry) after their move: their own and the largest of the others."""
    move = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=2))
    order = np.sort(move, axis=1)
    second = order[:, -2] if move.shape[1] > 1 else np.zeros(len(move))
    others = np.where(move == order[:, -1:], second[:, None], order[:, -1:])
    tied = (move == order[:, -1:]).sum(axis=1, keepdims=True) > 1
    return drift + move + np.where(tied, order[:, -1:], others)


def whole_numbers(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of components times SCALE, rounded down."""
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(-1, width)
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"a component beyond {LARGEST // SCALE} in size: its distances are not exact in 64 bits")
    return x.astype(np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int32)


def chunks(width: int, size: int):
    """For mapInArrow over vec_id, label and embedding: chunks of vectors, part by part."""

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        x = whole_numbers(t["embedding"].combine_chunks(), width)
        parts = np.ascontiguousarray(x.reshape(len(x), PARTS, width // PARTS).swapaxes(0, 1))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), t[c].combine_chunks()) for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([parts.tobytes()], pa.binary()), pa.array([x.itemsize], pa.int32())], ["vec_id", "label", "parts", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == size:
                    yield chunk(held)
                    held, n = [], 0
        if n:
            yield chunk(held)

    return run


def read(row: dict, k: int) -> tuple[np.ndarray, Heaps | None]:
    """Of a chunk: its vectors (part, vector, component), and the heaps of each part if it has any."""
    n = len(row["vec_id"])
    x = np.frombuffer(row["parts"], {2: np.int16, 4: np.int32}[row["bytes"]]).reshape(PARTS, n, -1)
    if row.get("keys") is None:
        return x, [None] * PARTS
    rows, keys, sizes = np.frombuffer(row["rows"], np.int32).reshape(PARTS, n), np.frombuffer(row["keys"]).reshape(PARTS, n), np.frombuffer(row["sizes"], np.int32).reshape(PARTS, k)
    return x, [Heaps(rows[j], keys[j], sizes[j]) for j in range(PARTS)]


STATE = ["rows", "keys", "sizes", "change"]


def a_round(books: np.ndarray, drift: np.ndarray):
    """For mapInArrow over chunks: the chunks with their heaps after a round, and what it changed in the entries' counts and sums."""
    k, width = books.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                x, heaps = read({c: one[c][0].as_py() if c not in ("vec_id", "label") else one[c][0].values for c in one.schema.names if c != "change"}, k)
                change, after = np.zeros((PARTS, k, width + 1), np.int64), []
                for j in range(PARTS):
                    h, rows, before, now = moved(x[j], books[j], drift[j], heaps[j])
                    other = before != now
                    figures = np.concatenate([np.ones((int(other.sum()), 1), np.int64), x[j][rows[other]].astype(np.int64)], axis=1)
                    np.add.at(change[j], now[other], figures)
                    had = before[other] >= 0
                    np.subtract.at(change[j], before[other][had], figures[had])
                    after.append(h)
                state = [np.stack([getattr(h, c) for h in after]).tobytes() for c in STATE[:3]]
                yield pa.RecordBatch.from_arrays([*(one[c] for c in ("vec_id", "label", "parts", "bytes")), *(pa.array([v], pa.binary()) for v in [*state, change.tobytes() if change.any() else b""])], ["vec_id", "label", "parts", "bytes", *STATE])

    return run


def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over the column change: the sum over a task, a row for each figure that isn't zero."""
    total = None
    for batch in batches:
        for b in batch["change"].to_pylist():
            if b:
                x = np.frombuffer(b, np.int64)
                total = x.copy() if total is None else total + x
    at = np.flatnonzero(total) if total is not None else np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at] if len(at) else at)], ["slot", "value"])


def codes(books: np.ndarray):
    """For mapInArrow over chunks: vec_id, label, code and error of each vector."""
    k = books.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                ids, labels = one["vec_id"][0].values, one["label"][0].values
                x, heaps = read({"vec_id": ids, **{c: one[c][0].as_py() for c in ("parts", "bytes", *STATE[:3])}}, k)
                entry = np.stack([h.entry() for h in heaps], axis=1)
                error = sum(((x[j].astype(np.int64) - books[j][entry[:, j]]) ** 2).sum(axis=1) for j in range(PARTS))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([r.tobytes().hex() for r in entry.astype(np.uint8)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding (doubles) of the rows whose vector is there and holds finite components only."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    return vectors.select("vec_id", "label", x.cast("array<double>").alias("embedding")).where(x.isNotNull() & finite)


def trained(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, size: int = CHUNK) -> tuple[DataFrame, np.ndarray] | None:
    """Chunks with their heaps after the last assignment, and the codebooks (part, entry, component); None without a vector that can be cut."""
    spark = vectors.sparkSession
    good = usable(vectors)
    widths = good.groupBy(F.size("embedding").alias("width")).count().where(F.col("width") % PARTS == 0)
    top = widths.orderBy(F.col("count").desc(), F.col("width").desc()).first()
    if top is None or not top["width"]:
        return None
    width = top["width"]
    good = good.where(F.size("embedding") == width)
    first = good.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    books = whole_numbers(pa.array([r["embedding"] for r in first]), width).astype(np.int64).reshape(len(first), PARTS, -1).swapaxes(0, 1)
    types = {c: good.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    kind = f"vec_id array<{types['vec_id']}>, label array<{types['label']}>, parts binary, bytes int"
    path = scratch(spark)
    good.mapInArrow(chunks(width, size), kind).write.parquet(path)
    table, kind = spark.read.schema(kind).parquet(path), kind + "".join(f", {c} binary" for c in STATE)
    drift, total = np.zeros(books.shape[:2]), np.zeros((*books.shape[:2], width // PARTS + 1), np.int64)
    for r in range(rounds + 1):
        before, path = path, scratch(spark)
        table.mapInArrow(a_round(books, drift), kind).write.parquet(path)
        removed(spark, before)
        table = spark.read.schema(kind).parquet(path)
        if r < rounds:
            for slot, value in table.select("change").mapInArrow(changes, "slot long, value long").groupBy("slot").agg(F.sum("value")).collect():
                total.reshape(-1)[slot] += value
            new = np.where(total[..., :1] > 0, total[..., 1:] // np.maximum(total[..., :1], 1), books)
            drift, books = drifted(books, new, drift), new
    return table, books


def vector_codes(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, size: int = CHUNK) -> DataFrame:
    """One row for each vector that can be coded: vec_id, code, error, label_error (summed over equal labels, nulls together) and codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are dropped; so are vectors of another length than most
    (ties: the longer) and of lengths that 4 doesn't divide, which can't be cut alike. Repeated vec_ids are rows of their own, and rank by their vectors;
    null ones come last. With fewer vectors than entries the codebooks have as many entries as there are vectors.
    Components beyond 65,536 in size are an error: their distances would not be exact. Other columns are not read.
    """
    spark = vectors.sparkSession
    types = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    found = trained(vectors, entries, rounds, size)
    if found is None:
        return spark.createDataFrame([], f"vec_id {types['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    table, books = found
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    rows = written(table.mapInArrow(codes(books), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"))
    rows = rows.withColumn("group", F.concat(F.when(F.col("label").isNull(), "-").otherwise("="), F.coalesce(F.col("label").cast("string"), F.lit(""))))
    sums = rows.groupBy("group").agg(F.sum("error").alias("label_error"))
    return grouped_join(rows, sums, "group", "vec_id").select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
