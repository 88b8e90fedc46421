"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sonogrid.llm.common import removed, scratch


#: A vertex with more than one link in so many as its smaller end is hot: there are fewer of them.
SHARE = 1024


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same values as the links a, b: each value with the first of its class."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(values))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(values))
    return values[other], values[root[other]]


def columns(x: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in x.columns]


class Links:
    """Links found so far, cut down to a forest whenever they are many."""

    def __init__(self, names: tuple[str, str] = ("a", "b"), most: int = 1 << 20):
        self.names, self.most, self.n, self.a, self.b = names, most, 0, [], []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.n += len(a)
        if self.n > self.most:
            a, b = self.forest()
            self.a, self.b, self.n = [a], [b], 0

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in self.forest()], list(self.names))

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        return forest(np.concatenate([*self.a, np.zeros(0, np.int64)]), np.concatenate([*self.b, np.zeros(0, np.int64)]))


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition as a forest."""
    links = Links(("u", "v"))
    for x in batches:
        links.add(*columns(x))
    yield links.batch()


def starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over partitions sorted by u and v: links of each u and of its smaller neighbours with the least of these."""
    vertex, least, links = None, None, Links(("u", "v"))
    for x in batches:
        key, other = columns(x)
        if not len(key):
            continue
        head = np.concatenate(([True], key[1:] != key[:-1]))
        first = other[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
        # A vertex of very many neighbours goes on in the next batch.
        if vertex is not None and key[0] == vertex:
            first[key == vertex] = least
        vertex, least = key[-1], first[-1]
        rest = other != first
        links.add(np.concatenate([other[rest], key[head]]), np.concatenate([first[rest], first[head]]))
    yield links.batch()


def lowered(stars: DataFrame, n: int) -> DataFrame:
    """Of n links (u, v; v is smaller), each with the smaller end's own least neighbour in its place, if it has one.

    Every link meets that neighbour once, by its smaller end. Ends of more than one link in SHARE, fewer than SHARE, are broadcast with theirs.
    """
    least = stars.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("least"))
    hot = stars.groupBy("v").agg(F.count("*").alias("links")).where(F.col("links") * SHARE > n).select("v")
    named = F.broadcast(hot.join(least, "v", "left"))
    met = stars.join(named, "v").unionByName(stars.join(F.broadcast(hot), "v", "left_anti").join(least, "v", "left"))
    return met.select("u", F.coalesce("least", "v").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """vertex and root (the smallest reachable vertex) of all vertices of links (a, b: long); roots are listed with themselves.

    Large and small stars in turn: each round points every vertex's larger neighbours, then every vertex
    and its smaller ones, at the smallest one known, and the table of links is written between rounds, in place of the one before.
    Rounds grow with the logarithm of the longest chain. A round shuffles each link by its smaller end, by its
    larger one, and for two sums that map tasks begin. A vertex's smaller neighbours pass in order and are never held together;
    it has one for each partition of links at most, or for each forest of a partition with very many.
    """
    spark, kind = links.sparkSession, "u long, v long"

    def saved(df: DataFrame) -> tuple[DataFrame, dict, str]:
        path, seen = scratch(spark), Observation()
        df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).write.parquet(path)
        return spark.read.schema(kind).parquet(path), seen.get, path

    stars, now, path = saved(links.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").mapInArrow(contracted, kind))
    before = None
    while now != before:
        before, old = now, path
        stars, now, path = saved(lowered(stars, now["n"]).repartition("u").sortWithinPartitions("u", "v").mapInArrow(starred, kind))
        removed(spark, old)
    return stars.selectExpr("u AS vertex", "v AS root").union(stars.selectExpr("v AS vertex", "v AS root")).distinct()
