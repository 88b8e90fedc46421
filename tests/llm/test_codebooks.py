"""Operator 13 against plain Lloyd in Python's whole numbers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonogrid.llm import codebooks
from sonogrid.llm.common import grouped_join
from sonogrid.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, parts string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", 1, "y") for i, v, k in rows], VECTORS)


def lloyd(rows, entries=256, rounds=4):
    """Codes, errors, sums by label and the hash of the codebooks, by comparing every part with every entry each time."""
    good = [(i, [math.floor(1024 * float(c)) for c in v], k) for i, v, k in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not good:
        return {}
    width = len(good[0][1]) // 4
    cut = np.array([v for _, v, _ in good], dtype=object).reshape(len(good), 4, width)
    order = sorted(range(len(good)), key=lambda n: (good[n][0] is None, good[n][0] or 0, good[n][1]))[:entries]
    books = [[list(cut[n][j]) for n in order] for j in range(4)]

    def nearest(j):
        far = ((cut[:, j, None, :] - np.array(books[j], dtype=object)[None]) ** 2).sum(axis=2)
        return [min(range(len(books[j])), key=lambda e, r=r: (r[e], e)) for r in far], far

    for _ in range(rounds):
        for j in range(4):
            own, _ = nearest(j)
            for e in range(len(books[j])):
                held = [cut[n][j] for n in range(len(good)) if own[n] == e]
                if held:
                    books[j][e] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    last = [nearest(j) for j in range(4)]
    errors = [sum(far[n][own[n]] for own, far in last) for n in range(len(good))]
    by = {}
    for (_, _, k), e in zip(good, errors, strict=True):
        by[k] = by.get(k, 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{own[n]:02x}" for own, _ in last), errors[n], by[k], sha) for n, (i, _, k) in enumerate(good))


def test_odd_rows_and_small_chunks(spark):
    rng = random.Random(1)
    point = lambda: [rng.choice([-1, 0, 2]) + rng.gauss(0, 0.01) for _ in range(8)]
    rows = [(n, point(), rng.choice([None, 0, 1])) for n in range(300)]
    rows += [(900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [math.inf] + [0.0] * 7, 1), (903, [math.nan] * 8, None), (904, [1.0, 2.0], 1), (905, [], 2)]
    rows += [(5, rows[5][1], 7), (None, rows[6][1], None), (7, point(), 1), *[(1000 + k, [0.5] * 8, 3) for k in range(200)]]
    want = lloyd([r for r in rows if r[1] is None or len(r[1]) == 8], 20)
    for size in (8192, 7):
        got = codebooks.vector_codes(frame(spark, rows).repartition(3), 20, size=size).collect()
        assert sorted((str(r.vec_id), *r[1:]) for r in got) == want
    assert codebooks.vector_codes(frame(spark, rows).limit(0)).count() == 0 and codebooks.vector_codes(frame(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    one = codebooks.vector_codes(frame(spark, [(3, [0.001, -0.001, 0.0, 5.0], None)])).first()
    assert tuple(one)[:4] == (3, "00000000", 0, 0) and one.codebooks_sha256 == hashlib.sha256(b"1,-2,0,5120").hexdigest()
    with pytest.raises(Exception, match="not exact"):
        codebooks.vector_codes(frame(spark, [(1, [1e9] * 4, 1)])).count()


def test_query_over_its_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op13_vector_codes"](spark, data).collect()
    assert sorted((str(r.vec_id), *r[1:]) for r in got) == lloyd(rows)


def test_only_violated_parts_are_scanned():
    rng = np.random.default_rng(2)
    x = (rng.normal(0, 1, (4000, 6)) + 12 * rng.integers(0, 6, (4000, 1))).astype(np.float64)
    x = np.floor(x * 1024).astype(np.int32)
    book, drift, heaps, scans = x[:32].astype(np.int64), np.zeros(32), None, []
    for _ in range(12):
        heaps, rows, _, _ = codebooks.moved(x, book, drift, heaps)
        own = heaps.entry()
        assert (own == codebooks.distances(x, book).argmin(axis=1)).all()
        for first, n in zip(np.cumsum(heaps.sizes) - heaps.sizes, heaps.sizes, strict=True):
            k = heaps.keys[first : first + n]
            assert (k[1:] >= k[(np.arange(1, n) - 1) // 2]).all()
        scans.append(len(rows))
        sums, counts = np.zeros_like(book), np.bincount(own, minlength=32)
        np.add.at(sums, own, x)
        new = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], book)
        drift, book = codebooks.drifted(book[None], new[None], drift[None])[0], new
    assert scans[0] == 4000 and scans[-1] < 2000


def test_distances_beyond_doubles():
    x, book = np.array([[1 << 26, -(1 << 26)], [3, 5]]), np.array([[-(1 << 26), (1 << 26) - 1], [0, 0]])
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e, strict=True)) for e in book] for r in x]
    assert codebooks.distances(x, book).tolist() == want


def test_grouped_join_deals_a_hot_group(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, grouped_join(rows, groups, "k", "id", most=5).collect())) == sorted(map(tuple, grouped_join(rows, groups, "k", "id").collect()))
