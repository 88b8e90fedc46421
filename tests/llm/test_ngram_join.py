"""Operator 12 against all pairs of documents."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonogrid.llm import ngram_join
from sonogrid.llm.common import copies_join
from sonogrid.llm.queries import QUERIES
from tests.llm.test_duplicates import roots
from tests.llm.test_text import ODD, WORD, docs


def shingles(text: str | None) -> frozenset:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))) if words else frozenset()


def groups(rows) -> list[tuple]:
    """doc_id, size of the set and smallest doc_id of each row, by comparing all distinct sets."""
    sets = [shingles(t) for _, t in rows]
    own = sorted(set(sets) - {frozenset()}, key=lambda s: (len(s), sorted(s)))
    at = {s: k for k, s in enumerate(own)}
    holds: dict = {}
    for k, s in enumerate(own):
        for x in s:
            holds.setdefault(x, []).append(k)
    links = []
    for k, s in enumerate(own):
        shared: dict = {}
        for x in s:
            for j in holds[x]:
                shared[j] = shared.get(j, 0) + 1
        links += [(k, j) for j, n in shared.items() if j > k and 100 * n >= 85 * (len(s) + len(own[j]) - n)]
    root, least = roots(links, range(len(own))), {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            r = root[at[s]]
            least[r] = min(least.get(r, i), i)
    return sorted((str(i), len(s), str(least.get(root[at[s]]) if s else i)) for (i, _), s in zip(rows, sets, strict=True))


def found(df) -> list[tuple]:
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def copies(rng: random.Random) -> list[tuple]:
    """Near copies on both sides of the threshold, chains of them, and a passage and lines that many share."""
    rows, line = [], " ".join(f"l{k}" for k in range(12))
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([7, 9, 12, 40, 64, 130, 300, 1400]))]
        for k in range(rng.choice([2, 5, 30])):
            words = list(base)
            for at in rng.sample(range(len(base)), rng.randrange(0, 2 + len(base) // 40)):
                words[at] = f"x{rng.randrange(9)}"
            if k % 3 == 0:
                words = words[: len(words) - len(words) // 15]
            rows.append((1000 * g + k, " ".join(words)))
    rows += [(50_000 + k, line + " " + " ".join(f"q{rng.randrange(9)}" for _ in range(rng.randrange(4)))) for k in range(60)]
    return rows + [(60_000 + k, f"{line} {line} u{k} " + " ".join(f"p{rng.randrange(500)}" for _ in range(30))) for k in range(40)]


SETTINGS = [{}, {"least": 2, "tile": 8, "members": 4}, {"least": 4, "most": 40, "tile": 3, "few": 5}, {"least": 1, "tile": 16}]


@pytest.mark.parametrize("settings", SETTINGS, ids=str)
def test_ngram_groups(spark, settings):
    rng = random.Random(6)
    d = docs(spark, [*ODD, *copies(rng), (None, None), (9, "Same Text"), (10, "one two three FOUR"), (11, "One two three four")])
    rows = [(r.doc_id, r.text) for r in d.collect()]
    got = ngram_join.ngram_groups(d.withColumn("key", F.lit("k")).withColumn("n", F.lit(1)).withColumn("root", F.lit(0)).repartition(5), **settings)
    assert found(got) == groups(rows)


def test_no_rows_and_no_words(spark):
    assert ngram_join.ngram_groups(docs(spark, []).limit(0)).count() == 0
    assert found(ngram_join.ngram_groups(docs(spark, [(1, None), (2, ""), (2, ""), (None, " ")]))) == [("1", 0, "1"), ("2", 0, "2"), ("2", 0, "2"), ("None", 0, "None")]


def test_query_over_its_whole_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op12_ngram_join"](spark, data)) == groups(rows)


def test_sets_alike_share_a_key():
    """Whatever is common, and however many tokens are missing as far as the threshold allows."""
    rng = np.random.default_rng(3)
    for _ in range(2000):
        n = int(rng.choice([6, 7, 13, 20, 33, 64, 120, 127, 260, 700]))
        base = rng.integers(0, 1 << 63, n + 200, dtype=np.uint64)
        while True:
            a, b = int(rng.integers(0, 1 + n // 7)), int(rng.integers(0, 1 + n // 7))
            x, y = np.unique(np.concatenate([base[: n - a], base[n : n + b]])), np.unique(base[:n])
            shared = len(np.intersect1d(x, y))
            if 100 * shared >= 85 * (len(x) + len(y) - shared):
                break
        share = rng.random()
        kind = {int(t): int(rng.integers(4, 9)) if rng.random() < share else 0 for t in np.concatenate([x, y]).tolist()}
        keys = [ngram_join.keys_of(s, np.array([kind[t] for t in s.tolist()], dtype=np.uint8)) for s in (x, y)]
        rare = set(keys[0][0].tolist()) & set(keys[1][0].tolist())
        pairs = [{k for _, p in ks[1] for k in p.tolist()} for ks in keys]
        assert rare or pairs[0] & pairs[1], (n, a, b, share)
        assert all(len(p) <= 3 * n + 60 for p in pairs)


def test_bound_of_what_is_sent_to_tasks(spark):
    d = docs(spark, [(k, " ".join(f"w{j}" for j in range(k % 40, k % 40 + 30))) for k in range(300)])
    bits, tokens, classes = ngram_join.common_tokens(d, 4, 1 << 20)
    assert len(tokens) == len(classes) > 50 and (np.diff(tokens.astype(np.int64)) > 0).all()
    few = ngram_join.common_tokens(d, 4, 20)[1]
    assert len(few) <= 20 and set(few.tolist()) <= set(tokens.tolist())


def test_copies_of_a_key_are_not_shuffled(spark):
    rows = spark.range(600).select("id", F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    g = rows.groupBy("k").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    want = sorted((i, 0 if i < 400 else i, 0 if i < 400 else i) for i in range(600))
    assert sorted((r.id, r.k, r.least) for r in copies_join(rows, g, "k", 10).collect()) == want
