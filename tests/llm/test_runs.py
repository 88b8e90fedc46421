"""Operator 11 against a search of all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from sonogrid.llm.queries import QUERIES
from sonogrid.llm.runs import Classes, periodic_runs, repeating, run_digests, runs_of
from tests.llm.test_text import ODD, WORD, docs


def all_runs(words: list) -> list[tuple[int, int, int]]:
    """Every maximal stretch of smallest period q that holds it four times and has six words."""
    found, numbers = [], {}
    coded = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    for q in range(1, len(words) // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], coded[q:] == coded[:-q], [0]))))
        for start, end in edges.reshape(-1, 2).tolist():
            length, part = end - start + q, words[start : end + q]
            if length >= max(6, 4 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def digests(doc_id, text: str | None) -> tuple:
    words = WORD.findall(text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    longest = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    milli = None if not runs else 1000 * longest[1] // longest[2]
    return (len(runs), *longest, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_many_texts_in_step():
    random.seed(4)
    for _ in range(150):
        texts = []
        for _ in range(random.randrange(1, 7)):
            few = random.choice([1, 2, 3, 6])
            w = [random.randrange(few) for _ in range(random.randrange(60))]
            if w and random.random() < 0.6:
                at, p = random.randrange(len(w)), random.randrange(1, 8)
                w[at:at] = [w[(at + k % p) % len(w)] for k in range(random.randrange(60))]
            texts.append(w)
        assert runs_of([np.array(w, dtype=np.int64) for w in texts]) == [all_runs(w) for w in texts]
    assert runs_of([]) == [] and runs_of([np.zeros(0, np.int64)]) == [[]]


def test_only_smaller_halves_are_asked():
    """The places asked in all are a logarithm's multiple of the words, though there are as many lengths as words."""
    for words in (np.zeros(4000, np.int64), np.tile(np.arange(400), 10), np.array([bin(k).count("1") % 2 for k in range(4096)])):
        c, asked = Classes(np.append(words, -1), np.zeros(len(words) + 1, np.int64)), 0
        for length in range(1, len(words)):
            c.squares(length)
            c.refine(length)
            asked += len(c.moved)
        assert asked <= 3 * len(words) * np.log2(len(words)) and not c.active
    assert runs_of([np.zeros(4000, np.int64)]) == [[(0, 4000, 1)]]


def test_run_digests(spark):
    random.seed(5)
    line = "the same line again "
    made = [(100 + k, " ".join(random.choices("a b c".split(), k=random.randrange(80)))) for k in range(120)]
    made += [(500, line * 9 + "tail"), (501, "x " * 5), (502, "x " * 6), (503, "a b " * 3 + "a"), (504, "a b " * 4), (505, " ".join(map(str, range(3000))) + " z" * 7)]
    d = docs(spark, [*ODD, *made, (7, line * 5), (7, line * 5), (None, "y " * 8)])
    want = sorted((r.doc_id is None, r.doc_id or 0, *map(str, digests(r.doc_id, r.text))) for r in d.collect())
    for block in (1 << 22, 64):
        got = run_digests(d.withColumn("words", F.lit(1)).withColumn("runs", F.lit("x")), block=block).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, *map(str, r[1:])) for r in got) == want
    assert run_digests(d.limit(0)).count() == 0


def test_query_over_its_whole_table(spark, data):
    texts = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[1:]) for r in QUERIES["op11_runs"](spark, data).collect()}
    assert got == {r.doc_id: digests(r.doc_id, r.text) for r in texts} and sum(v[0] > 0 for v in got.values()) > 3


def test_periodic_runs_keep_words_and_places(spark):
    r = periodic_runs(docs(spark, [(1, "go " + "a b " * 4 + "end")])).first()
    assert [tuple(x) for x in r.runs] == [(1, 8, 2)] and r.kept == [0, 1, 2, 9] and b" ".join(r.words[i] for i in r.kept) == b"go a b end"
    assert repeating([b"q", b"r", b"s"], 7) == [b"q", b"r", b"s"]
