"""Operators that compare documents: SimHash, suffix arrays, components, and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sonogrid.llm import simhash, suffix_dedup
from sonogrid.llm.components import components
from tests.llm.test_text import ODD, WORD, docs, labels


def fingerprint(text: str, shingle: int = 3) -> int:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    found = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(pairs, values):
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def test_simhash_groups(spark):
    random.seed(1)
    base = [" ".join(random.choices("the of and In to a is Was for as with by on at it".split(), k=random.randrange(3, 200))) for _ in range(60)]
    rows = [(100 + i, random.choice(base) + random.choice(["", " x", " The end", " a b c d"])) for i in range(400)]
    d = docs(spark, [r for r in ODD if r[0] is not None] + rows)
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    fps = {i: fingerprint(t) for i, t in texts.items()}
    ids = sorted(fps)
    want = roots([(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], ids)
    for tile in (4096, 2):
        got = simhash.simhash_groups(d, tile=tile).collect()
        assert len(got) == d.count() and all(r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id] for r in got)
    assert simhash.simhash_groups(d.limit(0)).count() == 0
    lone = {r.fingerprint: r.component_id for r in simhash.simhash_groups(docs(spark, [(None, "some words here"), (None, ""), (3, " ")])).collect()}
    assert lone["0" * 16] == 3 and None in lone.values()


def test_tiles_compare_all_pairs():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, (20, 1), dtype=np.uint64)
    fps = np.unique(np.repeat(centres, 60) ^ (np.uint64(1) << rng.integers(0, 64, 1200).astype(np.uint64)))[:, None]
    links = simhash.Links(most=500)
    simhash.compare_tiles(np.arange(len(fps)), fps, 3, links, tile=32)
    a, b = links.forest()
    got = roots(zip(a.tolist(), b.tolist(), strict=True), range(len(fps)))
    assert got == roots([(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i, 0] ^ fps[j, 0]).bit_count() <= 3], range(len(fps)))


def test_near_duplicates(spark):
    random.seed(3)
    text = lambda n: [f"w{random.randrange(5000)}" for _ in range(n)]
    rows, groups = [], 0
    for g in range(30):
        words = text(300)
        for k in range(4):
            copy = list(words)
            for at in random.sample(range(300), k * 2):
                copy[at] = "zz"
            rows.append((10 * g + k, " ".join(copy)))
        groups += 1
    rows += [(1000 + i, " ".join(text(300))) for i in range(200)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, rows), tile=16).collect()}
    assert sum(got[10 * g + k] == 10 * g for g in range(30) for k in range(4)) >= 117 and all(got[1000 + i] == 1000 + i for i in range(200))


def jaccard_roots(rows, similarity=0.8):
    """By brute force: the smallest id that pairs of similar sets of five-word shingles reach."""
    sets = {i: set(simhash.shingle_hashes(t, 5)) for i, t in rows}
    alike = lambda a, b: a == b or 10 * len(a & b) >= round(10 * similarity) * len(a | b)
    pairs = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    return roots(pairs, sets), pairs


def test_near_duplicates_at_the_similarity(spark):
    """Pairs from 0.8 to 0.85 are found, whatever their length; so are those of very short texts."""
    random.seed(6)
    rows = []
    for g in range(400):
        n = random.choice((8, 12, 30, 60, 200, 600))
        words = [f"w{random.randrange(9000)}" for _ in range(n)]
        # c of the n - 4 shingles are left off: (n - 4 - c) / (n - 4) is 0.8 or a little more.
        c = (n - 4) // 5
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[c:]))]
    want, pairs = jaccard_roots(rows)
    assert len(pairs) == 400
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, rows), tile=64).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 398 and all(got[i] >= want[i] for i in got)


def similar_pairs(texts: list[str], similarity: float = 0.8) -> list[tuple[int, int, float]]:
    """All pairs of different sets of five-word shingles that are as similar: sets that are share one of their rarest shingles."""
    sets = {}
    for k, t in enumerate(texts):
        sets.setdefault(simhash.shingle_set(t, 5).tobytes(), k)
    sets = {k: np.frombuffer(x, np.uint64).tolist() for x, k in sets.items()}
    n = Counter(h for x in sets.values() for h in x)
    index, pairs = {}, {}
    for k, x in sets.items():
        first = sorted(x, key=lambda h: (n[h], h))[: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1]
        for j in {j for h in first for j in index.get(h, ())}:
            shared = len(set(x) & set(sets[j]))
            pairs[j, k] = shared / (len(x) + len(sets[j]) - shared)
        for h in first:
            index.setdefault(h, []).append(k)
    return [(j, k, s) for (j, k), s in pairs.items() if s >= similarity - 1e-9]


def test_recall_of_near_duplicates(spark):
    """Over all documents of sf0.1: of the pairs from 0.80 to 0.82, 0.82 to 0.85 and above, found / all."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = d.select("doc_id", "text").collect()
    root = {r.doc_id: r.component_id for r in simhash.near_duplicates(d).collect()}
    found, total = Counter(), Counter()
    for j, k, s in similar_pairs([r.text or "" for r in rows]):
        band = 0 if s < 0.82 else 1 if s < 0.85 else 2
        total[band] += 1
        found[band] += root[rows[j].doc_id] == root[rows[k].doc_id]
    print("found", dict(found), "of", dict(total))
    assert all(found[b] >= 0.98 * total[b] for b in total) and sum(total.values()) > 40


@pytest.mark.parametrize("n", [0, 10**6, 10**9, 10**11])
def test_lanes_grow_with_the_number_of_sets(n):
    p = math.acos(1.6 / 1.8) / math.pi
    half, pairs = simhash.lanes(n, p, simhash.WIDE)
    assert n / 4 ** half <= simhash.TILE and len(set(pairs)) == len(pairs) and max(max(x) for x in pairs) < 64 // half * simhash.WIDE
    assert (1 - (1 - p) ** (2 * half)) ** len(pairs) <= simhash.MISS


def test_dense_spanning_joins_what_all_pairs_join():
    rng = np.random.default_rng(3)
    for k in range(60):
        n, m = rng.integers(1, 40, 2)
        far = rng.integers(0, 9, (n, m)).astype(np.int16)
        square = k % 2 == 0
        if square:
            far = np.minimum(far[:, :1], far[:, :1].T) + np.abs(far[:, :1] - far[:, :1].T)
        x, y = simhash.dense_spanning(far, 4, square)
        shift = 0 if square else n
        i, j = np.nonzero(far <= 4)
        values = range(len(far) + (0 if square else m))
        weigh = lambda a, b: sorted(far[p, q] for p, q in zip(a, b, strict=True))
        assert roots(zip(x.tolist(), (y + shift).tolist(), strict=True), values) == roots(zip(i.tolist(), (j + shift).tolist(), strict=True), values)
        assert (far[x, y] <= 4).all()
        kept = simhash.spanning(i[i != j + shift], j[i != j + shift] + shift, far[i, j][i != j + shift])
        off = x != y + shift
        best = simhash.spanning(x[off], y[off] + shift, far[x, y][off])
        a, b = i[i != j + shift], j[i != j + shift]
        assert weigh(x[off][best], y[off][best]) == weigh(a[kept], b[kept])


def test_links_below_the_similarity_do_not_count(spark):
    """Copies at about 0.72 to 0.78 stay apart, chained or not; repeats of a line don't count, and groups are joined however they are dealt."""
    random.seed(7)
    word = lambda: f"w{random.randrange(9000)}"
    rows = []
    for g in range(100):
        words = [word() for _ in range(204)]
        rows += [(10 * g + k, " ".join(words[k * 26 : 204])) for k in range(2)]
        rows += [(10 * g + 2 + k, " ".join([*words[26:], *(word() for _ in range(25 * k))])) for k in range(2)]
    line = " ".join(word() for _ in range(8)) + "\n"
    rows += [(5000 + i, line * 200 + " ".join(word() for _ in range(40))) for i in range(10)]
    body = " ".join(word() for _ in range(400))
    rows += [(6000, body), (6001, body + "\n" + line * 300)]
    wide = [word() for _ in range(300)]
    rows += [(7000 + i, " ".join(wide[2 * i : 2 * i + 200])) for i in range(40)]
    want, _ = jaccard_roots(rows)
    for members in (simhash.MEMBERS, 8):
        groups = simhash.near_groups(docs(spark, rows), members=members).collect()
        first: dict = {}
        for r in groups:
            first[r.root] = min(r.doc_id, first.get(r.root, r.doc_id))
        assert {r.doc_id: first[r.root] for r in groups} == want
    assert len({want[5000 + i] for i in range(10)}) == 10 and want[6001] == 6000


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 52), (60, 52)], [(-5, 3), (3, 9), (3, 9)], [(i, i + 1) for i in range(0, 3000)] + [(5000 + (i * 7919) % 900, 5000 + (i * 104729) % 900) for i in range(700)]])
def test_components(spark, pairs):
    got = {r.vertex: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == roots([p for p in pairs if p[0] != p[1]], {v for p in pairs if p[0] != p[1] for v in p})


def removed(rows: list[tuple[int, bytes]], length: int = 50) -> list[tuple]:
    first: dict[bytes, int] = {}
    for i, t in sorted(rows):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    out = []
    for i, t in rows:
        covered = bytearray(len(t) + 1)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                covered[p : p + length] = b"\1" * length
        kept = bytes(c for c, v in zip(t, covered) if not v)
        out.append((i, len(t), len(t) - len(kept), sum(1 for k in range(len(t)) if covered[k] and (k == 0 or not covered[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark, monkeypatch):
    random.seed(4)
    common = "".join(random.choices("abcdé \0", k=400))
    rows = []
    for i in range(120):
        own = "".join(random.choices("abcdefgh ", k=random.randrange(120)))
        a = random.randrange(300)
        rows.append((i // 2 if i % 9 == 0 else i, own + common[a : a + random.randrange(30, 130)] + random.choice(["", own, "x" * 160])))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (504, "y" * 49), (505, "y" * 50), (506, "y" * 51)]
    d = docs(spark, [*rows, (None, common), *[r for r in ODD if r[0] not in (None, 7)]])
    want = removed([(r.doc_id, (r.text or "").encode()) for r in d.where("doc_id IS NOT NULL").collect()])
    for kw in ({}, {"shard_bytes": 3000, "hot": 3}):
        # With one row in so many, every repeated text is a heavy one.
        monkeypatch.setattr(suffix_dedup, "HEAVY", 10_000 if kw else 1 << 40)
        # Some anchors are common ones.
        monkeypatch.setattr(suffix_dedup, "SEEN", 2 if kw else 16)
        monkeypatch.setattr(suffix_dedup, "COMMON", 4 if kw else 16_384)
        got = suffix_dedup.suffix_dedup(d, **kw).collect()
        assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
        assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert suffix_dedup.suffix_dedup(d.limit(0)).count() == 0


def test_suffix_dedup_of_long_runs(spark):
    """Runs of a byte and of short periods, very long, within documents and across them; a context of many places is sent once."""
    random.seed(15)
    own = lambda n: "".join(random.choices("abcdefgh", k=n))
    rows = [(1, own(60) + "-" * 30_000 + own(60)), (2, own(20) + "-" * 400 + own(70) + "-" * 90), (3, "ab" * 8000 + own(30)), (4, own(80) + "ba" * 100 + own(9)), (5, own(70_000)), (6, "-" * 49 + own(50)), (7, own(10) + "xyz" * 900), (8, "yzx" * 40 + own(60))]
    rows += [(9, rows[4][1][1000:60_000]), (9, "-" * 70)]
    d = docs(spark, rows)
    want = removed([(i, t.encode()) for i, t in rows])
    for kw in ({}, {"shard_bytes": 20_000, "hot": 2}):
        assert sorted(tuple(r) for r in suffix_dedup.suffix_dedup(d, **kw).collect()) == want
    raw = (b"q" * 80 + b"-" * 100_000 + b"r" * 80,)
    lengths = np.array([len(x) for x in raw])
    found = suffix_dedup.anchors(np.frombuffer(b"".join(raw), np.uint8), lengths, 50)
    assert len(found[0]) > 90_000 and len(np.unique(found[0] ^ found[2])) < 400


def test_common_anchors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(int(h), int(c), int(d)) for h, c, d in zip(rng.zipf(1.4, 4000) % 300, rng.integers(-9, 9, 4000), rng.integers(0, 10**6, 4000), strict=True)]
    table = spark.createDataFrame(rows, "hash long, context long, doc long")
    own = {}
    for h, c, d in rows:
        own.setdefault(h, []).append((c, d))
    assert suffix_dedup.common_anchors(table, 80).collect() == []
    monkeypatch.setattr(suffix_dedup, "COMMON", 200)
    for common in (table.select("hash", F.lit(1).alias("expected")).limit(0), suffix_dedup.common_anchors(table, 80), table.select("hash", F.lit(95).cast("long").alias("expected")).distinct()):
        often = {r.hash: r.expected for r in common.collect()}
        want = []
        for h, c, d in rows:
            least = min(y for x, y in own[h] if x == c)
            if h in often or len(own[h]) > 1 and (d > least or len({x for x, _ in own[h]}) > 1):
                want.append((d, h, c, 0 if d > least else -(-often.get(h, len(own[h])) // 10)))
        assert sorted(tuple(r) for r in suffix_dedup.shared_anchors(table, common, 10).collect()) == sorted(want)
    assert 0 < suffix_dedup.common_anchors(table, 80).count() < len(own)


def test_suffix_arrays_and_prefixes():
    random.seed(5)
    for k in range(60):
        base = bytes(random.choices(bytes(range(97, 97 + random.choice((1, 2, 4, 26)))), k=random.randrange(1, 300)))
        t = base + base[: random.randrange(len(base) + 1)] + b"\0" * (k % 3 * 30)
        b, length = np.frombuffer(t, np.uint8), random.choice((33, 50, 64))
        order, _ = suffix_dedup.suffixes(b, length)
        shared = suffix_dedup.common_prefixes(b, order, length)
        assert sorted(order.tolist()) == list(range(len(t)))
        for i in range(1, len(t)):
            x, y = t[order[i - 1] :][:length], t[order[i] :][:length]
            assert x.rstrip(b"\0") <= y.rstrip(b"\0")
            assert shared[i] == next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    d = "/root/testdata/sf0.01"
    source = spark.read.parquet(f"{d}/documents.parquet")
    lab = spark.read.parquet(f"{d}/labels.parquet")
    now, kept = source, {}
    for name, stage in pipeline.STAGES[:-1]:
        now = pipeline.written(stage(spark, now, d))
        assert now.columns == source.columns and now.dtypes == source.dtypes
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
    names = [n for n, _ in pipeline.STAGES]
    good = {r.doc_id for r in lab.where("quality = 1").collect()}
    assert len(good - kept[names[0]]) <= 0.02 * len(good) and len(kept[names[0]] & {r.doc_id for r in lab.where("quality = 0").collect()}) <= 2
    texts = [r.text for r in source.where(source.doc_id.isin(*list(kept[names[1]]))).collect()]
    assert len(set(texts)) == len(texts)
    assert kept[names[3]] == kept[names[2]] < kept[names[1]] < kept[names[0]]
    text = "\n".join(r.text for r in now.collect())
    assert "[secret]" in text and not [1 for m in simhash_free(text)]
    packed = pipeline.STAGES[-1][1](spark, now, d)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept[names[3]]


def simhash_free(text: str):
    """What the secret scan would still find."""
    from tests.llm.test_text import base_spans

    return base_spans(text)


def test_pipeline_odd_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    bench = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (ODD, []):
        docs(spark, rows).select(*pipeline.COLUMNS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        # Without labels nothing is learned and no score is high; the other stages take the rows as they are.
        assert pipeline.run(spark, str(tmp_path)).collect() == []
        d = docs(spark, rows).select(*pipeline.COLUMNS)
        for _, stage in pipeline.STAGES[1:]:
            d = stage(spark, d, str(tmp_path))
        pieces = d.collect()
        assert bool(pieces) == bool(rows) and {p.doc_id for p in pieces} <= {r[0] for r in rows}
        for sequence in {p.sequence_id for p in pieces}:
            at = sorted((p.offset, p.length) for p in pieces if p.sequence_id == sequence)
            assert [o for o, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))] and sum(n for _, n in at) <= 1024


def test_pipeline_rows_without_an_id_of_their_own(spark, tmp_path):
    """Null and repeated ids: each decision reaches its own row, and a corpus loaded twice leaves each text once."""
    import corpus_pipeline as pipeline

    random.seed(10)
    text = lambda n: " ".join(f"w{random.randrange(9000)}" for _ in range(n))
    item, copied, clean, lone = text(30), text(100), text(100), text(100)
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = f"{text(20)} {item} {text(20)}"
    rows = [(1, copied), (1, copied), (2, copied), (None, copied), (2, clean), (None, lone), (None, lone), (3, leak), (3, text(50)), (None, leak)]
    d = docs(spark, rows).select(*pipeline.COLUMNS)
    got = sorted((r.doc_id or 0, r.text) for r in pipeline.near_duplicates(spark, d, str(tmp_path)).collect())
    assert got == sorted([(1, copied), (2, clean), (0, lone), (3, leak), (3, rows[8][1])])
    free = sorted((r.doc_id or 0, r.text) for r in pipeline.benchmark_free(spark, d, str(tmp_path)).collect())
    assert free == sorted((i or 0, t) for i, t in rows if t != leak)


def test_quality_stage_judges_each_row(spark):
    import corpus_pipeline as pipeline
    from sonogrid.llm.quality_classifier import quality_classifier

    d = "/root/testdata/sf0.01"
    source = spark.read.parquet(f"{d}/documents.parquet").select(*pipeline.COLUMNS)
    bad = [r.doc_id for r in quality_classifier(source, spark.read.parquet(f"{d}/labels.parquet")).where("predicted = 0").collect()]
    assert bad
    no_ids = source.withColumn("doc_id", simhash.F.when(~simhash.F.col("doc_id").isin(bad), simhash.F.col("doc_id")))
    both = source.unionByName(no_ids.where("doc_id IS NULL"))
    kept = pipeline.quality(spark, both, d).collect()
    assert len(kept) == source.count() - len(bad) and all(r.doc_id is not None for r in kept)


def test_a_round_of_components_tells_each_link_once(spark):
    """Hot vertices, chains and rings: each link gets one row, its smaller end's least neighbour in its place."""
    from sonogrid.llm.components import lowered

    random.seed(8)
    pairs = {(max(p), min(p)) for p in [(k, 0) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5400)] + [random.sample(range(9000), 2) for _ in range(1500)]}
    stars = spark.createDataFrame(sorted(pairs), "u long, v long")
    least = {}
    for u, v in pairs:
        least[u] = min(v, least.get(u, v))
    assert sorted(map(tuple, lowered(stars, len(pairs)).collect())) == sorted((u, least.get(v, v)) for u, v in pairs)
    got = {r.vertex: r.root for r in components(stars.selectExpr("v AS a", "u AS b")).collect()}
    assert got == roots(pairs, {x for p in pairs for x in p})
