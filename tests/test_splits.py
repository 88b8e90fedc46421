"""Splits, folds and samples against all choices, or by what they promise."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sonogrid.operators import sampling, splits


def by_trial(sizes: list[int], target: float) -> list[int]:
    """The best subset's places, of all subsets."""
    n = len(sizes)
    every = (c for r in range(n + 1) for c in itertools.combinations(range(n), r))
    return list(min(every, key=lambda c: (abs(sum(sizes[i] for i in c) - target), len(c), c)))


def test_closest_is_the_best_of_all_subsets():
    rng = random.Random(1)
    for _ in range(150):
        sizes = sorted((rng.randrange(0, rng.choice([4, 30, 900])) for _ in range(rng.randrange(0, 11))), reverse=True)
        target = rng.random() * sum(sizes)
        assert splits.closest(sizes, target) == by_trial(sizes, target), (sizes, target)


def test_best_subset_of_any_number_of_keys(spark):
    rng = random.Random(2)
    few = spark.createDataFrame([(f"k{i}", rng.randrange(1, 2000)) for i in range(16)], "k string, n long")
    rows = few.orderBy(F.col("n").desc(), "k").collect()
    want = by_trial([r.n for r in rows], 0.37 * sum(r.n for r in rows))
    assert {r.k for r in splits.best_subset(few, "k", "n", 0.37).collect()} == {rows[i].k for i in want}
    for n, keys in ((200, 512), (3000, 64)):
        df = spark.createDataFrame([(i, rng.randrange(1, 5000)) for i in range(n)], "k int, n long")
        got, whole = splits.best_subset(df, "k", "n", 0.3, keys=keys).collect(), df.agg(F.sum("n")).first()[0]
        assert len({r.k for r in got}) == len(got) and abs(sum(r.n for r in got) - 0.3 * whole) <= 0.5
    coarse = splits.best_subset(few, "k", "n", 0.5, sums=100).agg(F.sum("n")).first()[0]
    assert abs(coarse - sum(r.n for r in rows) / 2) <= 16 * sum(r.n for r in rows) / 100
    assert splits.best_subset(few.limit(0), "k", "n", 0.5).count() == 0


def folded(rows, budget):
    out, left = [], budget
    for key, n in rows:
        if n <= left:
            out.append(key)
            left -= n
    return out


def test_fold_takes_few_rounds(spark, monkeypatch):
    rng = random.Random(3)
    kinds = {"falling": [2000 - i for i in range(1200)], "halves": [1 << max(0, 14 - i) for i in range(400)], "any": [rng.randrange(1, 9000) for _ in range(1500)], "small": [1] * 1500, "none": [20_000] * 5, "two": [9000, 8000] * 300}
    df = spark.createDataFrame([(k, i, n) for k, v in kinds.items() for i, n in enumerate(v)], "g string, i int, n long")
    tables, written = [], sampling.written
    monkeypatch.setattr(sampling, "written", lambda x: tables.append(x) or written(x))
    got = sampling.fold_budget(df, "g", ["i"], "n", 10_000.0).collect()
    for k, v in kinds.items():
        assert sorted(r.i for r in got if r.g == k) == folded(list(enumerate(v)), 10_000), k
    assert len(tables) <= 2 * (10_000).bit_length() + 3


def test_fold_looks_at_few_rows(spark, monkeypatch):
    """A round hands on what it settled, not all rows that could still be taken; a null group is a group."""
    rng = random.Random(5)
    rows = {g: [float(rng.randrange(100, 200)) for _ in range(3000)] for g in ("a", None)}
    df = spark.createDataFrame([(g, i, n) for g, v in rows.items() for i, n in enumerate(v)], "g string, i int, n double")
    sizes, written = [], sampling.written
    monkeypatch.setattr(sampling, "written", lambda x: sizes.append((y := written(x)).count()) or y)
    got = sampling.fold_budget(df, "g", ["i"], "n", 2000.0).collect()
    for g, v in rows.items():
        assert sorted(r.i for r in got if r.g == g) == folded(list(enumerate(v)), 2000.0)
    assert sizes[0] == 6000 and sum(sizes[1:]) < 6000 + 100


def test_fold_takes_rows_of_size_zero_when_nothing_is_left(spark):
    """0.1 + 0.7 + 0.2 is over 1 in some orders of addition."""
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([0.1, 0.7, 0.2, 0.0, 0.5, 0.0, 0.0])], "g string, i int, n double")
    assert sorted(r.i for r in sampling.fold_budget(df, "g", ["i"], "n", 0.9999999999999999).collect()) == [0, 1, 2, 3, 5, 6]


def test_fold_counts_equal_events_once(spark):
    df = spark.createDataFrame([("a", 1, 5, 3), ("a", 1, 5, 1), ("a", 1, 5, 2), ("a", 2, 5, 9), ("b", 1, 5, 4)], "g string, place int, n int, i int")
    assert sorted(r.i for r in sampling.fold_budget(df, "g", ["i"], "n", 100.0, ["g", "place", "n"]).collect()) == [1, 4, 9]


def choices(sizes, masks, test, train):
    """The least error of all choices in which both splits have the units of two files or more; None if no choice has."""
    need = 0
    for a, b in itertools.combinations(masks, 2):
        need |= a & b
    best = None
    for c in itertools.product((0, 1, 2), repeat=len(sizes)):
        sums, have = [0, 0, 0], [0, 0, 0]
        for k, s, m in zip(c, sizes, masks, strict=True):
            sums[k] += s
            have[k] |= m
        if have[1] & need == need and have[2] & need == need:
            off = abs(sums[1] - test) + abs(sums[2] - train)
            best = off if best is None else min(best, off)
    return best


def test_optimum_is_the_best_of_all_choices(spark):
    rng = random.Random(4)
    files, units, targets, want = [], [], [], {}
    for g in range(60):
        n, kinds = rng.randrange(1, 8), rng.randrange(1, 5)
        sizes, masks = [rng.randrange(1, 60) for _ in range(n)], [rng.randrange(0, 1 << kinds) for _ in range(n)]
        test, train = rng.randrange(0, sum(sizes)), rng.randrange(0, sum(sizes))
        files += [(g, f"f{k}", s) for k, s in enumerate(sizes)]
        units += [(g, f"f{k}", u) for k, m in enumerate(masks) for u in range(kinds) if m >> u & 1]
        targets.append((g, test, train))
        want[g] = choices(sizes, masks, test, train)
    f, u, t = spark.createDataFrame(files, "g int, f string, n long"), spark.createDataFrame(units, "g int, f string, unit int"), spark.createDataFrame(targets, "g int, test long, train long")
    got = splits.cover_optimum(f, u, t, "g", "f", "n").collect()
    ruled = splits.cover_by_rule(f, u, t, "g", "f", "n")
    off, rule = {r.g: r.off for r in got}, {r.g: (r.off, r.complete) for r in splits.errors(ruled, t, "g", "n").join(ruled.select("g", "complete").distinct(), "g").collect()}
    assert len({(r.g, r.f) for r in got}) == len(got) and all(r.proven for r in got)
    for g, best in want.items():
        if best is not None and g in off:
            assert off[g] == best and (not rule[g][1] or best <= rule[g][0]), g
        elif best is not None:  # nothing in either split is best
            assert best == sum(targets[g][1:])
    assert sum(b is not None for b in want.values()) > 20 and sum(rule[g][1] and rule[g][0] > off[g] for g in off if g in rule) > 10


@pytest.fixture
def many(spark):
    """Two groups of many files, one of them with very many."""
    rng = random.Random(5)
    rows = [(g, f"f{k}", rng.randrange(500, 9000), [u for u in range(12) if rng.random() < 0.2 or k in (u, u + 12)]) for g, n in (("a", 60), ("b", 3000)) for k in range(n)]
    files = spark.createDataFrame([r[:3] for r in rows], "g string, f string, n long")
    spans = spark.createDataFrame([(g, f, u, 30 * u, 30 * u + 25 + u) for g, f, _, us in rows for u in us], "g string, f string, unit int, on long, off long")
    targets = files.groupBy("g").agg(F.floor(F.sum("n") / 5).alias("test"), F.floor(F.sum("n") * 0.55).alias("train"))
    return files, spans, targets


def test_optimum_and_top_off_of_many_files(spark, many):
    files, spans, targets = many
    units = spans.select("g", "f", "unit")
    picked = splits.cover_optimum(files, units, targets, "g", "f", "n", most=40, states=2000)
    rule = {r.g: r.off for r in splits.errors(splits.cover_by_rule(files, units, targets, "g", "f", "n"), targets, "g", "n").collect()}
    rows = picked.collect()
    assert len({(r.g, r.f) for r in rows}) == len(rows) and all(r.feasible and r.off <= rule[r.g] for r in rows) and all(50 * r.off <= rule[r.g] for r in rows)
    want = {(r.g, s): r[s] for r in targets.collect() for s in ("test", "train")}
    for chosen in (picked, picked.where("f <> 'f3' and f <> 'f44'"), picked.unionByName(files.join(picked, ["g", "f"], "left_anti").withColumns({"split": F.lit("test"), "off": F.lit(0), "feasible": F.lit(True), "proven": F.lit(True)})), splits.cover_by_rule(files, units, targets, "g", "f", "n")):
        parts = splits.topped_off(chosen.select("g", "f", "n", "split"), files, spans, targets, "g", "f", "n")
        assert {(r.g, r.split): r.s for r in parts.groupBy("g", "split").agg(F.sum("length").alias("s")).collect()} == want
        assert parts.groupBy("g", "f").count().where("count > 1").count() == 0 and parts.join(files, ["g", "f"]).where("start < 0 or length < 1 or start + length > n").count() == 0
        before = {(r.g, r.split, r.unit) for r in spans.join(chosen.select("g", "f", "split"), ["g", "f"]).collect()}
        after = {(r.g, r.split, r.unit) for r in spans.join(parts, ["g", "f"]).where("on >= start and off <= start + length").collect()}
        assert before <= after


def test_groups_that_cannot_be_covered_or_filled(spark):
    files = spark.createDataFrame([("a", "f1", 10), ("a", "f2", 20), ("b", "g1", 7)], "g string, f string, n long")
    units = spark.createDataFrame([("a", "f1", 1), ("a", "f2", 1), ("a", "f2", 2), ("b", "g1", 5)], "g string, f string, unit int")
    targets = spark.createDataFrame([("a", 12, 15), ("b", 50, 50)], "g string, test long, train long")
    got = splits.cover_optimum(files, units, targets, "g", "f", "n").collect()
    assert {(r.g, r.off, r.feasible) for r in got} == {("a", 7, False), ("b", 93, False)}
    spans = units.withColumn("on", F.lit(1).cast("long")).withColumn("off", F.lit(3).cast("long"))
    parts = splits.topped_off(files.join(spark.createDataFrame([(r.g, r.f, r.split) for r in got], "g string, f string, split string"), ["g", "f"]), files, spans, targets, "g", "f", "n").collect()
    assert sum(r.length for r in parts if r.g == "b") == 7 and {r.split: r.length for r in parts if r.g == "a"} == {"test": 10, "train": 15}
    assert splits.cover_optimum(files.limit(0), units.limit(0), targets, "g", "f", "n").count() == 0


def test_covering_sample_keeps_units_and_the_budget(spark):
    rng = random.Random(6)
    files = spark.createDataFrame([(g, f"f{k}", 400 + 7 * k) for g in "ab" for k in range(12)], "g string, s string, total long")
    planned = [(g, u, f"f{u % 6}", on := rng.randrange(-5, 420), on + rng.randrange(0, 60), 150) for g in "ab" for u in range(9)]
    p = spark.createDataFrame(planned, "g string, unit int, s string, on long, off long, window_bins long").join(files, ["g", "s"])
    for budget in (100, 700, 1351, 3000, 9000):
        got = sampling.covering_sample(p, files, "g", "s", "total", budget, 3).collect()
        for g in "ab":
            own = [r for r in got if r.g == g]
            need = 0
            for _, u, s, on, off, _ in (x for x in planned if x[0] == g):
                total = 400 + 7 * int(s[1:])
                on = max(0, min(on, total - 1))
                off = min(max(off, on + 1), total)
                need += off - on
                assert any(r.unit == u and r.start <= on and r.end >= off and 0 <= r.start and r.end <= total for r in own)
            spent = sum(r.end - r.start for r in own)
            assert spent == max(need, budget) if budget <= 1350 or budget < 4000 else spent <= budget
            assert not {r.s for r in own if r.unit is None} & {f"f{u % 6}" for u in range(9)}
    whole = sampling.covering_sample(p, files, "g", "s", "total", 1500, 3, whole=True).where("g = 'a'").orderBy("unit").collect()
    assert [(r.s, r.end - r.start) for r in whole] == [("f0", 400), ("f1", 407), ("f2", 414), ("f3", 279)]
    assert sampling.covering_sample(p, files, "g", "s", "total", 1500, 3, truncate=False, whole=True).where("g = 'a' and unit is not null").count() == 3
