from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sonogrid.functions import arrays, names, time
from sonogrid.operators import intervals, metrics, sampling, splits, tables, windows
from sonogrid.plans import sampling as plans


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("name", "want"),
    [("clip__ms_100_900__ms_5_50", ("clip", 100, 900)), ("__ms_1_2__ms_3_4", ("__ms_1_2", 3, 4)), ("clip.npy", ("clip", None, None)), ("a__ms_1_2.wav", ("a", 1, 2)), ("", ("", None, None))],
)
def test_chunk_names(spark, name, want):
    assert tuple(spark.range(1).select(*names.parse_chunk(F.lit(name))).first()) == want


@pytest.mark.parametrize(("path", "stem", "loose"), [("/a/b.tar.npy", "b.tar", "/a/b.tar"), (".hidden", ".hidden", ""), ("plain", "plain", ""), ("a.b/c", "c", "a")])
def test_stems(spark, path, stem, loose):
    assert one(spark, names.stem(F.lit(path))) == stem and one(spark, names.loose_stem(F.lit(path))) == loose


@pytest.mark.parametrize(("ms", "cut", "rounded"), [(5.0, 2, 2), (7.0, 3, 4), (None, None, None)])
def test_rounding(spark, ms, cut, rounded):
    c = F.lit(ms).cast("double")
    assert one(spark, time.ms_to_bin(c, 32_000, 64)) == cut and one(spark, time.ms_to_bin(c, 32_000, 64, "half_even")) == rounded


def test_unknown_rounding_is_an_error():
    with pytest.raises(ValueError, match="rounding"):
        time.ms_to_bin(None, 1, 1, "up")


def test_clip_is_half_open(spark):
    units = spark.createDataFrame([("a", 100.0, 200.0), ("a", 150.0, 250.0), ("b", 150.0, 250.0)], "k string, onset_ms double, offset_ms double")
    chunks = spark.createDataFrame([("a", 200.0, 400.0), ("b", 200.0, None)], "k string, chunk_start double, chunk_end double")
    assert values(intervals.clip(units, chunks, "k").select("k", "onset_ms", "offset_ms"), "k") == [("a", 0.0, 50.0), ("b", 0.0, 50.0)]


@pytest.mark.parametrize(("rows", "tolerance", "want"), [([(0, 10), (10, 20), (21, 30)], 0, [(0, 20, 2), (21, 30, 1)]), ([(0, 10), (60, 70), (121, 130)], 50, [(0, 70, 2), (121, 130, 1)]), ([(0, 100), (5, 6), (50, 60)], 0, [(0, 100, 3)]), ([], 0, [])])
def test_merge(spark, rows, tolerance, want):
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in rows], "k string, onset_ms double, offset_ms double")
    assert values(intervals.merged(df, "k", tolerance=tolerance).select("onset_ms", "offset_ms", "n"), "onset_ms") == want


def test_paint_last_wins(spark):
    df = spark.createDataFrame([("a", 0, 10, 1, 0), ("a", 5, 8, 2, 1), ("a", 12, 14, 3, 2), ("a", 3, 3, 9, 3), ("b", 0, 4, 7, 0), ("b", 2, 6, 7, 1)], "k string, s int, e int, l int, o int")
    assert values(intervals.paint(df, "k", "s", "e", "l", "o"), "k", "start") == [("a", 0, 5, 1), ("a", 5, 8, 2), ("a", 8, 10, 1), ("a", 10, 12, 0), ("a", 12, 14, 3), ("b", 0, 6, 7)]


def test_gaps_count_no_overlap(spark):
    df = spark.createDataFrame([("a", 0.0, 10.0, 0), ("a", 5.0, 20.0, 1), ("a", 30.0, 40.0, 2)], "k string, onset_ms double, offset_ms double, ordinal int")
    assert values(intervals.gaps(df, ["k"]).select("ordinal", "gap_ms"), "ordinal") == [(0, None), (1, None), (2, 10.0)]


def test_range_join_in_buckets_equals_plain(spark):
    a = spark.createDataFrame([("k", i * 7 % 50, i * 7 % 50 + i % 13, i) for i in range(60)], "k string, a int, b int, i int")
    b = spark.createDataFrame([("k", i * 11 % 50, i * 11 % 50 + i % 9, i) for i in range(60)], "k string, c int, d int, j int")
    plain = intervals.range_join(a.where("b > a"), b.where("d > c"), "k", ("a", "b"), ("c", "d")).select("i", "j")
    assert values(intervals.range_join(a, b, "k", ("a", "b"), ("c", "d"), 5.0).select("i", "j"), "i", "j") == values(plain, "i", "j")


def test_majority_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(0, 2), (0, 2), (0, 1), (0, 1), (1, 1), (1, 0)], "w int, l int")
    assert values(metrics.majority(df, ["w"], "l"), "w") == [(0, 1), (1, 0)]


def test_absent_class_counts_in_macro_f1(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 1)], "k string, t int, p int")
    got = metrics.macro(metrics.confusion(df, ["k"], "t", "p", 3), ["k"]).first()
    assert round(got["macro_f1"], 2) == 66.67 and got["error_rate"] == 0


def test_vote(spark):
    df = spark.createDataFrame([("a", i, 1) for i in range(4)], "k string, i int, f int")
    assert [r[0] for r in df.select(windows.vote(df, "k", "i", "f", 4).alias("v"), "i").orderBy("i").collect()] == [0, 1, 1, 1]


def test_tiles_and_chunks(spark):
    df = spark.createDataFrame([("a", 5), ("b", 0)], "s string, n int")
    assert values(windows.tiles(df, "n", 3).select("s", "start", "length"), "s", "start") == [("a", 0, 3), ("a", 3, 2), ("b", 0, 0)]
    assert values(windows.chunks(df, "n", 3, 2, False).select("start", "end"), "start") == [(0, 3), (2, 5)]
    assert values(windows.chunks(df, "n", 3, 2, True).select("start", "end"), "start") == [(0, 3), (2, 5), (4, 5)]


def test_short_sequence_has_one_pooled_window(spark):
    df = spark.createDataFrame([("a", i, [float(i)]) for i in range(3)], "k string, i int, h array<double>")
    assert values(windows.pooled(df, "k", "i", "h", 8, 4), "window") == [("a", 0, 0, 1.0)]


def test_budget_cuts_or_stops(spark):
    df = spark.createDataFrame([("a", i, 4) for i in range(4)], "k string, i int, n int")
    assert [r["taken"] for r in windows.within_budget(df, ["k"], [F.col("i")], "n", 10).orderBy("i").collect()] == [4, 4, 2]
    assert windows.within_budget(df, ["k"], [F.col("i")], "n", 10, False).count() == 2


def fold(rows, budget):
    out, left = [], budget
    for key, n in rows:
        if n <= left + 1e-9:
            out.append(key)
            left -= n
    return out


def test_fold_budget_by_hand(spark):
    rows = [(i, float((i * 37) % 23 + 1)) for i in range(200)]
    df = spark.createDataFrame([("a", i, n) for i, n in rows] + [("b", i, n + 90) for i, n in rows], "k string, i int, n double")
    got = sampling.fold_budget(df, "k", ["i"], "n", 100.0)
    for k, more in (("a", 0), ("b", 90)):
        assert sorted(r["i"] for r in got.where(F.col("k") == k).collect()) == fold([(i, n + more) for i, n in rows], 100.0)
    assert sampling.fold_budget(df.limit(0), "k", ["i"], "n", 1.0).count() == 0


def test_fold_query_by_hand(spark, data):
    from sonogrid.functions.names import shuffled
    from sonogrid.sources import testviews as v

    u = v.units(spark, data).select("bird_id", "ordinal", (F.col("offset_ms") - F.col("onset_ms")).alias("ms"), shuffled(17, F.col("ordinal")).alias("o")).collect()
    want = {(b, k) for b in {r.bird_id for r in u} for k in fold([(r.ordinal, r.ms) for r in sorted(u, key=lambda r: (r.o, r.ordinal)) if r.bird_id == b], 5000.0)}
    assert {(r.bird_id, r.ordinal) for r in plans.event_budget_fold(spark, data).collect()} == want


def test_cover_split_is_disjoint_and_covers(spark):
    files = spark.createDataFrame([("a", f"f{i}", 10) for i in range(12)] + [("b", "g0", 10)], "b string, f string, n int")
    units = spark.createDataFrame([("a", f"f{i}", u) for i in range(12) for u in (i % 3, 3)] + [("b", "g0", 0)], "b string, f string, unit int")
    got = sampling.cover_split(files, units, "b", "f", "n", 40, 60).collect()
    assert len({(r.b, r.f) for r in got}) == len(got)
    by = {s: {r.f for r in got if r.split == s and r.b == "a"} for s in ("test", "train")}
    for chosen in by.values():
        assert {u.unit for u in units.collect() if u.f in chosen} == {0, 1, 2, 3}
    assert all(r.feasible == (r.b == "a") for r in got) and len(by["test"]) >= 4 and len(by["train"]) >= 6


def test_placed_clips_never_overlap(spark):
    df = spark.createDataFrame([("a", i, i + 1) for i in range(8)] + [("b", 0, 100)], "g string, i int, n int")
    got = sampling.placed(df, "g", "i", "n", F.lit(50)).orderBy("onset").collect()
    assert {r.g for r in got} == {"a"} and all(x.onset + x.n <= y.onset for x, y in zip(got, got[1:])) and got[-1].onset + got[-1].n <= 50


def test_best_subset_and_its_guard(spark):
    df = spark.createDataFrame([(c, n) for c, n in zip("abcd", (9, 5, 4, 2))], "k string, n int")
    assert sorted(r.k for r in splits.best_subset(df, "k", "n", 0.55).collect()) == ["a", "d"]
    with pytest.raises(ValueError, match="at most"):
        splits.best_subset(df, "k", "n", 0.5, most=3)


def test_tables(spark):
    old = spark.createDataFrame([("r1", 1)], "run_name string, x int")
    new = spark.createDataFrame([("r1", 5, 1), ("r2", 2, 1)], "run_name string, x int, y int")
    assert values(tables.insert_only(old, new, "run_name"), "run_name") == [("r1", 1, None), ("r2", 2, 1)]
    with pytest.raises(ValueError, match="columns differ"):
        tables.concatenated(old, new)


def test_vectors(spark):
    a = F.array(*map(F.lit, (1.0, 3.0, 2.0)))
    assert one(spark, arrays.argmax(a)) == 1 and abs(one(spark, arrays.total(arrays.softmax(a))) - 1) < 1e-12
    assert one(spark, arrays.cosine(a, F.array(*map(F.lit, (0.0, 0.0, 0.0))))) is None
    assert one(spark, arrays.interpolated(a, F.lit(0.5))) == 2.0 and one(spark, arrays.min_max(a))[1] > 0.99
    assert one(spark, arrays.pad_right(a, 5, F.lit(0.0))) == [1, 3, 2, 0, 0]


@pytest.mark.parametrize(("text", "want"), [(" max ", (True, None)), ("0p5", (False, 0.5)), ("16", (False, 16.0)), ("", (False, None)), (None, (None, None))])
def test_train_seconds(spark, text, want):
    assert tuple(spark.range(1).select(*names.train_seconds(F.lit(text).cast("string"))).first()) == want


@pytest.mark.parametrize(("last", "want"), [(None, "unknown"), (-9, "none"), (0, "0"), (1, "0,1"), (9, "all"), (-1, "all"), (-3, "0,1")])
def test_frozen_layers(spark, last, want):
    assert one(spark, names.frozen_layers(F.lit(last).cast("int"), 4)) == want


def test_skipped_rows_are_counted(spark):
    from pyspark.sql import Observation

    df = tables.with_reason(spark.range(10).withColumn("ms", F.col("id") * 10), {"short": F.col("ms") < 30, "odd": F.col("id") % 2 == 1})
    assert {r.skip_reason for r in df.collect()} == {"short", "odd", None}
    seen = Observation()
    assert tables.counted(df, seen).count() == 3 and seen.get == {"processed": 3, "skipped": 7}


def test_encoder_hook(spark):
    from sonogrid.operators.models import encoded

    df = spark.createDataFrame([(1, [[1.0, 3.0], [5.0, 7.0]])], "w long, spec array<array<float>>")
    assert encoded(df, "w", "spec", lambda x: x.mean(axis=1)).first()["h"] == [2.0, 6.0]


@pytest.mark.parametrize(("x", "want"), [(0.0, "0"), (1e-4, "0.0001"), (0.00001, "1e-05"), (100000.0, "100000"), (1234567.0, "1.23457e+06"), (-2.50, "-2.5"), (999999.5, "1e+06"), (float("-inf"), "-inf"), (None, None)])
def test_general_numbers(spark, x, want):
    assert one(spark, names.general(F.lit(x).cast("double"))) == want


def test_dense_window_reads_once(spark, data):
    """One scan, one exchange and one sort by time, in as many parts as are asked for, however small the parts are before."""
    from sonogrid.plans import timeline

    df = timeline.dense_window(spark, data)
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan and "Union" not in plan and plan.count("Window [") == 2


def test_painted_runs_are_dealt_by_key(spark, data):
    """What follows a painting makes many rows of few, so its parts are not joined by their size."""
    from sonogrid.plans import timeline

    df = timeline.paint_last_wins(spark, data)
    df.collect()
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_drawn_hashes_once(spark, data):
    """As the number does, and each bin is hashed once, by tasks that got equal shares."""
    from sonogrid.plans import settings

    p = F.conv(F.substring(names.shuffled(37, F.col("id")), 1, 8), 16, 10).cast("double") / 4294967296.0
    for share in (0.0, 1e-9, 0.25, 1 / 3, 0.9, 1.0):
        assert spark.range(3000).where(names.drawn(share, 37, F.col("id")) != (p < share)).count() == 0
    df = settings.bernoulli_mask(spark, data)
    df.collect()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and "RepartitionByExpression" in plan


@pytest.mark.parametrize(("x", "want"), [(1000005.0, "1e+06"), (1000015.0, "1.00002e+06"), (-1000025.0, "-1.00002e+06"), (8700125 / 7.0 * 1e-6, "1.24287"), (2.5e-7, "2.5e-07"), (float("nan"), "nan")])
def test_general_rounds_the_binary_number(spark, x, want):
    assert one(spark, names.general(F.lit(x).cast("double"))) == want


@pytest.mark.parametrize(
    ("path", "want"),
    [("/a/detect/classify/b1/train_2p5s", ("b1", "2.5")), ("/a/unit_detect", ("", "9")), ("detect/x", ("all", "9")), ("/s/b7/val", ("b7", "9")), ("", ("", "9")), ("/s/b7", ("", "9")), (None, ("", "9"))],
)
def test_train_folders(spark, path, want):
    assert tuple(spark.range(1).select(*names.train_folder(F.lit(path).cast("string"), F.lit("9\n"))).first()) == want


def test_noise_is_normal_and_the_same_again(spark):
    df = spark.range(200).select(arrays.noisy(F.array_repeat(F.lit(1.0), 100), 0.5, 3, F.col("id")).alias("a")).select(F.explode("a").alias("x"))
    m = df.agg(F.mean("x").alias("mean"), F.stddev("x").alias("std"), F.kurtosis("x").alias("k"), F.sum("x").alias("s")).first()
    assert abs(m.mean - 1) < 0.02 and abs(m["std"] - 0.5) < 0.02 and abs(m.k) < 0.15 and df.agg(F.sum("x")).first()[0] == m.s


def test_paint_equals_bins_painted_one_by_one(spark):
    import random

    rng, units = random.Random(7), []
    for i in range(600):
        s = rng.randrange(300)
        units.append((rng.choice("abc"), s, s + rng.choice([0, 1, 5, 40, 200]), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, *range(600)]), i))
    units += [(None, 0, 9, 1, 1, 900), ("d", 5, 3, 1, 1, 901)]
    df = spark.createDataFrame(units, "k string, s bigint, e bigint, l bigint, p int, i int").withColumn("o", F.struct("p", "i")).withColumn("x", F.lit(1))

    def runs(silence):
        top = {}
        for k, s, e, label, p, i in sorted((u for u in units if u[0]), key=lambda u: (u[4] is not None, u[4] or 0, u[5])):
            for t in range(s, e):
                top[k, t] = silence if label is None else label
        if silence is not None:
            for k in {k for k, _ in top}:
                at = [t for j, t in top if j == k]
                for t in range(min(at), max(at)):
                    top.setdefault((k, t), silence)
        out = []
        for k, t in sorted(top):
            if out and out[-1][0] == k and out[-1][2] == t and out[-1][3] == top[k, t]:
                out[-1][2] += 1
            else:
                out.append([k, t, t + 1, top[k, t]])
        return sorted(map(tuple, out))

    for width in (7, 1000):
        for silence in (0, None):
            got = intervals.paint(df, "k", "s", "e", "l", "o", silence, width)
            assert sorted(map(tuple, got.collect())) == runs(silence), (width, silence)
    empty = intervals.paint(df.where("false"), "k", "s", "e", "l", "o")
    assert empty.collect() == [] and empty.columns == ["k", "start", "end", "label"]


def test_clip_in_buckets_equals_plain(spark):
    units = spark.createDataFrame([(k, i, float(i * 13 % 97), float(i * 13 % 97 + 1 + i % 30)) for i in range(200) for k in ("a", "b")], "k string, i int, onset_ms double, offset_ms double")
    chunks = spark.createDataFrame([("a", 0.0, 50.0), ("a", 50.0, None), ("b", 20.0, 40.0), ("c", 0.0, None)], "k string, chunk_start double, chunk_end double")
    columns = ["k", "i", "chunk_start", "chunk_end", "onset_ms", "offset_ms"]
    assert sorted(map(str, intervals.clip(units, chunks, "k", width=9.0).select(columns).collect())) == sorted(map(str, intervals.clip(units, chunks, "k").select(columns).collect()))
