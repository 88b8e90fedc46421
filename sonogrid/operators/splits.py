"""Splits that come as close to their totals as can be: subsets of keys, and test and train files that cover all units.

The searches are for bounded numbers of rows of a group; what a group has beyond is settled
before, by sums that Spark spreads. Each says whether its result is the best there is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonogrid.functions.names import shuffled
from sonogrid.operators import windows
from sonogrid.scratch import written

#: Keys whose subsets are searched at most, and the largest sum of sizes that a table of sums may have.
KEYS, SUMS = 512, 1 << 22
#: Files of a group that are searched at most, and states that a step of the search keeps.
FILES, STATES = 256, 1 << 14
UNREACHED = np.iinfo(np.int32).max // 2


def closest(sizes: list[int], target: float) -> list[int]:
    """Places of the sizes (whole numbers) whose sum is closest to the target; of equal ones the fewest, then the first places.

    A table of sums is made from the last size on; it is kept at every square root of the sizes and made again in between.
    """
    n, total = len(sizes), sum(sizes)
    step = max(1, int(n**0.5))
    table = np.full(total + 1, UNREACHED, np.int32)
    table[0] = 0
    kept = {n: table}
    for i in range(n - 1, -1, -1):
        if sizes[i]:
            table = np.concatenate([table[: sizes[i]], np.minimum(table[sizes[i] :], table[: -sizes[i]] + 1)])
        if i % step == 0:
            kept[i] = table
    sums = np.flatnonzero(table < UNREACHED)
    off = np.abs(sums - target)
    ties = sums[off == off.min()]
    ties = ties[table[ties] == table[ties].min()]

    def places(left: int) -> list[int]:
        out, number = [], int(table[left])
        for start in range(0, n, step):
            end = min(n, start + step)
            after = {end: kept[end]} if end in kept else {end: kept[n]}
            for i in range(end - 1, start, -1):
                t = after[i + 1]
                after[i] = np.concatenate([t[: sizes[i]], np.minimum(t[sizes[i] :], t[: -sizes[i]] + 1)]) if sizes[i] else t
            for i in range(start, end):
                if number and sizes[i] and sizes[i] <= left and after[i + 1][left - sizes[i]] == number - 1:
                    out.append(i)
                    left, number = left - sizes[i], number - 1
        return out

    return min(places(int(s)) for s in ties.tolist())


def best_subset(totals: DataFrame, key: str, size: str, share: float, most: int | None = None, keys: int = KEYS, sums: int = SUMS) -> DataFrame:
    """The keys whose sizes (whole numbers, not negative) come closest to a share of the whole; of equal subsets the smaller, then the first by the keys' order (largest first).

    Up to `keys` keys whose sizes sum up to `sums` (over their common divisor) are searched whole. Of more keys all but some hundred are taken or left by their hash, up to
    the share, and the rest is searched. Larger sums are searched in steps of sum / sums, so the result is within half a step for each key searched.
    `most` is a guard: more keys raise an error.
    """
    n = totals.count()
    if most is not None and n > most:
        raise ValueError(f"{n} keys; subsets of at most {most} can be tried")
    whole = totals.agg(F.coalesce(F.sum(size), F.lit(0)).alias("s")).first()["s"]
    target, pool, settled = float(whole) * share, totals, None
    while n > keys:
        # Buckets of keys by hash are taken whole up to the one that would pass the target, which is searched on.
        parts = min(65_536, -(-2 * n // keys))
        pool = written(pool.withColumn("_part", F.pmod(F.xxhash64(key, F.lit(n)), F.lit(parts)).cast("int")))
        sized = pool.groupBy("_part").agg(F.sum(size).alias("s")).orderBy("_part").collect()
        k = 0
        while k < len(sized) - 1 and sized[k]["s"] <= target:
            target, k = target - float(sized[k]["s"]), k + 1
        chosen = pool.where(F.col("_part") < sized[k]["_part"]).drop("_part")
        settled = chosen if settled is None else settled.unionByName(chosen)
        pool = written(pool.where(F.col("_part") == sized[k]["_part"]).drop("_part"))
        n = pool.count()
    rows = pool.select(key, size).orderBy(F.col(size).desc(), F.col(key)).collect()
    sizes = [int(r[size]) for r in rows]
    unit = max(1, int(np.gcd.reduce(np.array(sizes, dtype=np.int64)))) if sizes else 1
    unit *= max(1, -(-(sum(sizes) // unit) // sums))
    best = closest([(s + unit // 2) // unit for s in sizes], target / unit)
    out = pool.sparkSession.createDataFrame([tuple(rows[i]) for i in best], pool.select(key, size).schema)
    return out if settled is None else settled.select(key, size).unionByName(out)


# Test and train


class Search:
    """Choices of test and train files in order, as states: the bins of both and the units they have; the best complete one is kept."""

    def __init__(self, sizes: list[int], masks: list[int], test: int, train: int, need: tuple[int, int], states: int = STATES):
        """need: the units that test and train still need, as bits; the targets are what is left to fill."""
        self.sizes, self.masks, self.targets, self.need, self.states = sizes, masks, (test, train), need, states
        self.proven = True

    def run(self, limit: float) -> tuple[float, list[int]] | None:
        """The least error below the limit, and 0, 1 (test) or 2 (train) for each file; None if there is none."""
        n, (t, r) = len(self.sizes), self.targets
        once, twice = [0] * (n + 1), [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            twice[i], once[i] = twice[i + 1] | once[i + 1] & self.masks[i], once[i + 1] | self.masks[i]
        rest = np.append(np.cumsum(self.sizes[::-1])[::-1], 0)
        pairs, number = [(0, 0)], {(0, 0): 0}
        st, sr, mask = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        trail, best, at = [], limit, None

        def grown(ids: np.ndarray, bits: int, side: int) -> np.ndarray:
            own, where = np.unique(ids, return_inverse=True)
            new = []
            for k in own.tolist():
                pair = list(pairs[k])
                pair[side] |= bits & self.need[side]
                pair = tuple(pair)
                if pair not in number:
                    number[pair] = len(pairs)
                    pairs.append(pair)
                new.append(number[pair])
            return np.array(new, dtype=np.int64)[where]

        def reachable(ids: np.ndarray, i: int) -> np.ndarray:
            own, where = np.unique(ids, return_inverse=True)
            lack = [(self.need[0] & ~pairs[k][0], self.need[1] & ~pairs[k][1]) for k in own.tolist()]
            return np.array([not ((a | b) & ~once[i] or a & b & ~twice[i]) for a, b in lack], dtype=bool)[where]

        for i in range(n + 1):
            done = np.isin(mask, [k for k, p in enumerate(pairs) if p == self.need])
            error = np.where(done, np.abs(st - t) + np.abs(sr - r), np.inf)
            if len(error) and error.min() < best:
                best, at = float(error.min()), (i, int(error.argmin()))
            if i == n or best == 0 or not len(st):
                break
            s, bits, m = self.sizes[i], self.masks[i], len(st)
            a, b = np.concatenate([st, st + s, st]), np.concatenate([sr, sr, sr + s])
            k = np.concatenate([mask, grown(mask, bits, 0), grown(mask, bits, 1)])
            parent, choice = np.tile(np.arange(m, dtype=np.int32), 3), np.repeat(np.arange(3, dtype=np.int8), m)
            least = np.maximum(a - t, 0) + np.maximum(b - r, 0) + np.maximum(np.maximum(t - a, 0) + np.maximum(r - b, 0) - rest[i + 1], 0)
            keep = np.flatnonzero((least < best) & reachable(k, i + 1))
            by = keep[np.lexsort((k[keep], b[keep], a[keep]))]
            new = np.ones(len(by), bool)
            new[1:] = (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1]) | (k[by][1:] != k[by][:-1])
            by = by[new]
            if len(by) > self.states:
                # An even choice over the bins filled, which keeps ends of all kinds open.
                self.proven = False
                by = by[np.linspace(0, len(by) - 1, self.states).astype(np.int64)]
            st, sr, mask = a[by], b[by], k[by]
            trail.append((parent[by], choice[by]))
        if at is None:
            return None
        (i, k), out = at, [0] * n
        while i:
            i -= 1
            out[i], k = int(trail[i][1][k]), int(trail[i][0][k])
        return best, out


def searched(group: str, key: str, size: str, states: int):
    """For applyInPandas over the free files of a group: split and whether the search was complete. No row if nothing beats the limit."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values([size, key], ascending=[False, True], kind="stable")
        units = sorted({u for us in x["_units"] for u in us})
        bit = {u: 1 << k for k, u in enumerate(units)}
        need = tuple(sum(bit.get(u, 0) for u in x[c].iloc[0]) for c in ("_need_t", "_need_r"))
        s = Search([int(v) for v in x[size]], [sum(bit[u] for u in us) for us in x["_units"]], int(x["_t"].iloc[0]), int(x["_r"].iloc[0]), need, states)
        # A unit that no free file has can't be had: the search is over.
        lost = any(u not in bit for c in ("_need_t", "_need_r") for u in x[c].iloc[0])
        found = None if lost else s.run(float(x["_limit"].iloc[0]))
        return x[[group, key]].assign(_split=[None] * len(x) if found is None else [[None, "test", "train"][c] for c in found[1]], _better=found is not None, proven=s.proven)

    return run


def errors(split: DataFrame, targets: DataFrame, group: str, size: str) -> DataFrame:
    """group and off: how far the sizes of test and train are from their targets together."""
    part = lambda name: F.coalesce(F.sum(F.when(F.col("split") == name, F.col(size))), F.lit(0))
    sums = split.groupBy(group).agg(part("test").alias("_st"), part("train").alias("_sr"))
    return targets.join(sums, group, "left").select(group, (F.abs(F.coalesce("_st", F.lit(0)) - F.col("test")) + F.abs(F.coalesce("_sr", F.lit(0)) - F.col("train"))).alias("off"))


def cover_optimum(files: DataFrame, units: DataFrame, targets: DataFrame, group: str, key: str, size: str, seed: int = 0, most: int = FILES, states: int = STATES) -> DataFrame:
    """Disjoint test and train files of each group, each with every unit that two files have, whose sizes are closest to the targets (the sum of both differences).

    files: group, key, size (whole numbers). units: group, key, unit (once each). targets: group, test, train. Returns group, key, size, split, off (the group's error), feasible (both splits
    have every unit) and proven (no other choice is better; a null is a group for which the rule of thumb, cover_by_rule(), was not beaten by a search that was cut short).

    The files of a group of at most `most` files are all searched; of a larger one, files that cover its units and files in random order are settled until about
    a third of `most` others is left to fill for each split, and these are searched. The result is never farther off than the rule of thumb, unless that lacks a unit that this has.
    """
    rule = written(cover_by_rule(files, units, targets, group, key, size, seed))
    held = units.join(files.select(group, key), [group, key])
    wanted = held.groupBy(group, "unit").agg(F.count("*").alias("_n"))
    twice = wanted.where("_n > 1").groupBy(group).agg(F.collect_set("unit").alias("_all"))
    owned = held.groupBy(group, key).agg(F.collect_set("unit").alias("_units"))
    order = [shuffled(seed + 1, F.col(key)), F.col(key)]
    w = Window.partitionBy(group)
    free = F.row_number().over(w.orderBy(F.col("_cover").isNotNull(), *order)) <= most
    marked = files.join(rule.where("cover").select(group, key, F.col("split").alias("_cover")), [group, key], "left").withColumn("_small", F.count("*").over(w) <= most)
    marked = written(marked.withColumn("_free", F.col("_small") | free & F.col("_cover").isNull()).join(targets, group))
    # What is settled in large groups: covering files, and others while they leave the free ones a third of their sum to fill.
    sums = marked.groupBy(group).agg(F.coalesce(F.sum(F.when(F.col("_free"), F.col(size))), F.lit(0)).alias("_pool"), *(F.coalesce(F.sum(F.when(~F.col("_free") & (F.col("_cover") == s), F.col(size))), F.lit(0)).alias(f"_c{s}") for s in ("test", "train")))
    others = marked.where(~F.col("_free") & F.col("_cover").isNull()).join(sums, group)
    run = F.sum(size).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    room_t, room_r = (F.greatest(F.col(s) - F.col(f"_c{s}") - F.floor(F.col("_pool") / 3), F.lit(0)) for s in ("test", "train"))
    filled = others.withColumn("_run", run).withColumn("split", F.when(F.col("_run") <= room_t, "test").when((F.col("_run") - F.col(size) >= room_t) & (F.col("_run") <= room_t + room_r), "train"))
    core = written(marked.where(~F.col("_free") & F.col("_cover").isNotNull()).select(group, key, size, F.col("_cover").alias("split")).unionByName(filled.where("split IS NOT NULL").select(group, key, size, "split")))
    got = held.join(core.select(group, key, "split"), [group, key]).groupBy(group).agg(*(F.collect_set(F.when(F.col("split") == s, F.col("unit"))).alias(f"_g{s}") for s in ("test", "train")))
    had = core.groupBy(group).agg(*(F.coalesce(F.sum(F.when(F.col("split") == s, F.col(size))), F.lit(0)).alias(f"_h{s}") for s in ("test", "train")))
    full = marked.where("_free").join(owned, [group, key], "left").join(twice, group, "left").join(got, group, "left").join(had, group, "left")
    none = F.array().cast(twice.schema["_all"].dataType)
    full = full.withColumn("_units", F.coalesce("_units", none)).withColumn("_all", F.coalesce("_all", none))
    lacks = lambda s: F.array_except("_all", F.coalesce(f"_g{s}", none))
    limits = errors(rule, targets, group, size).join(rule.groupBy(group).agg(F.min("complete").alias("_complete")), group, "left")
    limits = limits.select(group, F.when(F.coalesce("_complete", F.lit(False)), F.col("off") + 1e-6).otherwise(F.lit(float("inf"))).alias("_limit"))
    full = full.join(limits, group, "left").select(group, key, size, "_units", lacks("test").alias("_need_t"), lacks("train").alias("_need_r"), (F.col("test") - F.coalesce("_htest", F.lit(0))).alias("_t"), (F.col("train") - F.coalesce("_htrain", F.lit(0))).alias("_r"), "_limit", "_small")
    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in (group, key))
    found = written(full.groupBy(group).applyInPandas(searched(group, key, size, states), f"{kinds}, _split string, _better boolean, proven boolean"))
    better = found.groupBy(group).agg(F.max("_better").alias("_better"), F.min("proven").alias("_proven")).join(marked.groupBy(group).agg(F.min("_small").alias("_small")), group)
    chosen = files.join(found.where("_split IS NOT NULL").select(group, key, F.col("_split").alias("split")), [group, key]).select(group, key, size, "split").unionByName(core)
    picked = chosen.join(better.where("_better").select(group), group, "left_semi").unionByName(rule.join(better.where("_better").select(group), group, "left_anti").select(group, key, size, "split"))
    picked = written(picked)
    off = errors(picked, targets, group, size)
    have = held.join(picked, [group, key]).groupBy(group).agg(*(F.count_distinct(F.when(F.col("split") == s, F.col("unit"))).alias(f"_u{s}") for s in ("test", "train")))
    every = wanted.groupBy(group).agg(F.count("*").alias("_u"))
    feasible = F.coalesce((F.col("_utest") == F.col("_u")) & (F.col("_utrain") == F.col("_u")), F.lit(False))
    said = off.join(have, group, "left").join(every, group, "left").join(better, group, "left")
    sure = F.when(F.col("off") == 0, True).when(F.col("_small") & F.col("_proven"), True).when(F.col("_better"), False)
    return picked.join(said.select(group, "off", feasible.alias("feasible"), sure.alias("proven")), group)


def cover_by_rule(files: DataFrame, units: DataFrame, targets: DataFrame, group: str, key: str, size: str, seed: int = 0) -> DataFrame:
    """The rule of thumb: for each unit the first file in random order to test and the first of those left to train; others fill test, then train, while the running sum is below the target.

    group, key, size, split, cover (the file is there for a unit) and complete (both have every unit that two files have).
    """
    order = F.struct(shuffled(seed, F.col(key)), F.col(key))
    in_test = units.groupBy(group, "unit").agg(F.min_by(key, order).alias(key)).select(group, key).distinct().withColumn("_ct", F.lit(1))
    left = units.join(in_test, [group, key], "left_anti")
    in_train = left.groupBy(group, "unit").agg(F.min_by(key, order).alias(key)).select(group, key).distinct().withColumn("_cr", F.lit(1))
    marked = files.join(in_test, [group, key], "left").join(in_train, [group, key], "left").join(targets, group)
    w = Window.partitionBy(group)
    first = lambda c: (F.col(c) == 1).desc_nulls_last()
    run = lambda c, other: F.coalesce(F.sum(F.when(other, F.col(size)).otherwise(0)).over(w.orderBy(first(c), order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = F.when(F.col("_ct") == 1, "test").when(F.col("_cr") == 1, "train").when(run("_ct", F.col("_cr").isNull()) < F.col("test"), "test")
    marked = marked.withColumn("split", split)
    marked = marked.withColumn("split", F.coalesce("split", F.when(run("_cr", F.coalesce("split", F.lit("")) != "test") < F.col("train"), "train")))
    taken = marked.where("split IS NOT NULL").select(group, key, size, "split", (F.coalesce("_ct", "_cr") == 1).alias("cover")).withColumn("cover", F.coalesce("cover", F.lit(False)))
    shared = units.groupBy(group, "unit").agg(F.count("*").alias("_n")).where("_n > 1").groupBy(group).agg(F.count("*").alias("_m"))
    have = units.join(taken, [group, key]).groupBy(group, "unit").agg(F.count_distinct("split").alias("_s")).where("_s = 2").groupBy(group).agg(F.count("*").alias("_k"))
    return taken.join(shared, group, "left").join(have, group, "left").select(group, key, size, "split", "cover", (F.coalesce("_m", F.lit(0)) <= F.coalesce("_k", F.lit(0))).alias("complete"))


def topped_off(picked: DataFrame, files: DataFrame, intervals: DataFrame, targets: DataFrame, group: str, key: str, size: str) -> DataFrame:
    """Parts of files (group, key, split, start, length) whose sizes meet the targets: files are cut where a split has too much, and files in neither are added, the last one cut, where it has too little.

    intervals: group, key, unit, on, off (whole numbers, off > on, within the file). A cut file keeps the first occurrence of each unit that the split has nowhere before it (by key).
    A split stays above its target where it can't be cut further, and below it where no file is left.
    """
    w = Window.partitionBy(group, "split")
    first = intervals.groupBy(group, key, "unit").agg(F.min(F.struct("on", "off")).alias("x")).select(group, key, "unit", "x.*")
    keeper = first.join(picked.select(group, key, "split"), [group, key]).withColumn("_k", F.row_number().over(Window.partitionBy(group, "split", "unit").orderBy(key))).where("_k = 1")
    span = keeper.groupBy(group, key).agg(F.min("on").alias("_on"), F.max("off").alias("_off"))
    both = picked.select(group, key, size, "split").join(span, [group, key], "left").join(targets, group)
    excess = F.sum(size).over(w) - F.when(F.col("split") == "test", F.col("test")).otherwise(F.col("train"))
    both = both.withColumn("_excess", excess).withColumn("_loose", F.col(size) - F.coalesce(F.col("_off") - F.col("_on"), F.lit(0)))
    enough = F.col("_loose") >= F.col("_excess")
    before = F.coalesce(F.sum("_loose").over(w.orderBy(enough.desc(), F.when(enough, F.col("_loose")).otherwise(-F.col("_loose")), key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = both.withColumn("_cut", F.greatest(F.lit(0), F.least(F.col("_loose"), F.col("_excess") - before)))
    length = F.col(size) - F.col("_cut")
    cut = written(cut.select(group, key, "split", F.least(F.coalesce("_on", F.lit(0)), F.col(size) - length).cast("bigint").alias("start"), length.cast("bigint").alias("length")))
    out = cut.where("length > 0")
    used = out.select(group, key)
    for name in ("train", "test"):
        got = cut.where(F.col("split") == name).groupBy(group).agg(F.sum("length").alias("_got"))
        lack = targets.join(got, group, "left").select(group, (F.col(name) - F.coalesce("_got", F.lit(0))).alias("_lack")).where("_lack > 0")
        left = files.select(group, key, size).where(F.col(size) > 0).join(used, [group, key], "left_anti").join(lack, group)
        # The smallest file that is enough is cut; where none is, the largest come first.
        ample = F.col(size) >= F.col("_lack")
        more = windows.within_budget(left, [group], [ample.desc(), F.when(ample, F.col(size)).otherwise(-F.col(size)), F.col(key)], size, F.col("_lack"))
        more = written(more.select(group, key, F.lit(name).alias("split"), F.lit(0).cast("bigint").alias("start"), F.col("taken").cast("bigint").alias("length")))
        out, used = out.unionByName(more), used.unionByName(more.select(group, key))
    return out
