"""Reproducible samples, budgets and splits. Random order is the order of a hash of a seed and the row's key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonogrid.functions.names import shuffled
from sonogrid.operators import windows
from sonogrid.scratch import written


def per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n random rows of each group; groups with fewer are left out."""
    w = Window.partitionBy(group).orderBy(shuffled(seed, F.col(group), F.col(key)), key)
    return df.withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(group))).where((F.col("_k") <= n) & (F.col("_n") >= n)).drop("_k", "_n")


def one_per_unit(df: DataFrame, units: list[str], key: str, seed: int = 0) -> DataFrame:
    """A random row of each unit."""
    order = F.struct(shuffled(seed, *map(F.col, units), F.col(key)), F.col(key))
    rest = [c for c in df.columns if c not in units]
    return df.groupBy(*units).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*units, "_r.*")


def until(df: DataFrame, group: list[str], order: list[Column], size: str, target: Column) -> Column:
    """Whether a row comes before the running sum of size reaches the target."""
    w = Window.partitionBy(*group) if group else Window.partitionBy()
    return F.coalesce(F.sum(size).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) < target


def count_split(df: DataFrame, group: str, key: str, share: float, seed: int = 0, least: int = 0) -> DataFrame:
    """df with split: in each group the first int(n * share) rows in random order are 'train' (least at least, but never all of two or more), the others 'test'."""
    w = Window.partitionBy(group)
    n = F.count("*").over(w)
    wanted = F.greatest(F.floor(n * share), F.lit(least))
    wanted = F.when(n > 1, F.least(wanted, n - 1)).otherwise(wanted)
    k = F.row_number().over(w.orderBy(shuffled(seed, F.col(key)), key))
    return df.withColumn("split", F.when(k <= wanted, "train").otherwise("test"))


def fold_budget(df: DataFrame, group: str, order: list[str], size: str, budget: float, once: list[str] | None = None) -> DataFrame:
    """Rows taken in order while they fit: one that doesn't is passed over, later smaller ones can still be taken. Of rows that are equal in `once`, the first in order counts.

    In rounds, each for what is left of the budget: rows of more than half of it can be taken once, and until the others sum up to
    over half of it, all these are taken. So a round settles all rows up to the first of both events and leaves less than half of what was left: rounds grow with the logarithm
    of the budget over the smallest size. The rows are sorted once, into parts that share a group's rows; a round sums the others by part and
    looks closer only at the parts up to the one in which they pass the half. What is left and the last settled row of each group are a small table, which the next round replaces.
    """
    if once:
        rest = [c for c in df.columns if c not in once] or once
        df = df.groupBy(*once).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*once, "_r.*").select(*df.columns)
    slack, parts = 1e-9, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = df.where(F.col(size) <= budget + slack).repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    base = written(line.withColumn("_k", F.monotonically_increasing_id()))
    until = Window.partitionBy("_g").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    parts_before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    small = F.col(size) * 2 <= F.col("_left")
    counted = F.when(small, F.col(size)).otherwise(0)
    state = written(base.select(F.col(group).alias("_g")).distinct().select("_g", F.lit(budget).cast("double").alias("_left"), F.lit(-1).cast("bigint").alias("_at")))
    rounds = []
    while not state.isEmpty():
        rest = base.join(state, F.col(group).eqNullSafe(F.col("_g"))).where((F.col("_k") > F.col("_at")) & (F.col(size) <= F.col("_left") + slack))
        rest = rest.withColumn("_part", F.shiftright("_k", 33))
        sums = rest.groupBy("_g", "_left", "_part").agg(F.sum(counted).alias("_sum")).withColumn("_sums", F.coalesce(F.sum("_sum").over(parts_before), F.lit(0)))
        head = sums.where(F.col("_sums") * 2 <= F.col("_left")).select(F.col("_g").alias("_h"), F.col("_part").alias("_p"))
        near = rest.join(head, (F.col("_part") == F.col("_p")) & F.col("_g").eqNullSafe(F.col("_h")), "left_semi")
        near = near.withColumn("_before", F.coalesce(F.sum(counted).over(until), F.lit(0)))
        near = near.withColumn("_fits", ~small & (F.col(size) + F.col("_before") <= F.col("_left") + slack))
        near = near.withColumn("_event", F.col("_fits") | ((F.col("_before") + counted) * 2 > F.col("_left")))
        # Rows up to the event, that row too: nothing before it has left less than half.
        near = near.withColumn("_settled", ~F.coalesce(F.max("_event").over(until), F.lit(False)))
        marked = written(near.where("_settled").withColumn("_taken", small | F.col("_fits")))
        rounds.append(marked.where("_taken").select(*df.columns))
        used = F.coalesce(F.sum(F.when(F.col("_taken"), F.col(size))), F.lit(0))
        # Sums that are off by a trifle leave nothing, not less, so that rows of size 0 are still small.
        state = written(marked.groupBy("_g").agg(F.greatest(F.lit(0.0), F.max("_left") - used).alias("_left"), F.max("_k").alias("_at")))
    return reduce(DataFrame.unionByName, rounds, df.limit(0)) if rounds else df.limit(0)


def unit_windows(planned: DataFrame, group: str, order: list[Column], budget: Column | int) -> DataFrame:
    """planned with width: windows shrunk in order, never below their unit, until those of a group are within the budget or all are as small as can be.

    planned: group, unit_bins, window_bins. What is too much is shared out by a running sum of what each window can give.
    """
    w = Window.partitionBy(group)
    loose = F.col("window_bins") - F.col("unit_bins")
    excess = F.sum("window_bins").over(w) - budget
    before = F.coalesce(F.sum(loose).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return planned.withColumn("width", F.col("window_bins") - F.greatest(F.lit(0), F.least(loose, excess - before)))


def covering_sample(planned: DataFrame, files: DataFrame, group: str, key: str, total: str, budget: int, seed: int = 0, truncate: bool = True, whole: bool = False) -> DataFrame:
    """Parts of files (group, key, unit, start, end) within a budget of bins for each group, with every unit: a window for each, then other files in random order, the last one cut if `truncate`.

    planned: group, unit, key, on, off (bins of the unit in its file), total (bins of the file), window_bins. files: group, key, total. Windows are shrunk as in unit_windows() and centred on their unit;
    unit is null for files that fill up. With `whole`, the files of the units are taken whole, each once, in the units' order; the one that passes the budget is cut around its unit.
    Units alone can pass the budget: all keep their span.
    """
    on = F.least(F.greatest("on", F.lit(0)), F.col(total) - 1)
    units = planned.withColumn("on", on).withColumn("off", F.least(F.greatest(F.col("off"), F.col("on") + 1), F.col(total))).withColumn("unit_bins", F.col("off") - F.col("on"))
    units = units.withColumn("window_bins", F.least(F.greatest("window_bins", "unit_bins"), F.col(total)))
    if whole:
        first = units.withColumn("_k", F.row_number().over(Window.partitionBy(group, key).orderBy("unit"))).where("_k = 1")
        taken = windows.within_budget(first, [group], [F.col("unit")], total, budget, truncate)
        start, end = around(F.col("on"), F.col("off"), F.col("taken"), F.col(total))
    else:
        taken = unit_windows(units, group, [shuffled(seed, F.col("unit"), F.col(key)), F.col("unit")], F.lit(budget))
        start, end = around(F.col("on"), F.col("off"), F.col("width"), F.col(total))
    parts = written(taken.select(group, key, "unit", start.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
    left = files.select(group).distinct().join(parts.groupBy(group).agg(F.sum(F.col("end") - F.col("start")).alias("_used")), group, "left").select(group, (F.lit(budget) - F.coalesce("_used", F.lit(0))).alias("_room"))
    others = files.where(F.col(total) > 0).join(units.select(group, key).distinct(), [group, key], "left_anti").join(left.where("_room > 0"), group)
    more = windows.within_budget(others, [group], [shuffled(seed + 1, F.col(key)), F.col(key)], total, F.col("_room"), truncate)
    return parts.unionByName(more.select(group, key, F.lit(None).cast(parts.schema["unit"].dataType).alias("unit"), F.lit(0).cast("bigint").alias("start"), F.col("taken").cast("bigint").alias("end")))


def cover_split(files: DataFrame, units: DataFrame, group: str, key: str, size: str, test: float, train: float, seed: int = 0) -> DataFrame:
    """Disjoint test and train files of each group, each with every unit if that can be had, filled up to their totals.

    files: group, key, size. units: group, key, unit (once each). For each unit the first file in random order goes to
    test and the first of those left to train; other files fill test, then train, while the running sum is below the
    total. Returns group, key, size and split, and feasible: whether both have every unit of the group.
    """
    order = F.struct(shuffled(seed, F.col(key)), F.col(key))
    in_test = units.groupBy(group, "unit").agg(F.min_by(key, order).alias(key)).select(group, key).distinct().withColumn("_t", F.lit(1))
    left = units.join(in_test, [group, key], "left_anti")
    in_train = left.groupBy(group, "unit").agg(F.min_by(key, order).alias(key)).select(group, key).distinct().withColumn("_r", F.lit(1))
    possible = units.groupBy(group).agg(F.count_distinct("unit").alias("_n")).join(left.groupBy(group).agg(F.count_distinct("unit").alias("_m")), group, "left")
    marked = files.join(in_test, [group, key], "left").join(in_train, [group, key], "left")
    first = lambda c: (F.col(c) == 1).desc_nulls_last()
    w = Window.partitionBy(group)
    # Covering files come first in each running sum, so that what they use up counts.
    before = F.coalesce(F.sum(F.when(F.col("_r").isNull(), F.col(size)).otherwise(0)).over(w.orderBy(first("_t"), order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = F.when(F.col("_t") == 1, "test").when(F.col("_r") == 1, "train").when(before < test, "test")
    marked = marked.withColumn("split", split)
    before = F.coalesce(F.sum(F.when(F.coalesce("split", F.lit("")) != "test", F.col(size)).otherwise(0)).over(w.orderBy(first("_r"), order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = marked.withColumn("split", F.coalesce("split", F.when(before < train, "train")))
    return marked.join(possible, group, "left").where("split IS NOT NULL").select(group, key, size, "split", F.coalesce(F.col("_m") == F.col("_n"), F.lit(False)).alias("feasible"))


def placed(clips: DataFrame, group: str, key: str, length: str, room: Column, seed: int = 0) -> DataFrame:
    """clips with onset: laid in random order on a background of `room`, never over each other. Groups that don't fit are left out.

    What is free is dealt out by sorted random numbers: a clip starts after all clips before it and its share of the free time.
    """
    u = F.conv(F.substring(shuffled(seed, F.col(group), F.col(key)), 1, 8), 16, 10).cast("double") / 4294967296.0
    w = Window.partitionBy(group)
    out = clips.withColumn("_u", u).withColumn("_free", room - F.sum(length).over(w)).where("_free >= 0")
    before = F.coalesce(F.sum(length).over(w.orderBy("_u", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn("onset", before + F.floor(F.col("_u") * F.col("_free"))).drop("_u", "_free")


def centred(onset: Column, offset: Column, width: int, total: Column) -> tuple[Column, Column]:
    """A window of `width` bins around a unit, kept within the file and, if it can be, holding the unit's start."""
    mid = F.bround((onset + offset) / 2.0, 0).cast("bigint")
    start = F.greatest(F.lit(0).cast("bigint"), F.least(mid - width // 2, total - width))
    start = F.when(onset < start, onset).otherwise(start)
    return start, F.least(start + width, total)


def around(onset: Column, offset: Column, width: Column, total: Column) -> tuple[Column, Column]:
    """A window of `width` bins (the unit's at least) around a unit, kept within the file and holding the whole unit."""
    mid = F.floor((onset + offset) / 2)
    start = F.greatest(F.lit(0), F.least(mid - F.floor(width / 2), total - width))
    start = F.when(onset < start, onset).when(offset > start + width, F.greatest(F.lit(0), offset - width)).otherwise(start)
    return start, F.least(start + width, total)
