"""Scores of predictions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """In per cent; 0 where nothing is to be found or was found."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return 100 * F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def majority(rows: DataFrame, keys: list[str], label: str, weight: Column | None = None) -> DataFrame:
    """The label of most weight of each key; the smallest of equal ones."""
    n = rows.groupBy(*keys, label).agg(F.sum(weight if weight is not None else F.lit(1)).alias("_n"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), label))
    return n.withColumn("_k", first).where("_k = 1").select(*keys, F.col(label).alias("majority"))


def confusion(rows: DataFrame, keys: list[str], truth: str, pred: str, classes: int, weight: str | None = None) -> DataFrame:
    """tp, fp and fn of every class 0 to classes - 1 for each key, also of classes that don't occur."""
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    pairs = rows.groupBy(*keys, truth, pred).agg(F.sum(w).alias("_w"))
    side = lambda c, name: F.struct(F.col(c).cast("bigint").alias("class"), F.lit(name).alias("side"))
    # One pair of each key also brings a row without weight for every class.
    none = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(classes - 1).cast("bigint")), lambda c: F.struct(c.alias("class"), F.lit("none").alias("side")))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(truth, pred)) == 1
    sides = F.concat(F.array(side(truth, "t"), side(pred, "p")), F.when(first, none).otherwise(F.slice(none, 1, 0)))
    per = pairs.withColumn("_x", sides).withColumn("_x", F.explode("_x")).select("*", "_x.class", "_x.side").where(F.col("class").between(0, classes - 1)).groupBy(*keys, "class")
    hit, side = F.col(truth) == F.col(pred), F.col("side")
    return per.agg(*(F.coalesce(F.sum(F.when(c, F.col("_w")).otherwise(0)), F.lit(0)).cast("bigint").alias(n) for n, c in (("tp", hit & (side == "t")), ("fp", ~hit & (side == "p")), ("fn", ~hit & (side == "t")))))


def macro(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Mean F1 over all classes, and the error rate, in per cent."""
    out = counts.groupBy(*keys).agg(F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"), F.sum("tp").alias("_hit"), F.sum(F.col("tp") + F.col("fn")).alias("_all"))
    return out.select(*keys, "macro_f1", (100 * (1 - ratio(F.col("_hit"), F.col("_all")))).alias("error_rate"))


def at_resolution(runs: DataFrame, keys: list[str], r: Column | int, label: str = "label", start: str = "start", end: str = "end") -> DataFrame:
    """keys, label, majority and w of runs read in steps of r: w units of a run lie in steps whose label of most units is `majority`.

    Steps that lie within one run need no vote, so a run gives a row for all of these and its ends a row each,
    however long it is.
    """
    r = F.lit(r) if isinstance(r, int) else r
    s, e = F.col(start), F.col(end)
    first, last = F.ceil(s / r), F.floor(e / r)
    low, high = F.floor(s / r), F.floor(e / r)
    # The steps within a run stand together at the first of them, which no other run reaches.
    inner = F.when(last > first, F.struct(first.alias("step"), ((last - first) * r).alias("w")))
    left = F.when(s % r != 0, F.struct(low.alias("step"), (F.least(e, (low + 1) * r) - s).alias("w")))
    right = F.when((e % r != 0) & ((high > low) | (s % r == 0)), F.struct(high.alias("step"), (e - F.greatest(s, high * r)).alias("w")))
    parts = runs.select(*keys, label, F.explode(F.array_compact(F.array(inner, left, right))).alias("x")).select(*keys, label, "x.step", "x.w")
    summed = parts.groupBy(*keys, "step", label).agg(F.sum("w").alias("w"))
    vote = F.min_by(label, F.struct(-F.col("w"), F.col(label))).over(Window.partitionBy(*keys, "step"))
    return summed.select(*keys, label, vote.alias("majority"), "w")
