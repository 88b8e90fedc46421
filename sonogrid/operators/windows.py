"""Windows over sequences: tiling, chunking, pooling, smoothing and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def tiles(files: DataFrame, n: str, width: int) -> DataFrame:
    """files with start and length of each window; the last keeps its true length, an empty file has one empty window."""
    starts = F.when(F.col(n) > 0, F.sequence(long(0), F.col(n).cast("bigint") - 1, long(width))).otherwise(F.array(long(0)))
    out = files.withColumn("start", F.explode(starts))
    return out.withColumn("length", F.greatest(long(0), F.least(long(width), F.col(n) - F.col("start"))))


def chunks(files: DataFrame, n: str, width: int, stride: int, pad: bool) -> DataFrame:
    """files with start and end of each chunk. Without padding only full chunks; with it every start within the file, the end cut to the file."""
    last = F.col(n).cast("bigint") - (1 if pad else width)
    out = files.withColumn("start", F.explode(F.when(last >= 0, F.sequence(long(0), last, long(stride))).otherwise(F.array().cast("array<bigint>"))))
    return out.withColumn("end", F.least(F.col("start") + width, F.col(n).cast("bigint")))


def window_starts(n: Column, width: int, hop: int) -> Column:
    """Starts of the full windows of n rows; a shorter sequence has one window with all of it, none has none."""
    full = F.sequence(long(0), F.greatest(n - width, long(0)), long(hop))
    return F.when(n >= width, full).when(n > 0, F.array(long(0))).otherwise(F.array().cast("array<bigint>"))


def pooled(rows: DataFrame, key: str, order: str, vector: str, width: int, hop: int, how: str = "mean") -> DataFrame:
    """key, window, dim and value: vectors pooled by dimension over sliding windows.

    A row goes to the windows that hold it, which are a few numbers of its place; so rows are neither joined nor gathered.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(key))
    numbered = rows.select(key, vector, place.cast("bigint").alias("_i"), n.alias("_n"))
    last = F.when(F.col("_n") >= width, F.floor((F.col("_n") - width) / hop)).otherwise(0)
    lo = F.greatest(long(0), F.ceil((F.col("_i") - width + 1) / hop))
    hi = F.least(F.floor(F.col("_i") / hop), last)
    spread = numbered.where(lo <= hi).withColumn("window", F.explode(F.sequence(lo, hi))).select(key, "window", F.posexplode(vector).alias("dim", "_x"))
    return spread.groupBy(key, "window", "dim").agg({"mean": F.avg, "max": F.max, "sum": F.sum}[how]("_x").alias("value"))


def vote(rows: DataFrame, key: str, order: str, flag: str, width: int) -> Column:
    """1 where more than half of `width` (whole, also at the ends) places around are 1."""
    half = width // 2
    return (F.sum(flag).over(Window.partitionBy(key).orderBy(order).rowsBetween(-half, half - 1)) > half).cast("int")


def within_budget(rows: DataFrame, key: list[str], order: list[Column], size: str, budget: float | Column, truncate: bool = True) -> DataFrame:
    """The first rows of each key up to the budget, with taken; the row that passes it is cut, or left out, and is the last."""
    w = Window.partitionBy(*key).orderBy(*order) if key else Window.orderBy(*order)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("_before", before).where(F.col("_before") < budget)
    out = out.withColumn("taken", F.least(F.col(size), budget - F.col("_before")))
    return (out if truncate else out.where(F.col("taken") == F.col(size))).drop("_before")
