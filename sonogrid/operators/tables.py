"""Tables of run metrics: filters, cells, rankings and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many parts as spark.sql.shuffle.partitions says. Spark joins small parts of other exchanges, by their size as they are; so this is for rows that become many more in the stage that reads them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def consistent(runs: DataFrame) -> Column:
    """All three class counts are there and equal."""
    return (F.col("num_classes") == F.col("num_classes_train")) & (F.col("num_classes") == F.col("num_classes_val"))


def cell(value: str, sample: bool = False) -> Column:
    """Mean and deviation of a column as text, '-' for none; the deviation of one value is 0."""
    std = F.coalesce(F.stddev_samp(value), F.lit(0.0)) if sample else F.stddev_pop(value)
    return F.when(F.count(value) > 0, F.format_string("%.2f +- %.2f", F.avg(value), std)).otherwise("-")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def regrets(means: DataFrame, config: list[str], species: str, score: str) -> DataFrame:
    """For each configuration that every species has: g, its largest loss against a species' best, and its mean."""
    n = means.agg(F.count_distinct(species).alias("_all"))
    best = means.groupBy(species).agg(F.max(score).alias("_best"))
    lost = means.join(F.broadcast(best), species)
    out = lost.groupBy(*config).agg(F.max(F.col("_best") - F.col(score)).alias("g"), F.avg(score).alias("mean"), F.count_distinct(species).alias("_n"))
    return out.crossJoin(F.broadcast(n)).where("_n = _all").drop("_n", "_all")


def insert_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old, and the rows of new whose key it lacks; columns that one side lacks are null."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def concatenated(*tables: DataFrame) -> DataFrame:
    """All rows of tables with the same columns in the same order."""
    out = tables[0]
    for t in tables[1:]:
        if t.columns != out.columns:
            raise ValueError(f"columns differ: {out.columns} and {t.columns}")
        out = out.union(t)
    return out


def with_reason(df: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """df with skip_reason: the first reason that holds, null for rows to keep. A condition that is null doesn't hold."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(reasons.items()):
        out = F.when(condition, name).otherwise(out)
    return df.withColumn("skip_reason", out)


def counted(df: DataFrame, observation: Observation) -> DataFrame:
    """The rows of with_reason() to keep; once they have been written, the observation tells how many were processed and skipped."""
    seen = df.observe(observation, F.count_if(F.col("skip_reason").isNull()).alias("processed"), F.count("skip_reason").alias("skipped"))
    return seen.where("skip_reason IS NULL").drop("skip_reason")


def capped(df: DataFrame, group: str, order: list[str], rows: int | None = None, groups: int | None = None) -> DataFrame:
    """The first rows of each group by `order`, of the first groups by name; None is no limit."""
    if groups is not None:
        first = df.select(group).distinct().orderBy(group).limit(groups)
        df = df.join(F.broadcast(first), group, "left_semi")
    if rows is None:
        return df
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") <= rows).drop("_k")
