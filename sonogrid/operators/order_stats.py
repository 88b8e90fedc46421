"""Exact percentiles of groups of any size, by counting ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonogrid.scratch import written

#: Ranges that a group's values are counted in, rows of a range that are ranked by sorting at most, groups that are broadcast at most, and tasks over which a group's rows are dealt where they are more.
BINS, ROWS, GROUPS, SALTS = 1024, 10_000, 1 << 16, 16


def meeting(rows: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """rows joined with targets by key: targets are broadcast if they are counted as few, else the rows of a key are dealt over some tasks."""
    if targets.limit(GROUPS + 1).count() <= GROUPS:
        return rows.join(F.broadcast(targets), key)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("_x", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return dealt.join(targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"]).drop("_salt")


def percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float], bins: int = BINS, most: int = ROWS) -> DataFrame:
    """group and a column for each share (name: share between 0 and 1): the value at that share of the ranks, between two values by a line. Null and NaN don't count; a group without values has nulls.

    A group's values are counted in ranges between its least and largest; the range that holds a rank is counted again in finer ranges until it has one value, or so few rows that they are sorted.
    Ranges end at values that are there, so each pass tells the values of a range further apart: memory and shuffles go by ranges, never by different values.
    """
    key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"})
    x = F.col(value).cast("double")
    rows = df.select(key.alias("_g"), F.when(~F.isnan(x), x).alias("_x"))
    whole = written(df.select(*group, key.alias("_g"), F.when(~F.isnan(x), x).alias("_x")).groupBy("_g", *group).agg(F.count("_x").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
    place = {name: F.col("_n").cast("double") - 1 for name in shares}
    place = {name: F.greatest(F.lit(0.0), p * shares[name]) for name, p in place.items()}
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(p), F.ceil(p)) for p in place.values()))))
    # _rank in the group, _left in the range, whose least and largest value are _lo and _hi and which has _m rows.
    targets = whole.where("_n > 0").select("_g", F.explode(ranks).alias("_rank"), "_lo", "_hi", F.col("_n").alias("_m")).withColumn("_left", F.col("_rank"))
    targets, found = written(targets), []
    # Ranges are even where values are of a kind, and even by exponents where they are of many sizes or both signs.
    alike = (F.signum("_lo") == F.signum("_hi")) & (F.col("_lo") != 0) & (F.abs("_hi") <= 64 * F.abs("_lo")) & (F.abs("_lo") <= 64 * F.abs("_hi"))
    scale = lambda c: F.signum(c) * F.when(F.col(c) != 0, F.log2(F.abs(c)) + 1080).otherwise(0)
    while True:
        settled = targets.where("_lo = _hi OR _m <= " + str(most))
        found.append(settled)
        still = targets.where(f"_lo < _hi AND _m > {most}")
        if still.isEmpty():
            break
        share = F.when(alike, (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise((scale("_x") - scale("_lo")) / (scale("_hi") - scale("_lo")))
        inside = meeting(rows.where("_x IS NOT NULL"), still, "_g").where("_x >= _lo AND _x <= _hi").withColumn("_bin", F.least(F.lit(bins - 1), F.floor(share * bins)))
        counted = inside.groupBy("_g", "_rank", "_bin").agg(F.count("*").alias("_m"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.first("_left").alias("_left"))
        before = F.coalesce(F.sum("_m").over(Window.partitionBy("_g", "_rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = counted.withColumn("_before", before).where("_left >= _before AND _left < _before + _m")
        targets = written(held.select("_g", "_rank", "_lo", "_hi", "_m", (F.col("_left") - F.col("_before")).alias("_left")))
    all_found = found[0]
    for f in found[1:]:
        all_found = all_found.unionByName(f)
    one = all_found.where("_lo = _hi").select("_g", "_rank", F.col("_lo").alias("_v"))
    small = meeting(rows.where("_x IS NOT NULL"), all_found.where("_lo < _hi"), "_g").where("_x >= _lo AND _x <= _hi")
    ranked = small.withColumn("_k", F.row_number().over(Window.partitionBy("_g", "_rank").orderBy("_x")) - 1).where("_k = _left").select("_g", "_rank", F.col("_x").alias("_v"))
    values = one.unionByName(ranked).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_values"))
    at = lambda p: F.try_element_at("_values", p)
    out = {name: at(F.floor(p)) + (at(F.ceil(p)) - at(F.floor(p))) * (p - F.floor(p)) for name, p in place.items()}
    return whole.join(values, "_g", "left").select(*group, *(c.alias(name) for name, c in out.items()))
