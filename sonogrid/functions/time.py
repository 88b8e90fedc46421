"""Milliseconds, time bins and seconds as column expressions. All are null where an input is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_long(x: Column) -> Column:
    return x.cast("bigint")


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("bigint")


def ms_to_bin(ms: Column, sr: int, hop: int, rounding: str = "floor") -> Column:
    """The time bin of a time. 'floor' cuts the fraction off (toward zero), 'half_even' rounds, 'scaled' cuts after multiplying in another order."""
    if rounding == "floor":
        return to_long((ms / 1000) * sr / hop)
    if rounding == "half_even":
        return half_even(ms / 1000 * sr / hop)
    if rounding == "scaled":
        return to_long((ms * sr) / (1000 * hop))
    raise ValueError(f"rounding: {rounding}")


def seconds_to_bins(s: Column, sr: int, hop: int) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), half_even(s * sr / hop))


def bins_to_ms(t: Column, sr: int, hop: int, whole: bool = True) -> Column:
    ms = t * F.lit(float(hop)) / sr * 1000
    return half_even(ms) if whole else ms


def bin_span_ms(t: Column, n: Column, ms_per_bin: Column) -> tuple[Column, Column]:
    """Whole milliseconds [start, end) of bin t of n: at least one; the last bin reaches to the end of the file."""
    start = F.floor(t * ms_per_bin)
    end = F.when(t == n - 1, F.ceil(n * ms_per_bin)).otherwise(F.floor((t + 1) * ms_per_bin))
    return start, F.greatest(end, start + 1)


def label_span_ms(onset: Column, offset: Column, length: Column) -> tuple[Column, Column]:
    """Whole milliseconds [start, end) of a label within a file of the given length."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(0).cast("bigint")), length)
    return clamp(F.floor(onset)), clamp(F.ceil(offset))
