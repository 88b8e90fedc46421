"""Vectors as array columns. An empty array gives null where a value can't be had."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once for the row, not once for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector of zeros."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def zscore(a: Column, mean_: Column, std: Column) -> Column:
    return F.transform(a, lambda x: (x - mean_) / std)


def patch_norm(a: Column, eps: float = 1e-6) -> Column:
    """Less the mean, over the root of the sample variance and eps."""
    d = a.cast("array<double>")
    centred = let(mean(d), lambda m: F.transform(d, lambda x: x - m))
    return F.when(F.size(d) > 1, let(centred, lambda c: let(F.sqrt(dot(c, c) / (F.size(c) - 1) + eps), lambda s: F.transform(c, lambda x: x / s))))


def min_max(a: Column, eps: float = 1e-8) -> Column:
    return let(F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi")), lambda r: F.transform(a, lambda x: (x - r["lo"]) / (r["hi"] - r["lo"] + eps)))


def pad_right(a: Column, n: int, value: Column) -> Column:
    return F.concat(a, F.array_repeat(value, F.greatest(F.lit(0), n - F.size(a))))


def softmax(a: Column) -> Column:
    e = let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))
    return let(e, lambda y: let(total(y), lambda s: F.transform(y, lambda x: x / s)))


def argmax(a: Column) -> Column:
    """The first place (from 0) of the largest value."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("bigint")


def nearest_index(i: Column, n: Column, m: Column) -> Column:
    """The index (from 0) of n values that stands for place i of m, ends on ends."""
    return F.when(m > 1, F.least(F.greatest(F.bround(i * (n - 1) / (m - 1), 0).cast("bigint"), F.lit(0)), n - 1)).otherwise(0)


def interpolated(a: Column, at: Column) -> Column:
    """The value of a at a fractional place, on the line between its neighbours; ends beyond the ends."""
    p = F.least(F.greatest(at, F.lit(0.0)), F.size(a) - F.lit(1.0))
    lo = F.floor(p).cast("int")
    hi = F.least(lo + 1, F.size(a) - 1)
    return F.get(a, lo) + (F.get(a, hi) - F.get(a, lo)) * (p - lo)


def warmup_cosine(step: Column, base: float, warmup: int, total_steps: int, least: float = 0.0) -> Column:
    """A learning rate that rises in line and falls by half a cosine."""
    progress = (step - warmup) / float(max(1, total_steps - warmup))
    return F.when(step < warmup, base * step / max(1, warmup)).otherwise(least + (base - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(progress, F.lit(1.0)))))


def repeated(x: Column, times: int, length: int) -> Column:
    """Each value repeated `times` times, as patches are for their frames, and the whole cut to `length`."""
    return F.slice(F.flatten(F.transform(x, lambda v: F.array_repeat(v, times))), 1, length)


def noisy(a: Column, scale: float, seed: int, *key: Column) -> Column:
    """values with Gaussian noise of a standard deviation, the same in every run: two uniform hashes of the row's key and the place make a normal number."""
    uniform = lambda i, k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), *key, i), 11).cast("double") + 0.5) / 9007199254740992.0
    return F.transform(a, lambda x, i: x + scale * F.sqrt(-2 * F.ln(uniform(i, 0))) * F.cos(2 * F.pi() * uniform(i, 1)))
