"""Labelled intervals: clipping, merging, gaps, runs, painting and joins by overlap."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonogrid.operators import tables

#: Runs that a task of a painting holds before it hands them on.
BATCH = 16_384


def clip(units: DataFrame, chunks: DataFrame, key: str, onset: str = "onset_ms", offset: str = "offset_ms", start: str = "chunk_start", end: str = "chunk_end", width: float | None = None) -> DataFrame:
    """Units in each chunk of their key, cut to it and counted from its start. Half-open: a touch is no overlap. A null end is open.

    With a width, units meet chunks by key and bucket of time (units without length then meet none), so that the work of
    a key grows with its overlaps; open chunks, of which a key has few, meet the units by key.
    """
    limit = F.coalesce(F.col(end), F.lit(float("inf")))
    if width is None:
        hit = units.join(chunks, key).where((F.col(offset) > F.col(start)) & (F.col(onset) < limit))
    else:
        closed = range_join(units, chunks.where(F.col(end).isNotNull()), key, (onset, offset), (start, end), width)
        opened = units.where(F.col(offset) > F.col(onset)).join(chunks.where(F.col(end).isNull()), key).where(F.col(offset) > F.col(start))
        hit = closed.unionByName(opened)
    return hit.withColumns({onset: F.greatest(F.col(onset), F.col(start)) - F.col(start), offset: F.least(F.col(offset), limit) - F.col(start)})


def merged(units: DataFrame, key: str, onset: str = "onset_ms", offset: str = "offset_ms", tolerance: float = 0.0) -> DataFrame:
    """Unions of the intervals of a key; gaps up to the tolerance are closed. Returns key, onset, offset and the number of intervals."""
    order = Window.partitionBy(key).orderBy(onset, offset)
    reach = F.max(offset).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = units.withColumn("_new", F.when(reach.isNull() | (F.col(onset) > reach + tolerance), 1).otherwise(0))
    island = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.min(onset).alias(onset), F.max(offset).alias(offset), F.count("*").alias("n")).drop("_island")


def gaps(units: DataFrame, key: list[str], onset: str = "onset_ms", offset: str = "offset_ms", ordinal: str = "ordinal") -> DataFrame:
    """units with gap_ms to the unit before (by onset), null for the first and where they overlap."""
    before = F.lag(offset).over(Window.partitionBy(*key).orderBy(onset, ordinal))
    gap = F.col(onset) - before
    return units.withColumn("gap_ms", F.when(gap >= 0, gap))


def runs(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Maximal runs of equal labels: key, label, first and last place, and length."""
    w = Window.partitionBy(key).orderBy(order)
    changed = rows.withColumn("_new", F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1))
    numbered = changed.withColumn("_run", F.sum("_new").over(w))
    return numbered.groupBy(key, "_run", label).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def paint(units: DataFrame, key: str | list[str], start: str, end: str, label: str, ordinal: str, silence: int | None = 0, width: float = 1000) -> DataFrame:
    """Who is seen where intervals are painted over each other in the order of ordinal: runs (key, start, end, label).

    Intervals are dealt into buckets of time (width, in the unit of start and end), so that a key with very many is not
    one group. One sorted pass over a bucket keeps only the intervals that can still be seen; its runs are joined over the
    ends of buckets. Nothing is expanded to bins. Gaps get the silence label (None: no row), as do null labels. Of equal
    ordinals the later start lies on top, then the later end, then the larger label; a null ordinal lies under all others.
    Intervals that are empty or have a null key paint nothing.
    """
    keys = [key] if isinstance(key, str) else key
    live = units.where(F.col(end) > F.col(start)).dropna(subset=keys).select(*keys, F.col(start).alias("start"), F.col(end).alias("end"), F.col(label).alias("label"), F.col(ordinal).alias("_o"))
    kind = live.schema["start"].dataType
    first, last = F.floor(F.col("start") / width), F.ceil(F.col("end") / width) - 1
    dealt = live.withColumn("_b", F.explode(F.sequence(first, F.greatest(first, last))))
    edge = lambda b: (b * F.lit(width)).cast(kind)
    dealt = dealt.withColumns({"start": F.greatest("start", edge(F.col("_b"))), "end": F.least("end", edge(F.col("_b") + 1))}).where("end > start")
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_o", "start", "end", "label"))
    ranked = dealt.withColumn("_o", rank).sortWithinPartitions(*keys, "_b", "start")
    # The windows over keys and what a caller groups by them work on these parts, without another exchange.
    seen = tables.dealt(ranked.mapInArrow(_swept(keys), ranked.drop("_b", "_o").schema), *keys)
    w = Window.partitionBy(*keys).orderBy("start")
    if silence is not None:
        before, piece = F.lag("end").over(w), F.struct("start", "end", F.coalesce("label", F.lit(silence).cast(live.schema["label"].dataType)).alias("label"))
        gap = F.struct(F.col("_before").alias("start"), F.col("start").alias("end"), F.lit(silence).cast(live.schema["label"].dataType).alias("label"))
        seen = seen.withColumn("_before", before).select(*keys, F.inline(F.when(F.col("_before") < F.col("start"), F.array(gap, piece)).otherwise(F.array(piece))))
    new = F.when(F.lag("label").over(w).eqNullSafe(F.col("label")) & (F.lag("end").over(w) == F.col("start")), 0).otherwise(1)
    joined = seen.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return joined.groupBy(*keys, "_run", "label").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*keys, "start", "end", "label")


def _swept(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Intervals sorted by key, bucket and start to what is seen of them; _o says who lies on top.

    The heap holds those that can still be seen, highest first: one that ends no later than a higher one is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap, out, group, at, schema = [], [], None, None, None

        def advance(until) -> None:
            nonlocal at
            while heap and (until is None or at < until):
                _, stop, name = heap[0]
                if stop <= at:
                    heapq.heappop(heap)
                    continue
                to = stop if until is None or stop < until else until
                if out and out[-1][0] == group and out[-1][2] == at and out[-1][3] == name:
                    out[-1][2] = to
                else:
                    out.append([group, at, to, name])
                at = to

        def batch(rows: list) -> pa.RecordBatch:
            columns = [*zip(*(g[:-1] for g, _, _, _ in rows)), *list(zip(*rows))[1:]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for b in batches:
            schema = schema or pa.schema([b.schema.field(n) for n in [*keys, "start", "end", "label"]])
            groups = zip(*(b[n].to_pylist() for n in [*keys, "_b"]))
            for g, s, e, name, o in zip(groups, *(b[n].to_pylist() for n in ("start", "end", "label", "_o"))):
                if g != group:
                    advance(None)
                    group, heap = g, []
                advance(s)
                at = s
                if not heap or -heap[0][0] < o or heap[0][1] < e:
                    heapq.heappush(heap, (-o, e, name))
            if len(out) > BATCH:
                yield batch(out[:-1])
                del out[:-1]
        advance(None)
        if out:
            yield batch(out)

    return run


def range_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str], right_span: tuple[str, str], width: float | Column | None = None, shared: list[str] | None = None) -> DataFrame:
    """Pairs of the same key whose half-open spans overlap.

    With a width, both sides are dealt into buckets of time and joined by key and bucket, so that a key with very many
    rows is no longer one group; a pair is kept in the first bucket that both reach. A width that depends on the key is
    a column that both sides have (shared), and leaves the result.
    """
    (a, b), (c, d) = left_span, right_span
    overlap = (F.col(a) < F.col(d)) & (F.col(c) < F.col(b))
    if width is None:
        return left.join(right, key).where(overlap)

    def dealt(df: DataFrame, lo: str, hi: str, name: str) -> DataFrame:
        first = F.floor(F.col(lo) / width)
        return df.where(F.col(hi) > F.col(lo)).withColumn(name, first).withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, F.ceil(F.col(hi) / width) - 1))))

    both = dealt(left, a, b, "_first_l").drop(*(shared or [])).join(dealt(right, c, d, "_first_r").drop(*(shared or [])), [key, "_bucket"])
    return both.where(overlap & (F.col("_bucket") == F.greatest("_first_l", "_first_r"))).drop("_bucket", "_first_l", "_first_r")


def densest_window(units: DataFrame, key: str, onset: str, width: float, last: Column) -> DataFrame:
    """For each key the start, of those at an onset (kept within [0, last - width]), of the window [start, start + width] with most onsets; the first of equal ones.

    Starts and onsets stand in one line: the onsets of a window are a count over a range of it.
    """
    start = F.greatest(F.lit(0.0), F.least(F.col(onset), last - width))
    both = F.array(F.struct(F.col(onset).alias("start"), F.lit(1).alias("_one")), F.struct(start.alias("start"), F.lit(0).alias("_one")))
    points = tables.dealt(units.select(key, F.inline(both)), key)
    within = F.sum("_one").over(Window.partitionBy(key).orderBy("start").rangeBetween(0, width))
    counted = points.withColumn("n", within).where("_one = 0")
    return counted.groupBy(key).agg(F.min(F.struct(-F.col("n"), "start")).alias("_x")).select(key, "_x.start", (-F.col("_x.col1")).alias("n"))
