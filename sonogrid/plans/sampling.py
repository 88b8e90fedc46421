"""Queries that sample and split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonogrid.functions.names import shuffled
from sonogrid.operators import sampling, splits, windows
from sonogrid.sources import testviews as v


def _md5(seed: int, *key: str) -> str:
    return f"md5('{seed}|' || " + " || '|' || ".join(key) + ")"


def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Files of each bird in random order up to 20,000 bins, the last one cut."""
    s = v.specs(spark, d)
    return windows.within_budget(s, ["bird_id"], [shuffled(3, F.col("stem")), F.col("stem")], "n_timebins", 20_000).select("bird_id", "stem", "taken")


BUDGET_PREFIX = f"""WITH {v.SPECS}, b AS (SELECT *, coalesce(sum(n_timebins) OVER (PARTITION BY bird_id ORDER BY {_md5(3, "stem")}, stem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM v_specs)
SELECT bird_id, stem, least(n_timebins, 20000 - before) AS taken FROM b WHERE before < 20000"""


def whole_species_val(spark: SparkSession, d: str) -> DataFrame:
    """Whole species in random order until a tenth of the snippets is reached; one is forced in. Species are few."""
    g = v.manifest(spark, d).groupBy("species").agg(F.count("*").alias("n"))
    g = g.withColumn("target", F.sum("n").over(Window.partitionBy()) * 0.1)
    chosen = sampling.until(g, [], [shuffled(5, F.col("species"))], "n", F.col("target"))
    return g.select("species", "n", (chosen | (F.col("species") == "BUILDING")).alias("val"))


WHOLE_SPECIES_VAL = f"""WITH {v.MANIFEST}, g AS (SELECT species, count(*) AS n FROM v_manifest GROUP BY 1) SELECT species, n,
(coalesce(sum(n) OVER (ORDER BY {_md5(5, "species")} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < (sum(n) OVER ()) * 0.1) OR species = 'BUILDING' AS val FROM g"""


def recording_split(spark: SparkSession, d: str) -> DataFrame:
    """Four fifths of each bird's files to train, one at least."""
    return sampling.count_split(v.specs(spark, d), "bird_id", "stem", 0.8, 7, 1).select("bird_id", "stem", "split")


RECORDING_SPLIT = f"""WITH {v.SPECS}, n AS (SELECT bird_id, stem, row_number() OVER (PARTITION BY bird_id ORDER BY {_md5(7, "stem")}, stem) AS k, count(*) OVER (PARTITION BY bird_id) AS n FROM v_specs)
SELECT bird_id, stem, CASE WHEN k <= CASE WHEN n > 1 THEN least(greatest(floor(n * 0.8::DOUBLE), 1), n - 1) ELSE 1 END THEN 'train' ELSE 'test' END AS split FROM n"""


def duration_split(spark: SparkSession, d: str) -> DataFrame:
    """Files go to train while its bins are below half of the species'."""
    s = v.specs(spark, d)
    half = F.sum("n_timebins").over(Window.partitionBy("species")) * 0.5
    return s.withColumn("target", half).select("species", "stem", sampling.until(s, ["species"], [shuffled(9, F.col("stem")), F.col("stem")], "n_timebins", F.col("target")).alias("train"))


DURATION_SPLIT = f"""WITH {v.SPECS} SELECT species, stem, coalesce(sum(n_timebins) OVER (PARTITION BY species ORDER BY {_md5(9, "stem")}, stem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < (sum(n_timebins) OVER (PARTITION BY species)) * 0.5::DOUBLE AS train FROM v_specs"""


def per_bird_sample(spark: SparkSession, d: str) -> DataFrame:
    """20 random units of each bird and recording that has as many."""
    return sampling.per_group(v.units(spark, d), "stem", "ordinal", 20, 11).select("stem", "ordinal")


PER_BIRD_SAMPLE = f"WITH {v.UNITS} SELECT stem, ordinal FROM v_units QUALIFY row_number() OVER (PARTITION BY stem ORDER BY {_md5(11, 'stem', 'ordinal')}, ordinal) <= 20 AND count(*) OVER (PARTITION BY stem) >= 20"


def one_per_unit(spark: SparkSession, d: str) -> DataFrame:
    """A random unit of each id of each bird."""
    return sampling.one_per_unit(v.units(spark, d).select("bird_id", "id", "stem", "ordinal"), ["bird_id", "id"], "ordinal", 13)


ONE_PER_UNIT = f"WITH {v.UNITS} SELECT bird_id, id, stem, ordinal FROM v_units QUALIFY row_number() OVER (PARTITION BY bird_id, id ORDER BY {_md5(13, 'bird_id', 'id', 'ordinal')}, ordinal) = 1"


def best_subset_split(spark: SparkSession, d: str) -> DataFrame:
    """The birds whose units come closest to 30 per cent."""
    t = v.units(spark, d).groupBy("bird_id").agg(F.count("*").alias("n"))
    return splits.best_subset(t, "bird_id", "n", 0.3)


BEST_SUBSET_SPLIT = f"""WITH {v.UNITS}, t AS (SELECT bird_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, bird_id) - 1 AS i FROM v_units GROUP BY bird_id), m AS (SELECT range AS m FROM range(0, (SELECT 1 << count(*) FROM t))),
s AS (SELECT m, sum(n * ((m >> i) & 1)) AS s, list(i ORDER BY i) FILTER ((m >> i) & 1 = 1) AS o FROM m, t GROUP BY m),
b AS (SELECT m FROM s ORDER BY abs(s - 0.3::DOUBLE * (SELECT sum(n) FROM t)), bit_count(m), o LIMIT 1) SELECT bird_id, n FROM t, b WHERE (m >> i) & 1 = 1"""


def event_budget_fold(spark: SparkSession, d: str) -> DataFrame:
    """Units of each bird in random order that fit a budget of 5,000 ms, those that don't passed over."""
    u = v.units(spark, d).select("bird_id", "ordinal", (F.col("offset_ms") - F.col("onset_ms")).alias("ms"), shuffled(17, F.col("ordinal")).alias("o"))
    return sampling.fold_budget(u, "bird_id", ["o", "ordinal"], "ms", 5000.0).select("bird_id", "ordinal", F.round("ms", 6).alias("ms"))


def _files_units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    u = v.units(spark, d)
    return u.groupBy("bird_id", "stem").agg(F.count("*").alias("n")), u.select("bird_id", "stem", F.col("id").alias("unit")).distinct()


def unit_cover_split(spark: SparkSession, d: str) -> DataFrame:
    """Recordings of each bird for test and train, both with every unit if they can."""
    files, units = _files_units(spark, d)
    return sampling.cover_split(files, units, "bird_id", "stem", "n", 300, 600, 19)


UNIT_COVER_SPLIT = f"""WITH {v.UNITS}, f AS (SELECT bird_id, stem, count(*) AS n, {_md5(19, "stem")} AS o FROM v_units GROUP BY bird_id, stem), u AS (SELECT DISTINCT bird_id, stem, id, {_md5(19, "stem")} AS o FROM v_units),
t AS (SELECT DISTINCT bird_id, arg_min(stem, row(o, stem)) AS stem FROM u GROUP BY bird_id, id), l AS (SELECT * FROM u WHERE (bird_id, stem) NOT IN (SELECT (bird_id, stem) FROM t)), r AS (SELECT DISTINCT bird_id, arg_min(stem, row(o, stem)) AS stem FROM l GROUP BY bird_id, id),
p AS (SELECT bird_id, count(DISTINCT id) AS c FROM u GROUP BY 1), q AS (SELECT bird_id, count(DISTINCT id) AS c FROM l GROUP BY 1),
m AS (SELECT f.*, (f.bird_id, f.stem) IN (SELECT (bird_id, stem) FROM t) AS t, (f.bird_id, f.stem) IN (SELECT (bird_id, stem) FROM r) AS r FROM f),
a AS (SELECT *, coalesce(sum(CASE WHEN r THEN 0 ELSE n END) OVER (PARTITION BY bird_id ORDER BY (NOT t), o, stem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bt FROM m),
s AS (SELECT *, CASE WHEN t THEN 'test' WHEN r THEN 'train' WHEN bt < 300 THEN 'test' END AS s1 FROM a),
z AS (SELECT *, coalesce(sum(CASE WHEN s1 = 'test' THEN 0 ELSE n END) OVER (PARTITION BY bird_id ORDER BY (NOT r), o, stem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS br FROM s)
SELECT z.bird_id, stem, n, coalesce(s1, 'train') AS split, coalesce(p.c = q.c, false) AS feasible FROM z JOIN p USING (bird_id) LEFT JOIN q USING (bird_id) WHERE s1 IS NOT NULL OR br < 600"""


def placed_clips(spark: SparkSession, d: str) -> DataFrame:
    """The units of each recording laid on backgrounds without overlap: in order, a new one after each 4,000 ms of units, of 5,000 ms or what its units take."""
    u = v.units(spark, d).select("stem", "ordinal", F.ceil(F.col("offset_ms") - F.col("onset_ms")).alias("ms"))
    before = F.coalesce(F.sum("ms").over(Window.partitionBy("stem").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    u = u.withColumn("background", F.concat_ws("#", "stem", F.floor(before / 4000)))
    room = F.greatest(F.lit(5000), F.sum("ms").over(Window.partitionBy("background")))
    return sampling.placed(u, "background", "ordinal", "ms", room, 23)


PLACED_CLIPS = f"""WITH {v.UNITS}, a AS (SELECT stem, ordinal, ceil(offset_ms - onset_ms)::BIGINT AS ms FROM v_units), b AS (SELECT *, stem || '#' || floor(coalesce(sum(ms) OVER (PARTITION BY stem ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4000)::BIGINT AS background FROM a),
u AS (SELECT *, ('0x' || substr({_md5(23, "background", "ordinal")}, 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM b),
f AS (SELECT *, greatest(5000 - sum(ms) OVER (PARTITION BY background), 0) AS free, coalesce(sum(ms) OVER (PARTITION BY background ORDER BY u, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
SELECT stem, ordinal, ms, background, (before + floor(u * free))::BIGINT AS onset FROM f"""


def coverage_windows(spark: SparkSession, d: str) -> DataFrame:
    """A window of 200 ms around a random unit of each id of a bird, within the recording, as far as 900 ms for the bird reach; T11_units_shrunk and T11_units_and_files are the whole sampling."""
    u = v.units(spark, d)
    total = u.groupBy("stem").agg(F.ceil(F.max("offset_ms")).alias("total"))
    one = sampling.one_per_unit(u.select("bird_id", "id", "stem", "ordinal", F.floor("onset_ms").alias("on"), F.ceil("offset_ms").alias("off")), ["bird_id", "id"], "ordinal", 29).join(total, "stem")
    start, end = sampling.centred(F.col("on"), F.col("off"), 200, F.col("total"))
    w = one.select("bird_id", "id", "stem", start.alias("start"), end.alias("end")).withColumn("n", F.col("end") - F.col("start"))
    return windows.within_budget(w, ["bird_id"], [F.col("id")], "n", 900).select("bird_id", "id", "stem", "start", (F.col("start") + F.col("taken")).alias("end"))


COVERAGE_WINDOWS = f"""WITH {v.UNITS}, t AS (SELECT stem, ceil(max(offset_ms))::BIGINT AS total FROM v_units GROUP BY 1), o AS (SELECT bird_id, id, stem, floor(onset_ms)::BIGINT AS a, ceil(offset_ms)::BIGINT AS b FROM v_units QUALIFY row_number() OVER (PARTITION BY bird_id, id ORDER BY {_md5(29, "bird_id", "id", "ordinal")}, ordinal) = 1),
w AS (SELECT bird_id, id, stem, a, total, greatest(0, least(round_even((a + b) / 2.0::DOUBLE, 0)::BIGINT - 100, total - 200)) AS s FROM o JOIN t USING (stem)), c AS (SELECT bird_id, id, stem, least(a, s) AS start, least(least(a, s) + 200, total) - least(a, s) AS n FROM w),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY bird_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c) SELECT bird_id, id, stem, start, start + least(n, 900 - before) AS "end" FROM b WHERE before < 900"""


def random_crop(spark: SparkSession, d: str) -> DataFrame:
    """A crop of 300 bins at a hashed place; short files from the start."""
    at = F.conv(F.substring(shuffled(31, F.col("stem")), 1, 8), 16, 10).cast("bigint") % F.greatest(F.col("n_timebins") - 299, F.lit(1))
    return v.specs(spark, d).select("stem", at.alias("start"), F.least(F.lit(300).cast("bigint"), F.col("n_timebins")).alias("length"))


RANDOM_CROP = f"WITH {v.SPECS} SELECT stem, ('0x' || substr({_md5(31, 'stem')}, 1, 8))::BIGINT % greatest(n_timebins - 299, 1) AS start, least(300, n_timebins) AS length FROM v_specs"

# How closely a split can meet its totals


def closest_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """How many lines the suppliers have whose number of lines comes closest to 30 per cent, of however many suppliers."""
    t = v.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return splits.best_subset(t, "l_suppkey", "n", 0.3).agg(F.sum("n").alias("lines"))


#: No sum is closer than the nearest whole number, and with tens of suppliers some reach it.
CLOSEST_SUPPLIERS = "SELECT CASE WHEN n * 0.3::DOUBLE - floor(n * 0.3::DOUBLE) > 0.5 THEN ceil(n * 0.3::DOUBLE) ELSE floor(n * 0.3::DOUBLE) END::BIGINT AS lines FROM (SELECT count(*) AS n FROM lineitem)"


def _fold_sql(rows: str, budget: str) -> str:
    """DuckDB's fold over numbered rows (bird_id, k, ordinal, ms), one by one: what is left after each, and whether it was taken."""
    return f"""WITH RECURSIVE {v.UNITS}, r AS MATERIALIZED ({rows}), f AS (SELECT bird_id, 0::BIGINT AS k, NULL::BIGINT AS ordinal, 0::DOUBLE AS ms, false AS taken, {budget}::DOUBLE AS l FROM (SELECT DISTINCT bird_id FROM r)
UNION ALL SELECT r.bird_id, r.k, r.ordinal, r.ms, r.ms <= f.l + 1e-9::DOUBLE, CASE WHEN r.ms <= f.l + 1e-9::DOUBLE THEN f.l - r.ms ELSE f.l END FROM f JOIN r ON r.bird_id = f.bird_id AND r.k = f.k + 1)
SELECT bird_id, ordinal, round(ms, 6) AS ms FROM f WHERE taken"""


EVENT_BUDGET_FOLD = _fold_sql(f"SELECT bird_id, ordinal, offset_ms - onset_ms AS ms, row_number() OVER (PARTITION BY bird_id ORDER BY {_md5(17, 'ordinal')}, ordinal) AS k FROM v_units", "5000")


def distinct_event_fold(spark: SparkSession, d: str) -> DataFrame:
    """Events of each bird in random order that fit a budget of 800 ms; of those with the same place in a recording (to 0.01 ms) the first counts."""
    u = v.units(spark, d).select("bird_id", "stem", F.floor("onset_ms").alias("on"), F.round(F.col("offset_ms") - F.col("onset_ms"), 0).alias("ms"), "ordinal", shuffled(37, F.col("ordinal")).alias("o"))
    out = sampling.fold_budget(u, "bird_id", ["o", "ordinal"], "ms", 800.0, ["bird_id", "stem", "on", "ms"])
    return out.select("bird_id", "ordinal", "ms")


DISTINCT_EVENT_FOLD = _fold_sql(
    f"""SELECT bird_id, ordinal, ms, row_number() OVER (PARTITION BY bird_id ORDER BY o, ordinal) AS k FROM (SELECT bird_id, stem, floor(onset_ms)::BIGINT AS a, round(offset_ms - onset_ms, 0) AS ms, ordinal, {_md5(37, "ordinal")} AS o FROM v_units)
QUALIFY row_number() OVER (PARTITION BY bird_id, stem, a, ms ORDER BY o, ordinal) = 1""",
    "800",
)


def _sample_of_units(spark: SparkSession, d: str, budget: int, seed: int) -> DataFrame:
    u = v.units(spark, d)
    files = u.groupBy("bird_id", "stem").agg(F.ceil(F.max("offset_ms")).alias("total"))
    one = sampling.one_per_unit(u.select("bird_id", "id", "stem", "ordinal", F.floor("onset_ms").alias("on"), F.ceil("offset_ms").alias("off")), ["bird_id", "id"], "ordinal", seed)
    planned = one.select("bird_id", F.col("id").alias("unit"), "stem", "on", "off", F.lit(200).cast("bigint").alias("window_bins")).join(files, ["bird_id", "stem"])
    return sampling.covering_sample(planned, files, "bird_id", "stem", "total", budget, seed)


def _sample_sql(budget: int, seed: int) -> str:
    return f"""WITH {v.UNITS}, t AS (SELECT bird_id, stem, ceil(max(offset_ms))::BIGINT AS total FROM v_units GROUP BY ALL),
o AS (SELECT bird_id, id AS unit, stem, floor(onset_ms)::BIGINT AS a0, ceil(offset_ms)::BIGINT AS b0 FROM v_units QUALIFY row_number() OVER (PARTITION BY bird_id, id ORDER BY {_md5(seed, "bird_id", "id", "ordinal")}, ordinal) = 1),
p AS (SELECT bird_id, unit, stem, total, least(greatest(a0, 0), total - 1) AS a, least(greatest(b0, least(greatest(a0, 0), total - 1) + 1), total) AS b FROM o JOIN t USING (bird_id, stem)),
q AS (SELECT *, b - a AS least_bins, least(greatest(200, b - a), total) AS wide FROM p),
s AS (SELECT *, wide - greatest(0, least(wide - least_bins, sum(wide) OVER (PARTITION BY bird_id) - {budget} - coalesce(sum(wide - least_bins) OVER (PARTITION BY bird_id ORDER BY {_md5(seed, "unit", "stem")}, unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS w FROM q),
c AS (SELECT *, greatest(0, least((a + b) // 2 - w // 2, total - w)) AS s0 FROM s), e AS (SELECT *, CASE WHEN a < s0 THEN a WHEN b > s0 + w THEN greatest(0, b - w) ELSE s0 END AS start FROM c),
x AS (SELECT bird_id, stem, unit, start, least(start + w, total) AS "end" FROM e), l AS (SELECT bird_id, {budget} - coalesce(sum("end" - start), 0)::BIGINT AS room FROM (SELECT DISTINCT bird_id FROM t) LEFT JOIN x USING (bird_id) GROUP BY bird_id),
y AS (SELECT bird_id, stem, total, room, coalesce(sum(total) OVER (PARTITION BY bird_id ORDER BY {_md5(seed + 1, "stem")}, stem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM t JOIN l USING (bird_id) WHERE room > 0 AND total > 0 AND (bird_id, stem) NOT IN (SELECT (bird_id, stem) FROM p))
SELECT bird_id, stem, unit, start, "end" FROM x UNION ALL SELECT bird_id, stem, NULL, 0, least(total, room - before) FROM y WHERE before < room"""


def units_shrunk(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 200 ms around a unit of each id of a bird, shrunk in random order, never below the unit, until the bird has 900 ms."""
    return _sample_of_units(spark, d, 900, 41)


def units_and_files(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 200 ms around a unit of each id of a bird, and other recordings in random order, the last one cut, up to 10,000 s."""
    return _sample_of_units(spark, d, 10_000_000, 43)


def _ms_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recordings with their length, their units' spans, and targets of a fifth and a third of each bird's length."""
    u = v.units(spark, d).select("bird_id", "stem", F.col("id").alias("unit"), F.floor("onset_ms").alias("on"), F.greatest(F.ceil("offset_ms"), F.floor("onset_ms") + 1).alias("off"))
    files = u.groupBy("bird_id", "stem").agg(F.max("off").alias("n"))
    whole = F.sum("n")
    return files, u, files.groupBy("bird_id").agg(F.floor(whole / 5).alias("test"), F.floor(whole / 3).alias("train"))


def split_optimum(spark: SparkSession, d: str) -> DataFrame:
    """Recordings of each bird for test and train, both with every unit, as close to their targets as whole recordings can be."""
    files, u, targets = _ms_files(spark, d)
    return splits.cover_optimum(files, u.select("bird_id", "stem", "unit").distinct(), targets, "bird_id", "stem", "n", 47)


def split_topped_off(spark: SparkSession, d: str) -> DataFrame:
    """Bins and units of each bird's test and train once recordings are cut and added to meet the targets."""
    files, u, targets = _ms_files(spark, d)
    picked = splits.cover_optimum(files, u.select("bird_id", "stem", "unit").distinct(), targets, "bird_id", "stem", "n", 47)
    parts = splits.topped_off(picked, files, u, targets, "bird_id", "stem", "n")
    inside = u.join(parts, ["bird_id", "stem"]).where((F.col("on") >= F.col("start")) & (F.col("off") <= F.col("start") + F.col("length")))
    return parts.groupBy("bird_id", "split").agg(F.sum("length").alias("bins")).join(inside.groupBy("bird_id", "split").agg(F.count_distinct("unit").alias("units")), ["bird_id", "split"])


#: What any such split has, where there are recordings enough.
SPLIT_TOPPED_OFF = f"""WITH {v.UNITS}, f AS (SELECT bird_id, stem, max(greatest(ceil(offset_ms)::BIGINT, floor(onset_ms)::BIGINT + 1)) AS n FROM v_units GROUP BY ALL), s AS (SELECT bird_id, sum(n)::BIGINT AS n FROM f GROUP BY 1), c AS (SELECT bird_id, count(DISTINCT id) AS units FROM v_units GROUP BY 1)
SELECT bird_id, 'test' AS split, n // 5 AS bins, units FROM s JOIN c USING (bird_id) UNION ALL SELECT bird_id, 'train', n // 3, units FROM s JOIN c USING (bird_id)"""

_ALL = {
    "W06_budget_prefix": (budget_prefix, BUDGET_PREFIX), "T07_whole_species_val": (whole_species_val, WHOLE_SPECIES_VAL), "T08_recording_split": (recording_split, RECORDING_SPLIT), "T08_duration_split": (duration_split, DURATION_SPLIT), "T04_per_bird_sample": (per_bird_sample, PER_BIRD_SAMPLE),
    "T05_one_per_unit": (one_per_unit, ONE_PER_UNIT), "T10_best_subset_split": (best_subset_split, BEST_SUBSET_SPLIT), "T12_unit_cover_split": (unit_cover_split, UNIT_COVER_SPLIT), "J14_placed_clips": (placed_clips, PLACED_CLIPS), "T11_coverage_windows": (coverage_windows, COVERAGE_WINDOWS),
    "W18_random_crop": (random_crop, RANDOM_CROP), "T10_closest_suppliers": (closest_suppliers, CLOSEST_SUPPLIERS), "W07_event_budget_fold": (event_budget_fold, EVENT_BUDGET_FOLD), "W07_distinct_event_fold": (distinct_event_fold, DISTINCT_EVENT_FOLD),
    "T11_units_shrunk": (units_shrunk, _sample_sql(900, 41)), "T11_units_and_files": (units_and_files, _sample_sql(10_000_000, 43)), "T12_split_topped_off": (split_topped_off, SPLIT_TOPPED_OFF),
}
#: SQL has no search for an optimum; tests compare it with all choices.
QUERIES = {k: q for k, (q, _) in _ALL.items()} | {"T12_split_optimum": split_optimum}
ORACLES = {k: s for k, (_, s) in _ALL.items()}
