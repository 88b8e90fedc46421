"""Queries over names, times and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonogrid.functions import names, time
from sonogrid.operators import intervals, metrics, tables
from sonogrid.sources import testviews as v

SR, HOP = 32_000, 64


def ms_to_bin_rules(spark: SparkSession, d: str) -> DataFrame:
    """The rules by which milliseconds become time bins and back."""
    ms, t = F.col("onset_ms"), F.col("ordinal") % 5000
    return v.units(spark, d).select(
        "ordinal", time.ms_to_bin(ms, SR, HOP).alias("cut"), time.ms_to_bin(ms, SR, HOP, "half_even").alias("rounded"), time.ms_to_bin(ms, SR, HOP, "scaled").alias("scaled"),
        time.seconds_to_bins(ms / 1e6, SR, HOP).alias("bins"), time.bins_to_ms(t, SR, HOP).alias("ms_whole"), F.round(time.bins_to_ms(t, SR, HOP, False), 6).alias("ms_exact"),
    )


MS_TO_BIN_RULES = f"""WITH {v.UNITS} SELECT ordinal, trunc((onset_ms / 1000) * 32000 / 64)::BIGINT AS "cut", round_even(onset_ms / 1000 * 32000 / 64, 0)::BIGINT AS rounded,
trunc((onset_ms * 32000) / (1000 * 64))::BIGINT AS scaled, greatest(1, round_even(onset_ms / 1e6::DOUBLE * 32000 / 64, 0)::BIGINT) AS bins,
round_even((ordinal % 5000) * 64::DOUBLE / 32000 * 1000, 0)::BIGINT AS ms_whole, round((ordinal % 5000) * 64::DOUBLE / 32000 * 1000, 6) AS ms_exact FROM v_units"""


def chunk_names(spark: SparkSession, d: str) -> DataFrame:
    """names with one or two chunk suffixes, taken apart and put together."""
    made = v.specs(spark, d).withColumn("name", names.build_chunk(F.col("stem"), F.col("doc_id") * 10, F.col("doc_id") * 10 + F.col("n_timebins")))
    made = made.withColumn("name", F.when(F.col("doc_id") % 2 == 0, names.build_chunk(F.col("name"), F.lit(5), F.lit(50), F.col("doc_id"))).otherwise(F.concat("name", F.lit(".npy"))))
    base, start, end = names.parse_chunk(F.col("name"))
    return made.select("doc_id", "name", base.alias("base"), start.alias("chunk_start_ms"), end.alias("chunk_end_ms"))


CHUNK_NAMES = f"""WITH {v.SPECS}, n AS (SELECT doc_id, stem, n_timebins, stem || '__ms_' || doc_id * 10 || '_' || (doc_id * 10 + n_timebins) AS one FROM v_specs)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN one || '__ms_' || (5 + doc_id) || '_' || (50 + doc_id) ELSE one || '.npy' END AS name, stem AS base, doc_id * 10 AS chunk_start_ms, doc_id * 10 + n_timebins AS chunk_end_ms FROM n"""


def stem_rules(spark: SparkSession, d: str) -> DataFrame:
    """Stems, extensions and cleaned names of paths."""
    path = F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.when(F.col("page_id") % 3 == 0, ".wav").when(F.col("page_id") % 3 == 1, ".tar.NPY").otherwise(""))
    p = v.table(spark, d, "pages").select("page_id", path.alias("path"))
    c = F.col("path")
    return p.select("page_id", names.stem(c).alias("stem"), names.loose_stem(c).alias("loose"), names.extension(c).alias("ext"), names.slug(c).alias("slug"), names.sanitized(c).alias("clean"), names.canonical(c, "example").alias("canonical"))


STEM_RULES = r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.tar.NPY' ELSE '' END AS path FROM pages), f AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS file FROM p)
SELECT page_id, regexp_replace(file, '^(.+)\.[^.]+$', '\1') AS stem, regexp_extract(path, '^(.*)\.[^.]*$', 1) AS loose, lower(regexp_extract(file, '^.+(\.[^.]+)$', 1)) AS ext,
trim(regexp_replace(lower(path), '[^a-z0-9]+', '_', 'g'), '_') AS slug, regexp_replace(path, '[^A-Za-z0-9._-]+', '_', 'g') AS clean, CASE WHEN regexp_extract(path, '(example.*)$', 1) <> '' THEN regexp_extract(path, '(example.*)$', 1) ELSE path END AS canonical FROM f"""


def train_seconds_norm(spark: SparkSession, d: str) -> DataFrame:
    """Training times with MAX and lenient numbers, and their order."""
    raw = F.when(F.col("lora_rank") == 1, F.concat(F.lit(" "), "train_seconds", F.lit("p5"))).when(F.col("lora_rank") == 2, "").otherwise(F.col("train_seconds"))
    m = v.metrics(spark, d).select("species", "lora_rank", raw.alias("raw")).distinct()
    is_max, seconds = names.train_seconds(F.col("raw"))
    order = Window.partitionBy("species").orderBy(F.col("is_max").asc_nulls_last(), F.col("seconds").asc_nulls_last(), "lora_rank", "raw")
    return m.withColumns({"is_max": is_max, "seconds": seconds, "as_int": names.lenient_int(F.col("raw"))}).withColumn("k", F.row_number().over(order))


TRAIN_SECONDS_NORM = f"""WITH {v.METRICS}, m AS (SELECT DISTINCT species, lora_rank, CASE lora_rank WHEN 1 THEN ' ' || train_seconds || 'p5' WHEN 2 THEN '' ELSE train_seconds END AS raw FROM v_metrics),
n AS (SELECT *, upper(trim(raw)) = 'MAX' AS is_max, CASE WHEN upper(trim(raw)) <> 'MAX' THEN try_cast(replace(upper(trim(raw)), 'P', '.') AS DOUBLE) END AS seconds, trunc(try_cast(nullif(trim(raw), '') AS DOUBLE))::INT AS as_int FROM m)
SELECT *, row_number() OVER (PARTITION BY species ORDER BY is_max ASC NULLS LAST, seconds ASC NULLS LAST, lora_rank, raw)::INT AS k FROM n"""


def run_name_fields(spark: SparkSession, d: str) -> DataFrame:
    """What a run's name and settings tell."""
    m = v.metrics(spark, d).select("run_name", "run_id", "lora_rank").distinct()
    named = m.withColumn("name", F.concat_ws("_", F.element_at(F.array(*map(F.lit, ("Linear", "x", "finetune", "LoRA"))), (F.col("run_id") % 4 + 1).cast("int")), "run_name"))
    rank = F.when(F.col("run_id") % 5 == 0, names.lora_rank(F.col("run_name")))
    last = F.when(F.col("run_id") % 7 > 0, F.col("run_id") % 9 - 3)
    return named.select("name", "run_id", names.lora_rank(F.col("run_name")).alias("rank"), names.probe_mode(F.col("name"), rank).alias("probe"), names.frozen_layers(last, 4).alias("frozen"), F.regexp_extract("run_name", "^([^_]+)_", 1).alias("species"))


RUN_NAME_FIELDS = f"""WITH {v.METRICS}, m AS (SELECT DISTINCT run_name, run_id, lora_rank FROM v_metrics), n AS (SELECT ['Linear', 'x', 'finetune', 'LoRA'][run_id % 4 + 1] || '_' || run_name AS name, * FROM m)
SELECT name, run_id, lora_rank AS rank, CASE WHEN run_id % 5 = 0 AND lora_rank > 0 THEN 'lora' WHEN run_id % 4 = 3 THEN 'lora' WHEN run_id % 4 = 0 THEN 'linear' WHEN run_id % 4 = 2 THEN 'finetune' ELSE 'unknown' END AS probe,
CASE WHEN run_id % 7 = 0 THEN 'unknown' ELSE CASE least((run_id % 9 - 3) + CASE WHEN run_id % 9 < 3 THEN 4 ELSE 0 END, 3) WHEN 0 THEN '0' WHEN 1 THEN '0,1' WHEN 2 THEN '0,1,2' ELSE 'all' END END AS frozen, split_part(run_name, '_', 1) AS species FROM n"""


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """JSON with defaults."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(-1))
    return v.table(spark, d, "events").select("event_id", k.alias("k"), F.coalesce(F.get_json_object("props", "$.none"), F.lit("absent")).alias("none"))


JSON_PROPS = "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.none'), 'absent') AS none FROM events"


def clip_to_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Units of positive length, clipped to chunks of 500 ms and an open last one."""
    u = v.units(spark, d).where("offset_ms > onset_ms")
    chunks = u.groupBy("stem").agg(F.ceil(F.max("offset_ms") / 500).alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    chunks = chunks.select("stem", (F.col("k") * 500.0).alias("chunk_start"), F.when(F.col("k") < F.col("n") - 1, (F.col("k") + 1) * 500.0).alias("chunk_end"))
    return intervals.clip(u, chunks, "stem", width=500).select("stem", "ordinal", "chunk_start", F.round("onset_ms", 4).alias("onset_ms"), F.round("offset_ms", 4).alias("offset_ms"), "id")


CLIP_TO_CHUNK = f"""WITH {v.UNITS}, u AS (SELECT * FROM v_units WHERE offset_ms > onset_ms), n AS (SELECT stem, ceil(max(offset_ms) / 500)::BIGINT AS n FROM u GROUP BY stem), k AS (SELECT stem, n, unnest(range(0, n)) AS k FROM n),
c AS (SELECT stem, k * 500.0::DOUBLE AS chunk_start, CASE WHEN k < n - 1 THEN (k + 1) * 500.0::DOUBLE ELSE 'infinity'::DOUBLE END AS chunk_end FROM k)
SELECT stem, ordinal, chunk_start, round(greatest(onset_ms, chunk_start) - chunk_start, 4) AS onset_ms, round(least(offset_ms, chunk_end) - chunk_start, 4) AS offset_ms, id FROM u JOIN c USING (stem) WHERE offset_ms > chunk_start AND onset_ms < chunk_end"""


def _merge(tolerance: float):
    def query(spark: SparkSession, d: str) -> DataFrame:
        """Unions of units of a recording."""
        return intervals.merged(v.units(spark, d), "stem", tolerance=tolerance).select("stem", F.round("onset_ms", 6).alias("onset_ms"), F.round("offset_ms", 6).alias("offset_ms"), "n")

    sql = f"""WITH {v.UNITS}, a AS (SELECT *, max(offset_ms) OVER (PARTITION BY stem ORDER BY onset_ms, offset_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_units),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR onset_ms > reach + {tolerance} THEN 1 ELSE 0 END) OVER (PARTITION BY stem ORDER BY onset_ms, offset_ms ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT stem, round(min(onset_ms), 6) AS onset_ms, round(max(offset_ms), 6) AS offset_ms, count(*) AS n FROM b GROUP BY stem, island"""
    return query, sql


def unit_duration_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Units and gaps of each bird, gaps within a recording only."""
    g = intervals.gaps(v.units(spark, d), ["bird_id", "stem"])
    return g.groupBy("bird_id").agg(F.count("*").alias("units"), F.round(F.avg(F.col("offset_ms") - F.col("onset_ms")), 4).alias("mean_ms"), F.count("gap_ms").alias("gaps"), F.round(F.avg("gap_ms"), 4).alias("mean_gap_ms"))


UNIT_DURATION_GAPS = f"""WITH {v.UNITS}, g AS (SELECT *, onset_ms - lag(offset_ms) OVER (PARTITION BY bird_id, stem ORDER BY onset_ms, ordinal) AS gap FROM v_units)
SELECT bird_id, count(*) AS units, round(avg(offset_ms - onset_ms), 4) AS mean_ms, count(*) FILTER (gap >= 0) AS gaps, round(avg(gap) FILTER (gap >= 0), 4) AS mean_gap_ms FROM g GROUP BY bird_id"""


def label_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal ids among a recording's units in order."""
    return intervals.runs(v.units(spark, d), "stem", "ordinal", "id")


LABEL_RUNS = f"""WITH {v.UNITS}, a AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY ordinal) - row_number() OVER (PARTITION BY stem, id ORDER BY ordinal) AS g FROM v_units)
SELECT stem, id, min(ordinal) AS first, max(ordinal) AS last, count(*) AS n FROM a GROUP BY stem, id, g"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Units in whole milliseconds, onsets cut and offsets raised (F11), ids from 1 on."""
    return v.units(spark, d).select("bird_id", "stem", F.floor("onset_ms").alias("s"), F.ceil("offset_ms").alias("e"), (F.col("id") + 1).alias("label"), F.struct("onset_ms", "ordinal").alias("o"), "ordinal", "onset_ms")


def paint_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """What is seen of units painted in the order of their onsets, as runs."""
    return intervals.paint(_spans(spark, d), "stem", "s", "e", "label", "o")


DENSE = """ms AS (SELECT stem, unnest(range(floor(onset_ms)::BIGINT, ceil(offset_ms)::BIGINT)) AS t, id + 1 AS label, onset_ms, ordinal FROM v_units),
top AS (SELECT stem, t, max_by(label, row(onset_ms, ordinal)) AS label FROM ms GROUP BY stem, t),
ends AS (SELECT stem, min(t) AS lo, max(t) + 1 AS hi FROM top GROUP BY stem), grid AS (SELECT stem, unnest(range(lo, hi)) AS t FROM ends),
seen AS (SELECT g.stem, g.t, coalesce(top.label, 0)::BIGINT AS label FROM grid g LEFT JOIN top ON g.stem = top.stem AND g.t = top.t)"""
PAINT_LAST_WINS = f"""WITH {v.UNITS}, {DENSE}, r AS (SELECT *, t - row_number() OVER (PARTITION BY stem, label ORDER BY t) AS g FROM seen)
SELECT stem, min(t) AS start, max(t) + 1 AS "end", label FROM r GROUP BY stem, label, g"""


def dense_window(spark: SparkSession, d: str) -> DataFrame:
    """The two seconds of each recording with most onsets."""
    u = tables.dealt(v.units(spark, d).select("stem", "onset_ms", "offset_ms"), "stem")
    u = u.withColumn("last", F.max("offset_ms").over(Window.partitionBy("stem")))
    return intervals.densest_window(u, "stem", "onset_ms", 2000, F.col("last")).select("stem", F.round("start", 6).alias("start"), "n")


DENSE_WINDOW = f"""WITH {v.UNITS}, l AS (SELECT stem, max(offset_ms) AS last FROM v_units GROUP BY stem), s AS (SELECT DISTINCT u.stem, greatest(0, least(onset_ms, last - 2000)) AS s FROM v_units u JOIN l USING (stem)),
c AS (SELECT s.stem, s.s, count(*) AS n FROM s JOIN v_units u ON u.stem = s.stem AND u.onset_ms BETWEEN s.s AND s.s + 2000 GROUP BY s.stem, s.s), k AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY n DESC, s) AS k FROM c)
SELECT stem, round(s, 6) AS start, n FROM k WHERE k = 1"""


def unit_file_support(spark: SparkSession, d: str) -> DataFrame:
    """In how many recordings of a bird each unit occurs, and whether that is enough."""
    return v.units(spark, d).groupBy("bird_id", "id").agg(F.count_distinct("stem").alias("files")).withColumn("feasible", F.col("files") >= 2)


UNIT_FILE_SUPPORT = f"WITH {v.UNITS} SELECT bird_id, id, count(DISTINCT stem) AS files, count(DISTINCT stem) >= 2 AS feasible FROM v_units GROUP BY bird_id, id"


def resolution_limit_f1(spark: SparkSession, d: str) -> DataFrame:
    """The best score that labels at a resolution of 10 ms can reach.

    The truth is painted by the millisecond and read by runs, not by bins: a run is cut at the multiples of the
    resolution, each step takes the label of most milliseconds, and steps are compared with the runs by length.
    """
    r = 10
    truth = intervals.paint(_spans(spark, d), ["bird_id", "stem"], "s", "e", "label", "o")
    scored = metrics.at_resolution(truth, ["bird_id", "stem"], r)
    out = metrics.macro(metrics.confusion(scored, ["bird_id"], "label", "majority", len(v.TYPES) + 1, "w"), ["bird_id"])
    return out.select("bird_id", F.round("macro_f1", 6).alias("macro_f1"), F.round("error_rate", 6).alias("error_rate"))


RESOLUTION_LIMIT_F1 = f"""WITH {v.UNITS}, {DENSE}, n AS (SELECT stem, t // 10 AS step, label, count(*) AS n FROM seen GROUP BY ALL),
m AS (SELECT stem, step, arg_min(label, row(-n, label)) AS pred FROM n GROUP BY stem, step), p AS (SELECT s.stem, s.label, m.pred FROM seen s JOIN m ON s.stem = m.stem AND s.t // 10 = m.step),
b AS (SELECT DISTINCT stem, bird_id FROM v_units), q AS (SELECT bird_id, label, pred, count(*) AS w FROM p JOIN b USING (stem) GROUP BY ALL),
k AS (SELECT DISTINCT bird_id, unnest(range(0, 6)) AS c FROM b), x AS (SELECT k.bird_id, c, coalesce(sum(w) FILTER (label = c AND pred = c), 0)::DOUBLE AS tp, coalesce(sum(w) FILTER (label <> c AND pred = c), 0)::DOUBLE AS fp,
coalesce(sum(w) FILTER (label = c AND pred <> c), 0)::DOUBLE AS fn FROM k LEFT JOIN q USING (bird_id) GROUP BY k.bird_id, c)
SELECT bird_id, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 100 * 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1, round(100 * (1 - sum(tp) / sum(tp + fn)), 6) AS error_rate FROM x GROUP BY bird_id"""


def detected_ms(spark: SparkSession, d: str) -> DataFrame:
    """Annotated time by bird and recording, with subtotals."""
    ms = F.round(F.sum(F.col("offset_ms") - F.col("onset_ms")), 3).alias("ms")
    return v.units(spark, d).rollup("bird_id", "stem").agg(ms, F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


DETECTED_MS = f"WITH {v.UNITS} SELECT bird_id, stem, round(sum(offset_ms - onset_ms), 3) AS ms, count(*) AS n, grouping(bird_id, stem)::INT AS level FROM v_units GROUP BY ROLLUP (bird_id, stem)"


def envelope_regroup(spark: SparkSession, d: str) -> DataFrame:
    """Units gathered into events of ten in order, with envelope and sorted units as text; a placeholder where an event has none."""
    u = v.units(spark, d).withColumn("k", F.floor((F.row_number().over(Window.partitionBy("stem").orderBy("ordinal")) - 1) / 10))
    e = u.groupBy("bird_id", "stem", "k").agg(F.min("onset_ms").alias("lo"), F.max("offset_ms").alias("hi"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("onset_ms", "ordinal", "id"))).alias("units"))
    return e.select("bird_id", "stem", "k", F.round("lo", 6).alias("onset_ms"), F.round("hi", 6).alias("offset_ms"), "n", F.array_join(F.transform("units", lambda x: x["id"].cast("string")), ",").alias("ids"))


ENVELOPE_REGROUP = f"""WITH {v.UNITS}, u AS (SELECT *, (row_number() OVER (PARTITION BY stem ORDER BY ordinal) - 1) // 10 AS k FROM v_units)
SELECT bird_id, stem, k, round(min(onset_ms), 6) AS onset_ms, round(max(offset_ms), 6) AS offset_ms, count(*) AS n, string_agg(id, ',' ORDER BY onset_ms, ordinal, id) AS ids FROM u GROUP BY bird_id, stem, k"""


def stutter_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Units repeated id + 1 times each, later ones moved back by what was added."""
    u = v.units(spark, d)
    k, length = F.col("id") + 1, F.col("offset_ms") - F.col("onset_ms")
    before = F.coalesce(F.sum(F.col("id") * length).over(Window.partitionBy("stem").orderBy("onset_ms", "ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = u.withColumn("shift", before).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1)))
    on = F.col("onset_ms") + F.col("shift") + F.col("copy") * length
    return out.select("stem", "ordinal", "copy", F.round(on, 4).alias("onset_ms"), F.round(on + length, 4).alias("offset_ms"))


STUTTER_TIMELINE = f"""WITH {v.UNITS}, s AS (SELECT *, coalesce(sum(id * (offset_ms - onset_ms)) OVER (PARTITION BY stem ORDER BY onset_ms, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM v_units),
c AS (SELECT *, unnest(range(0, id + 1)) AS copy FROM s) SELECT stem, ordinal, copy, round(onset_ms + shift + copy * (offset_ms - onset_ms), 4) AS onset_ms, round(onset_ms + shift + copy * (offset_ms - onset_ms) + (offset_ms - onset_ms), 4) AS offset_ms FROM c"""


def class_map(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct labels to numbers from 0, and the number of classes. The labels are few by nature."""
    e = v.table(spark, d, "events").select("event_type").distinct()
    return e.select("event_type", (F.dense_rank().over(Window.orderBy("event_type")) - 1).alias("class"), (F.count("*").over(Window.partitionBy()) + 1).alias("classes"))


CLASS_MAP = "WITH e AS (SELECT DISTINCT event_type FROM events) SELECT event_type, (dense_rank() OVER (ORDER BY event_type) - 1)::INT AS class, count(*) OVER () + 1 AS classes FROM e"


def bin_ms_spans(spark: SparkSession, d: str) -> DataFrame:
    """The milliseconds that each of a file's bins stands for, at least one, the last bin to the end: their number, sums and reach by file."""
    s = v.specs(spark, d).withColumnRenamed("n_timebins", "n").where("n > 0").withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    start, end = time.bin_span_ms(F.col("t"), F.col("n"), F.lit(0.7))
    return s.groupBy("stem").agg(F.count("*").alias("bins"), F.sum(start).alias("starts"), F.sum(end).alias("ends"), F.sum((end - start) * (F.col("t") % 7)).alias("spans"), F.max(end).alias("reach"))


BIN_MS_SPANS = f"""WITH {v.SPECS}, s AS (SELECT stem, n_timebins AS n FROM v_specs WHERE n_timebins > 0), t AS (SELECT stem, n, unnest(range(0, n)) AS t FROM s),
b AS (SELECT stem, t, floor(t * 0.7::DOUBLE)::BIGINT AS a, greatest(CASE WHEN t = n - 1 THEN ceil(n * 0.7::DOUBLE) ELSE floor((t + 1) * 0.7::DOUBLE) END, floor(t * 0.7::DOUBLE) + 1)::BIGINT AS e FROM t)
SELECT stem, count(*) AS bins, sum(a)::BIGINT AS starts, sum(e)::BIGINT AS ends, sum((e - a) * (t % 7))::BIGINT AS spans, max(e) AS reach FROM b GROUP BY stem"""


def pairs_by_overlap(spark: SparkSession, d: str) -> DataFrame:
    """J03 in buckets of time: how many other units of its recording each unit overlaps."""
    u = v.units(spark, d).where("offset_ms > onset_ms").select("stem", "ordinal", "onset_ms", "offset_ms")
    o = u.select("stem", F.col("ordinal").alias("other"), F.col("onset_ms").alias("on2"), F.col("offset_ms").alias("off2"))
    return intervals.range_join(u, o, "stem", ("onset_ms", "offset_ms"), ("on2", "off2"), width=200.0).where("ordinal <> other").groupBy("stem").agg(F.count("*").alias("pairs"))


PAIRS_BY_OVERLAP = f"WITH {v.UNITS}, u AS (SELECT * FROM v_units WHERE offset_ms > onset_ms) SELECT a.stem, count(*) AS pairs FROM u a JOIN u b ON a.stem = b.stem AND a.ordinal <> b.ordinal AND a.onset_ms < b.offset_ms AND b.onset_ms < a.offset_ms GROUP BY a.stem"

_M0, _M50 = _merge(0.0), _merge(50.0)
QUERIES = {
    "F01_ms_to_bin_rules": ms_to_bin_rules, "F07_chunk_names": chunk_names, "P01_stem_rules": stem_rules, "P22_train_seconds_norm": train_seconds_norm, "P21_run_name_fields": run_name_fields,
    "F37_json_props": json_props, "J03_clip_to_chunk": clip_to_chunk, "W08_merge_intervals_tol0": _M0[0], "W08_merge_intervals_tol50": _M50[0], "A04_unit_duration_gaps": unit_duration_gaps,
    "W05_label_runs": label_runs, "W09_paint_last_wins": paint_last_wins, "J15_dense_window": dense_window, "J16_unit_file_support": unit_file_support, "A08_resolution_limit_f1": resolution_limit_f1,
    "A03_detected_ms": detected_ms, "A33_envelope_regroup": envelope_regroup, "W16_stutter_timeline": stutter_timeline, "P27_class_map": class_map, "F10_bin_ms_spans": bin_ms_spans, "J03_pairs_by_overlap": pairs_by_overlap,
}
ORACLES = {
    "F01_ms_to_bin_rules": MS_TO_BIN_RULES, "F07_chunk_names": CHUNK_NAMES, "P01_stem_rules": STEM_RULES, "P22_train_seconds_norm": TRAIN_SECONDS_NORM, "P21_run_name_fields": RUN_NAME_FIELDS,
    "F37_json_props": JSON_PROPS, "J03_clip_to_chunk": CLIP_TO_CHUNK, "W08_merge_intervals_tol0": _M0[1], "W08_merge_intervals_tol50": _M50[1], "A04_unit_duration_gaps": UNIT_DURATION_GAPS,
    "W05_label_runs": LABEL_RUNS, "W09_paint_last_wins": PAINT_LAST_WINS, "J15_dense_window": DENSE_WINDOW, "J16_unit_file_support": UNIT_FILE_SUPPORT, "A08_resolution_limit_f1": RESOLUTION_LIMIT_F1,
    "A03_detected_ms": DETECTED_MS, "A33_envelope_regroup": ENVELOPE_REGROUP, "W16_stutter_timeline": STUTTER_TIMELINE, "P27_class_map": CLASS_MAP, "F10_bin_ms_spans": BIN_MS_SPANS, "J03_pairs_by_overlap": PAIRS_BY_OVERLAP,
}
