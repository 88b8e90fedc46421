"""Queries over run metrics and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonogrid.functions import names
from sonogrid.operators import metrics, order_stats, tables
from sonogrid.sources import testviews as v

OK = "num_classes = num_classes_train AND num_classes = num_classes_val"


def _good(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose class counts agree."""
    m = v.metrics(spark, d)
    return m.where(tables.consistent(m))


def _r(c, n: int = 6):
    return F.round(c, n)


def probe_table(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation by species and probe."""
    g = _good(spark, d).groupBy("species", "probe_mode")
    return g.agg(F.count("*").alias("n"), _r(F.avg("f1"), 4).alias("f1_mean"), _r(F.stddev_pop("f1"), 4).alias("f1_std"), _r(F.avg("fer"), 4).alias("fer_mean"))


PROBE_TABLE = f"WITH {v.METRICS} SELECT species, probe_mode, count(*) AS n, round(avg(f1), 4) AS f1_mean, round(stddev_pop(f1), 4) AS f1_std, round(avg(fer), 4) AS fer_mean FROM v_metrics WHERE {OK} GROUP BY ALL"


def grid_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Rank by rate with cells of mean and deviation, of one mode; '-' for none."""
    rates = [0.0, 0.02, 0.04, 0.06, 0.08, 0.1]
    g = _good(spark, d).where((F.trim("mode") == "O") & F.col("lr").isin(rates)).groupBy("lora_rank").pivot("lr", rates).agg(tables.cell("f1"))
    return g.select("lora_rank", *(F.coalesce(F.col(f"`{r}`"), F.lit("-")).alias(f"lr_{round(r * 100)}") for r in rates))


GRID_PIVOT = f"""WITH {v.METRICS} SELECT lora_rank, {", ".join(f"CASE WHEN count(f1) FILTER (lr = {r / 100}) > 0 THEN printf('%.2f +- %.2f', avg(f1) FILTER (lr = {r / 100}), stddev_pop(f1) FILTER (lr = {r / 100})) ELSE '-' END AS lr_{r}" for r in (0, 2, 4, 6, 8, 10))}
FROM v_metrics WHERE {OK} AND mode = 'O' GROUP BY lora_rank"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return _good(spark, d).groupBy("lora_rank", "lr").agg(F.count("*").alias("n"), _r(F.avg("f1")).alias("f1_mean"), _r(F.avg("fer")).alias("fer_mean"))


def grid_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Configurations ranked by score, then rank and rate. They are few: one row for each that was tried."""
    return _ranked(spark, d).withColumn("rank_by_f1", F.row_number().over(Window.orderBy(F.desc("f1_mean"), "lora_rank", "lr")))


RANKED = f"SELECT lora_rank, lr, count(*) AS n, round(avg(f1), 6) AS f1_mean, round(avg(fer), 6) AS fer_mean FROM v_metrics WHERE {OK} GROUP BY lora_rank, lr"
GRID_RANKING = f"WITH {v.METRICS}, r AS ({RANKED}) SELECT *, row_number() OVER (ORDER BY f1_mean DESC, lora_rank, lr)::INT AS rank_by_f1 FROM r"


def duration_minmax(spark: SparkSession, d: str) -> DataFrame:
    """Scores at a species' shortest and longest training; MAX is the longest."""
    is_max, seconds = names.train_seconds(F.col("train_seconds"))
    key = F.struct(is_max.alias("m"), F.coalesce(seconds, F.lit(0.0)).alias("s"))
    g = _good(spark, d).groupBy("species", "train_seconds").agg(_r(F.avg("f1"), 3).alias("f1"), _r(F.coalesce(F.stddev_samp("f1"), F.lit(0.0)), 3).alias("std")).withColumn("key", key)
    at = lambda f, c, a: f(c, "key").alias(a)
    return g.groupBy("species").agg(at(F.min_by, "train_seconds", "shortest"), at(F.min_by, "f1", "f1_short"), at(F.min_by, "std", "std_short"), at(F.max_by, "train_seconds", "longest"), at(F.max_by, "f1", "f1_long"), at(F.max_by, "std", "std_long"))


DURATION_MINMAX = f"""WITH {v.METRICS}, g AS (SELECT species, train_seconds, round(avg(f1), 3) AS f1, round(coalesce(stddev_samp(f1), 0), 3) AS std, row(train_seconds = 'MAX', coalesce(try_cast(train_seconds AS DOUBLE), 0)) AS k FROM v_metrics WHERE {OK} GROUP BY ALL)
SELECT species, arg_min(train_seconds, k) AS shortest, arg_min(f1, k) AS f1_short, arg_min(std, k) AS std_short, arg_max(train_seconds, k) AS longest, arg_max(f1, k) AS f1_long, arg_max(std, k) AS std_long FROM g GROUP BY species"""


def lr_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Scores by rate in long form."""
    g = _good(spark, d).groupBy("lr").agg(_r(F.avg("f1"), 4).alias("f1"), _r(F.avg("fer"), 4).alias("fer"), F.count_distinct("bird").cast("double").alias("birds"), F.count("*").cast("double").alias("runs"))
    return g.unpivot("lr", ["f1", "fer", "birds", "runs"], "metric", "value")


LR_SWEEP = f"""WITH {v.METRICS}, g AS (SELECT lr, round(avg(f1), 4) AS f1, round(avg(fer), 4) AS fer, count(DISTINCT bird)::DOUBLE AS birds, count(*)::DOUBLE AS runs FROM v_metrics WHERE {OK} GROUP BY lr) UNPIVOT g ON f1, fer, birds, runs INTO NAME metric VALUE value"""


def summary_all(spark: SparkSession, d: str) -> DataFrame:
    """By probe, mode and species, and the mean of the species' means as ALL."""
    g = v.metrics(spark, d).groupBy("probe_mode", "mode", "species").agg(F.count("*").alias("n"), F.avg("f1").alias("m"), F.stddev_pop("f1").alias("s"))
    every = g.groupBy("probe_mode", "mode").agg(F.sum("n").alias("n"), F.avg("m").alias("m"), F.stddev_pop("m").alias("s")).withColumn("species", F.lit("ALL"))
    return g.unionByName(every).select("probe_mode", "mode", "species", "n", _r(F.col("m")).alias("f1_mean"), _r(F.col("s")).alias("f1_std"))


SUMMARY_ALL = f"""WITH {v.METRICS}, g AS (SELECT probe_mode, mode, species, count(*) AS n, avg(f1) AS m, stddev_pop(f1) AS s FROM v_metrics GROUP BY ALL)
SELECT probe_mode, mode, species, n, round(m, 6) AS f1_mean, round(s, 6) AS f1_std FROM g UNION ALL SELECT probe_mode, mode, 'ALL', sum(n)::BIGINT, round(avg(m), 6), round(stddev_pop(m), 6) FROM g GROUP BY probe_mode, mode"""


def species_bird_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Seconds and distinct runs by bird and species; the species' units are pairs of bird and run. Mean and sample deviation over birds."""
    b = v.metrics(spark, d).groupBy("species", "bird").agg(F.sum("lora_rank").cast("bigint").alias("seconds"), (F.count_distinct("run_id") + 1).alias("units"))
    return b.groupBy("species").agg(F.sum("seconds").alias("seconds"), (F.sum(F.col("units") - 1) + 1).alias("units"), _r(F.avg("seconds")).alias("mean"), _r(F.coalesce(F.stddev_samp("seconds"), F.lit(0.0))).alias("std"))


SPECIES_BIRD_ROLLUP = f"""WITH {v.METRICS}, b AS (SELECT species, bird, sum(lora_rank)::BIGINT AS seconds, count(DISTINCT run_id) AS units FROM v_metrics GROUP BY ALL)
SELECT species, sum(seconds)::BIGINT AS seconds, sum(units)::BIGINT + 1 AS units, round(avg(seconds), 6) AS mean, round(coalesce(stddev_samp(seconds), 0), 6) AS std FROM b GROUP BY species"""


def _means(spark: SparkSession, d: str) -> DataFrame:
    """The mean within a bird, then over birds."""
    b = _good(spark, d).groupBy("species", "lora_rank", "lr", "bird").agg(F.avg("f1").alias("f1"))
    return b.groupBy("species", "lora_rank", "lr").agg(_r(F.avg("f1")).alias("f1"), F.count("*").alias("birds"))


MEANS = f"means AS (SELECT species, lora_rank, lr, round(avg(f1), 6) AS f1, count(*) AS birds FROM (SELECT species, lora_rank, lr, bird, avg(f1) AS f1 FROM v_metrics WHERE {OK} GROUP BY ALL) GROUP BY species, lora_rank, lr)"
SERIES = f"WITH {v.METRICS}, {MEANS} SELECT * FROM means"


def best_config(spark: SparkSession, d: str) -> DataFrame:
    """Each species' best configuration; ties by rank, then rate."""
    return tables.first_by(_means(spark, d), ["species"], F.desc("f1"), F.col("lora_rank"), F.col("lr"))


BEST_CONFIG = f"WITH {v.METRICS}, {MEANS} SELECT species, lora_rank, lr, f1, birds FROM means QUALIFY row_number() OVER (PARTITION BY species ORDER BY f1 DESC, lora_rank, lr) = 1"


def minimax_regret(spark: SparkSession, d: str) -> DataFrame:
    """Configurations that every species has, by their largest loss; those within 15 of none are feasible."""
    r = tables.regrets(_means(spark, d), ["lora_rank", "lr"], "species", "f1")
    order = Window.orderBy("g", F.desc("mean"), "lora_rank", "lr")
    return r.select("lora_rank", "lr", _r(F.col("g"), 4).alias("g"), _r(F.col("mean"), 4).alias("mean")).withColumn("rank_by_g", F.row_number().over(order)).withColumn("feasible", F.col("g") <= 15 + 1e-12)


MINIMAX_REGRET = f"""WITH {v.METRICS}, {MEANS}, b AS (SELECT species, max(f1) AS best FROM means GROUP BY species), r AS (SELECT lora_rank, lr, round(max(best - f1), 4) AS g, round(avg(f1), 4) AS mean FROM means JOIN b USING (species)
GROUP BY lora_rank, lr HAVING count(DISTINCT species) = (SELECT count(DISTINCT species) FROM means)) SELECT *, row_number() OVER (ORDER BY g, mean DESC, lora_rank, lr)::INT AS rank_by_g, g <= 15 AS feasible FROM r"""


def concat_union(spark: SparkSession, d: str) -> DataFrame:
    """Two tables with the same header as one."""
    m = v.metrics(spark, d).select("species", "bird", "f1")
    return tables.concatenated(m.where("bird % 2 = 0"), m.where("bird % 3 = 0")).groupBy("species").agg(F.count("*").alias("n"), F.sum("bird").alias("birds"))


CONCAT_UNION = f"WITH {v.METRICS}, u AS (SELECT * FROM v_metrics WHERE bird % 2 = 0 UNION ALL SELECT * FROM v_metrics WHERE bird % 3 = 0) SELECT species, count(*) AS n, sum(bird)::BIGINT AS birds FROM u GROUP BY species"


def insert_new_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs that the table doesn't have yet, added with a new column."""
    m = v.metrics(spark, d).groupBy("run_name").agg(F.max("run_id").alias("run_id"))
    return tables.insert_only(m.where("run_id % 3 = 0"), m.where("run_id % 2 = 0").withColumn("added", F.lit(1)), "run_name")


INSERT_NEW_RUNS = f"""WITH {v.METRICS}, m AS (SELECT run_name, max(run_id) AS run_id FROM v_metrics GROUP BY 1) SELECT run_name, run_id, NULL::INT AS added FROM m WHERE run_id % 3 = 0 UNION ALL SELECT run_name, run_id, 1 FROM m WHERE run_id % 2 = 0 AND run_id % 3 <> 0"""


def exact_dups(spark: SparkSession, d: str) -> DataFrame:
    """Rows that repeat another in full."""
    m = v.metrics(spark, d).select("species", "lora_rank", "lr", "train_seconds")
    return m.groupBy(*m.columns).agg(F.count("*").alias("c")).groupBy("species").agg(F.sum("c").alias("n"), F.sum(F.col("c") - 1).alias("dups"))


EXACT_DUPS = f"WITH {v.METRICS} SELECT species, count(*) AS n, count(*) - count(DISTINCT (lora_rank, lr, train_seconds)) AS dups FROM v_metrics GROUP BY species"


def allowed_stems_semi(spark: SparkSession, d: str) -> DataFrame:
    """Files whose recording is allowed."""
    allowed = v.table(spark, d, "labels").where("quality = 1").select(F.concat(F.lit("d"), "doc_id").alias("stem"))
    return v.specs(spark, d).join(allowed, "stem", "left_semi").groupBy("bird_id").agg(F.count("*").alias("n"), F.sum("n_timebins").alias("bins"))


ALLOWED_STEMS_SEMI = f"WITH {v.SPECS} SELECT bird_id, count(*) AS n, sum(n_timebins)::BIGINT AS bins FROM v_specs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY bird_id"


def missing_stems_anti(spark: SparkSession, d: str) -> DataFrame:
    """Files without a label."""
    have = v.table(spark, d, "labels").select(F.concat(F.lit("d"), "doc_id").alias("stem"))
    return v.specs(spark, d).join(have, "stem", "left_anti").select("stem", "bird_id")


MISSING_STEMS_ANTI = f"WITH {v.SPECS} SELECT stem, bird_id FROM v_specs WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def annotated_files(spark: SparkSession, d: str) -> DataFrame:
    """Files with their annotations' counts; 'skip' for what is missing, the first of repeated recordings."""
    ann = v.table(spark, d, "labels").select(F.concat(F.lit("d"), "doc_id").alias("stem"), "quality", "toxic")
    ann = tables.first_by(ann, ["stem"], F.col("quality"), F.col("toxic"))
    return v.specs(spark, d).join(ann, "stem").groupBy("species", "quality").agg(F.count("*").alias("n"), F.sum("toxic").cast("bigint").alias("toxic"))


ANNOTATED_FILES = f"WITH {v.SPECS} SELECT species, quality, count(*) AS n, sum(toxic)::BIGINT AS toxic FROM v_specs JOIN labels USING (doc_id) GROUP BY ALL"


def experiment_cross(spark: SparkSession, d: str) -> DataFrame:
    """Every dataset by every rank and rate. The sides are lists of settings."""
    species = v.metrics(spark, d).select("species").distinct()
    grid = spark.range(3).select((F.pow(F.lit(2), F.col("id") + 2)).cast("bigint").alias("rank")).crossJoin(spark.range(4).select((F.col("id") + 1).alias("lr_no")))
    return species.crossJoin(F.broadcast(grid)).withColumn("name", F.concat_ws("_", names.slug(F.col("species")), F.concat(F.lit("r"), F.col("rank").cast("string"))))


EXPERIMENT_CROSS = f"WITH {v.METRICS} SELECT species, rank, lr_no, replace(lower(species), '#', '_') || '_r' || rank AS name FROM (SELECT DISTINCT species FROM v_metrics), (VALUES (4::BIGINT), (8), (16)) r(rank), (SELECT range + 1 AS lr_no FROM range(4))"


def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts and durations by species, with exact percentiles."""
    m = v.manifest(spark, d).withColumn("sec", F.col("end") - F.col("start"))
    ranked = order_stats.percentiles(m, ["species"], "sec", {"median": 0.5, "p95": 0.95}).select("species", "median", _r(F.col("p95")).alias("p95"))
    return m.groupBy("species").agg(F.count("*").alias("rows"), F.count_distinct("recording").alias("recordings"), F.sum("sec").alias("total"), _r(F.avg("sec")).alias("mean")).join(ranked, "species")


MANIFEST_SUMMARY = f"""WITH {v.MANIFEST}, m AS (SELECT *, "end" - start AS sec FROM v_manifest) SELECT species, count(*) AS rows, count(DISTINCT recording) AS recordings, sum(sec) AS total, round(avg(sec), 6) AS mean, quantile_cont(sec, 0.5) AS median, round(quantile_cont(sec, 0.95), 6) AS p95 FROM m GROUP BY species"""


def top_recordings(spark: SparkSession, d: str) -> DataFrame:
    """The ten recordings with most snippets."""
    return v.manifest(spark, d).groupBy("recording").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "recording").limit(10)


TOP_RECORDINGS = f"WITH {v.MANIFEST} SELECT recording, count(*) AS n FROM v_manifest GROUP BY 1 ORDER BY n DESC, recording LIMIT 10"


def coverage_pct(spark: SparkSession, d: str) -> DataFrame:
    """The share of customers with an order, by segment and over all."""
    c = v.table(spark, d, "customer").join(v.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("has", F.lit(1)), "c_custkey", "left")
    return c.rollup("c_mktsegment").agg(F.count("has").alias("k"), F.count("*").alias("n"), _r(100 * F.count("has") / F.count("*")).alias("pct"))


COVERAGE_PCT = "WITH c AS (SELECT c_mktsegment, c_custkey IN (SELECT o_custkey FROM orders) AS has FROM customer) SELECT c_mktsegment, count(*) FILTER (has) AS k, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (has) / count(*), 6) AS pct FROM c GROUP BY ROLLUP (c_mktsegment)"


def code_counters(spark: SparkSession, d: str) -> DataFrame:
    """Values counted by kind, and whether they are expected."""
    e = v.table(spark, d, "events").select(F.when(F.col("event_id") % 4 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 4 == 1, F.lit(None)).otherwise(F.col("event_type")).alias("code"))
    kind = F.when(F.col("code").isNull(), "missing").when(F.col("code").try_cast("bigint").isNotNull(), "int").otherwise("str")
    return e.groupBy("code", kind.alias("kind")).agg(F.count("*").alias("n")).withColumn("expected", F.coalesce(F.col("code").isin("click", "view", "7"), F.lit(False)))


CODE_COUNTERS = """WITH e AS (SELECT CASE event_id % 4 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN NULL ELSE event_type END AS code FROM events)
SELECT code, CASE WHEN code IS NULL THEN 'missing' WHEN try_cast(code AS BIGINT) IS NOT NULL THEN 'int' ELSE 'str' END AS kind, count(*) AS n, coalesce(code IN ('click', 'view', '7'), false) AS expected FROM e GROUP BY code"""


def dedup_detections(spark: SparkSession, d: str) -> DataFrame:
    """Detections with their ends in order, each (recording, onset, offset) once, counted by recording."""
    u = v.units(spark, d).select("stem", F.round("offset_ms", -1).alias("a"), F.round("onset_ms", -1).alias("b"))
    u = u.select("stem", F.least("a", "b").alias("onset"), F.greatest("a", "b").alias("offset")).dropDuplicates()
    return u.groupBy("stem").agg(F.count("*").alias("n"), F.min("onset").alias("first"), F.max("offset").alias("last"))


DEDUP_DETECTIONS = f"WITH {v.UNITS}, u AS (SELECT DISTINCT stem, round(onset_ms, -1) AS a, round(offset_ms, -1) AS b FROM v_units) SELECT stem, count(*) AS n, min(a) AS first, max(b) AS last FROM u GROUP BY stem"


def split_report(spark: SparkSession, d: str) -> DataFrame:
    """Each bird's unit ids in a test and a train part, and what either lacks."""
    u = v.units(spark, d).withColumn("test", F.pmod(names.hash_int(F.concat("stem", "ordinal")), F.lit(40)) == 0)
    s = u.groupBy("bird_id").agg(F.array_sort(F.collect_set("id")).alias("pool"), F.array_sort(F.collect_set(F.when(F.col("test"), F.col("id")))).alias("t"), F.array_sort(F.collect_set(F.when(~F.col("test"), F.col("id")))).alias("r"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return s.select("bird_id", F.size("pool").alias("pool"), F.size("t").alias("test"), F.size("r").alias("train"), text(F.array_except("pool", "t")).alias("missing_test"), text(F.array_except("pool", "r")).alias("missing_train"))


SPLIT_REPORT = f"""WITH {v.UNITS}, u AS (SELECT bird_id, id, ('0x' || substr(sha1(stem || ordinal), 1, 8))::BIGINT % 40 = 0 AS test FROM v_units), g AS (SELECT bird_id, id, bool_or(test) AS t, bool_or(NOT test) AS r FROM u GROUP BY ALL)
SELECT bird_id, count(*)::INT AS pool, (count(*) FILTER (t))::INT AS test, (count(*) FILTER (r))::INT AS train, coalesce(string_agg(id, ',' ORDER BY id) FILTER (NOT t), '') AS missing_test, coalesce(string_agg(id, ',' ORDER BY id) FILTER (NOT r), '') AS missing_train FROM g GROUP BY bird_id"""


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("truth")).join(v.table(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") > 1000).cast("bigint").alias("pred")), "doc_id")


TRUTH = "t AS (SELECT source, quality::BIGINT AS truth, (n_chars > 1000)::BIGINT AS pred FROM labels JOIN documents USING (doc_id))"


def binary_f1_fer(spark: SparkSession, d: str) -> DataFrame:
    """Binary scores and error rate by recorder."""
    t, p = F.col("truth") == 1, F.col("pred") == 1
    g = _truth(spark, d).groupBy("source").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(F.col("truth") == F.col("pred")).alias("ok"), F.count("*").alias("n"))
    return g.select("source", _r(metrics.f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("f1"), _r(100 * (1 - metrics.ratio(F.col("ok"), F.col("n")))).alias("fer"))


BINARY_F1_FER = f"""WITH {TRUTH}, g AS (SELECT source, (count(*) FILTER (truth = 1 AND pred = 1))::DOUBLE AS tp, count(*) FILTER (truth <> pred) AS wrong, count(*) AS n FROM t GROUP BY source)
SELECT source, round(CASE WHEN tp > 0 THEN 200 * tp / (2 * tp + wrong) ELSE 0 END, 6) AS f1, round(100.0::DOUBLE * wrong / n, 6) AS fer FROM g"""


def confusion_by_class(spark: SparkSession, d: str) -> DataFrame:
    """Counts of three classes by recorder, the absent one too."""
    return metrics.confusion(_truth(spark, d), ["source"], "truth", "pred", 3)


CONFUSION_BY_CLASS = f"""WITH {TRUTH} SELECT source, c AS class, count(*) FILTER (truth = c AND pred = c) AS tp, count(*) FILTER (truth <> c AND pred = c) AS fp, count(*) FILTER (truth = c AND pred <> c) AS fn FROM t, (SELECT range AS c FROM range(3)) GROUP BY source, c"""


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    """Total over count times classes; 0 for an absent class."""
    t = _truth(spark, d)
    n = t.groupBy(F.col("truth").alias("class")).agg(F.count("*").alias("n"))
    every = spark.range(3).withColumnRenamed("id", "class").join(n, "class", "left")
    return every.select("class", _r(F.coalesce(F.sum("n").over(Window.partitionBy()) / (F.col("n") * 3), F.lit(0.0))).alias("weight"))


CLASS_WEIGHTS = f"WITH {TRUTH}, n AS (SELECT truth, count(*) AS n FROM t GROUP BY 1) SELECT range AS class, round(coalesce((SELECT count(*) FROM t) / (n * 3.0::DOUBLE), 0), 6) AS weight FROM range(3) LEFT JOIN n ON truth = range"


def loss_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Mean value of every 500 steps, and the median."""
    e = v.table(spark, d, "events").select((F.col("event_id") + 1).alias("step"), "value").withColumn("k", F.floor((F.col("step") - 1) / 500))
    medians = order_stats.percentiles(e, ["k"], "value", {"median": 0.5}).select("k", _r(F.col("median")).alias("median"))
    return e.groupBy("k").agg(F.max("step").alias("step"), _r(F.avg("value")).alias("loss"), F.count("*").alias("n")).join(medians, "k")


LOSS_TUMBLING = "SELECT event_id // 500 AS k, max(event_id + 1) AS step, round(avg(value), 6) AS loss, round(quantile_cont(value, 0.5), 6) AS median, count(*) AS n FROM events GROUP BY 1"


def loss_log_resume(spark: SparkSession, d: str) -> DataFrame:
    """The next step of each log: the last one and the last step's width."""
    e = v.table(spark, d, "events").select("user_id", F.col("event_id").alias("step"))
    w = Window.partitionBy("user_id").orderBy("step")
    e = e.withColumn("width", F.coalesce(F.col("step") - F.lag("step").over(w), F.lit(1)))
    return e.groupBy("user_id").agg(F.max("step").alias("last"), (F.max("step") + F.max_by("width", "step")).alias("next"))


LOSS_LOG_RESUME = "WITH e AS (SELECT user_id, event_id AS step, coalesce(event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1) AS width FROM events) SELECT user_id, max(step) AS last, max(step) + arg_max(width, step) AS next FROM e GROUP BY user_id"

_ALL = {
    "A11_probe_table": (probe_table, PROBE_TABLE), "A18_grid_pivot": (grid_pivot, GRID_PIVOT), "W15_grid_ranking": (grid_ranking, GRID_RANKING), "A17_duration_minmax": (duration_minmax, DURATION_MINMAX), "A19_lr_sweep": (lr_sweep, LR_SWEEP),
    "A13_summary_all": (summary_all, SUMMARY_ALL), "A05_species_bird_rollup": (species_bird_rollup, SPECIES_BIRD_ROLLUP), "A14_series_bird_then_species": (_means, SERIES), "A15_best_config": (best_config, BEST_CONFIG), "A16_minimax_regret": (minimax_regret, MINIMAX_REGRET),
    "U01_concat_union": (concat_union, CONCAT_UNION), "U02_insert_new_runs": (insert_new_runs, INSERT_NEW_RUNS), "A39_exact_dups": (exact_dups, EXACT_DUPS), "J04_allowed_stems_semi": (allowed_stems_semi, ALLOWED_STEMS_SEMI), "J06_missing_stems_anti": (missing_stems_anti, MISSING_STEMS_ANTI),
    "J01_annotated_files": (annotated_files, ANNOTATED_FILES), "J09_experiment_cross": (experiment_cross, EXPERIMENT_CROSS), "A20_manifest_summary": (manifest_summary, MANIFEST_SUMMARY), "T06_top_recordings": (top_recordings, TOP_RECORDINGS), "A29_coverage_pct": (coverage_pct, COVERAGE_PCT),
    "A28_code_counters": (code_counters, CODE_COUNTERS), "A34_dedup_detections": (dedup_detections, DEDUP_DETECTIONS), "A36_split_report": (split_report, SPLIT_REPORT), "A07_binary_f1_fer": (binary_f1_fer, BINARY_F1_FER), "A06_confusion_by_class": (confusion_by_class, CONFUSION_BY_CLASS),
    "A30_class_weights": (class_weights, CLASS_WEIGHTS), "A32_loss_tumbling": (loss_tumbling, LOSS_TUMBLING), "S19_loss_log_resume": (loss_log_resume, LOSS_LOG_RESUME),
}
QUERIES = {k: q for k, (q, _) in _ALL.items()}
ORACLES = {k: s for k, (_, s) in _ALL.items()}
