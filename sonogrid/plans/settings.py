"""Queries over settings, lookups, alignment and models on top of frozen vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonogrid.functions import names
from sonogrid.operators import intervals, metrics, models, neighbours, tables
from sonogrid.plans.timeline import DENSE, _spans
from sonogrid.sources import testviews as v


def pool_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of each bird's files, from their bins alone."""
    return v.specs(spark, d).groupBy("bird_id").agg(F.round(F.sum("n_timebins") * 64.0 / 32000, 6).alias("seconds"), F.count("*").alias("files"))


POOL_SECONDS = f"WITH {v.SPECS} SELECT bird_id, round(sum(n_timebins) * 64::DOUBLE / 32000, 6) AS seconds, count(*) AS files FROM v_specs GROUP BY 1"


def token_alignment(spark: SparkSession, d: str) -> DataFrame:
    """The bins (2 ms) that a file's tokens (7 ms) stand for: rounded, within the file, one at least; their number and sums by file."""
    s = v.specs(spark, d).where("n_timebins > 0").withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_timebins") * 2 - 1) / 7))))
    start = F.least(F.bround(F.col("t") * 7 / 2.0, 0).cast("bigint"), F.col("n_timebins") - 1)
    end = F.greatest(F.least(F.bround((F.col("t") + 1) * 7 / 2.0, 0).cast("bigint"), F.col("n_timebins")), start + 1)
    return s.groupBy("stem").agg(F.count("*").alias("tokens"), F.sum(start).alias("starts"), F.sum(end).alias("ends"), F.sum((end - start) * (F.col("t") % 5)).alias("spans"))


TOKEN_ALIGNMENT = f"""WITH {v.SPECS}, s AS (SELECT stem, n_timebins AS n, unnest(range(0, (n_timebins * 2 - 1) // 7 + 1)) AS t FROM v_specs WHERE n_timebins > 0), b AS (SELECT stem, n, t, least(round_even(t * 7 / 2::DOUBLE, 0)::BIGINT, n - 1) AS a FROM s),
c AS (SELECT stem, t, a, greatest(least(round_even((t + 1) * 7 / 2::DOUBLE, 0)::BIGINT, n), a + 1) AS e FROM b) SELECT stem, count(*) AS tokens, sum(a)::BIGINT AS starts, sum(e)::BIGINT AS ends, sum((e - a) * (t % 5))::BIGINT AS spans FROM c GROUP BY stem"""


def frame_targets(spark: SparkSession, d: str) -> DataFrame:
    """a unit's share of 250 frames of its recording, and the bins whose right edge lies within it."""
    u = v.units(spark, d)
    u = u.join(u.groupBy("stem").agg(F.max("offset_ms").alias("total")), "stem")
    return u.select("ordinal", F.floor(F.col("onset_ms") / F.col("total") * 250).alias("start"), F.ceil(F.col("offset_ms") / F.col("total") * 250).alias("end"), (F.floor(F.col("offset_ms") / 2) - F.floor(F.col("onset_ms") / 2)).alias("bins"))


FRAME_TARGETS = f"""WITH {v.UNITS}, m AS (SELECT stem, max(offset_ms) AS total FROM v_units GROUP BY 1)
SELECT ordinal, floor(onset_ms / total * 250)::BIGINT AS start, ceil(offset_ms / total * 250)::BIGINT AS "end", (floor(offset_ms / 2) - floor(onset_ms / 2))::BIGINT AS bins FROM v_units JOIN m USING (stem)"""


def micro_pooled(spark: SparkSession, d: str) -> DataFrame:
    """The best scores at three resolutions, pooled over all recordings, in long form."""
    truth = intervals.paint(_spans(spark, d), "stem", "s", "e", "label", "o").withColumn("r", F.explode(F.array(F.lit(5), F.lit(20), F.lit(80))))
    scored = metrics.at_resolution(truth, ["r", "stem"], F.col("r"))
    out = metrics.macro(metrics.confusion(scored, ["r"], "label", "majority", 6, "w"), ["r"])
    return out.select("r", F.round("macro_f1", 6).alias("macro_f1"), F.round("error_rate", 6).alias("error_rate")).unpivot("r", ["macro_f1", "error_rate"], "metric", "value")


MICRO_POOLED = f"""WITH {v.UNITS}, {DENSE}, q AS (SELECT stem, t, label, unnest([5, 20, 80]) AS r FROM seen), n AS (SELECT r, stem, t // r AS step, label, count(*) AS n FROM q GROUP BY ALL), m AS (SELECT r, stem, step, arg_min(label, row(-n, label)) AS pred FROM n GROUP BY ALL),
p AS (SELECT n.r, n.label, m.pred, sum(n.n) AS w FROM n JOIN m ON n.r = m.r AND n.stem = m.stem AND n.step = m.step GROUP BY ALL), x AS (SELECT r, c, coalesce(sum(w) FILTER (label = c AND pred = c), 0)::DOUBLE AS tp, coalesce(sum(w) FILTER (label <> c AND pred = c), 0)::DOUBLE AS fp, coalesce(sum(w) FILTER (label = c AND pred <> c), 0)::DOUBLE AS fn FROM p, range(6) k(c) GROUP BY r, c),
s AS (SELECT r, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 200 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1, round(100 * (1 - sum(tp) / sum(tp + fn)), 6) AS error_rate FROM x GROUP BY r) UNPIVOT s ON macro_f1, error_rate INTO NAME metric VALUE value"""


def bird_ids(spark: SparkSession, d: str) -> DataFrame:
    """Whose recording a path is: the first word of its name, unless that is a placeholder, else a letter and digits among the folders, else the name."""
    p = v.table(spark, d, "pages").select("page_id", F.concat(F.lit("/B"), (F.col("page_id") % 9).cast("string"), F.lit("/"), F.when(F.col("page_id") % 3 == 0, "recording_1").when(F.col("page_id") % 3 == 1, "llb3_day2").otherwise("x"), F.lit(".wav")).alias("path"))
    stem = names.stem(F.col("path"))
    word = F.when(stem.contains("_") & ~stem.startswith("recording_"), F.get(F.split(stem, "_"), F.lit(0)))
    folder = F.nullif(F.regexp_extract("path", "/(B[0-9]+)/", 1), F.lit(""))
    return p.select("page_id", F.coalesce(word, F.when(F.col("page_id") % 2 == 0, folder), stem).alias("bird"))


BIRD_IDS = "SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'llb3' WHEN page_id % 2 = 0 THEN 'B' || page_id % 9 WHEN page_id % 3 = 0 THEN 'recording_1' ELSE 'x' END AS bird FROM pages"


def number_lists(spark: SparkSession, d: str) -> DataFrame:
    """P25: positive numbers of a comma-separated list, each once, in order."""
    text = F.concat_ws(",", F.col("l_partkey").cast("string"), F.lit(" 7"), F.lit(""), F.col("l_linenumber").cast("string"), F.lit("7"))
    parsed = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x > 0)))
    return v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(parsed.cast("array<string>"), ",").alias("numbers"))


NUMBER_LISTS = "SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list_distinct(list_filter([l_partkey, 7, l_linenumber], lambda x: x > 0))), ',') AS numbers FROM lineitem"


def merged_settings(base: Column, over: Column) -> Column:
    """A map's entries under those of another."""
    return F.coalesce(F.map_zip_with(base, over, lambda k, a, b: F.coalesce(b, a)), base, over)


def overrides(spark: SparkSession, d: str) -> DataFrame:
    """Settings of a level over those above it, and whether the grid divides."""
    base = F.create_map(F.lit("mels"), F.lit(128), F.lit("bins"), F.lit(1024))
    over = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("bins"), (F.col("s_suppkey") % 5 * 100 + 4).cast("int"), F.lit("patch"), F.lit(32)))
    m = merged_settings(base, over)
    return v.table(spark, d, "supplier").select("s_suppkey", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",").alias("settings"), (F.try_element_at(m, F.lit("bins")) % 4 == 0).alias("divides"))


OVERRIDES = "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'bins=' || (s_suppkey % 5 * 100 + 4) || ',mels=128,patch=32' ELSE 'bins=1024,mels=128' END AS settings, true AS divides FROM supplier"


def mapped_labels(spark: SparkSession, d: str) -> DataFrame:
    """Events by the number of their label; labels that the map lacks are counted under null."""
    m = spark.createDataFrame([("click", 0), ("view", 1), ("other", 2)], "event_type string, number int")
    return v.table(spark, d, "events").join(F.broadcast(m), "event_type", "left").groupBy("number").agg(F.count("*").alias("n"))


MAPPED_LABELS = "SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 END AS number, count(*) AS n FROM events GROUP BY 1"


def listed_birds(spark: SparkSession, d: str) -> DataFrame:
    """Units of the listed birds with offsets that aren't before their onsets, against each bird's wanted seconds."""
    birds = spark.createDataFrame([("b1", "MAX"), ("b3", "2.5"), ("b99", "1")], "bird_id string, wanted string")
    u = v.units(spark, d).where("offset_ms >= onset_ms").join(F.broadcast(birds), "bird_id")
    _, wanted = names.train_seconds(F.col("wanted"))
    return u.groupBy("bird_id").agg(F.round(F.sum(F.col("offset_ms") - F.col("onset_ms")) / 1000, 6).alias("seconds"), F.max(wanted).alias("wanted"))


LISTED_BIRDS = f"WITH {v.UNITS} SELECT bird_id, round(sum(offset_ms - onset_ms) / 1000, 6) AS seconds, max(CASE bird_id WHEN 'b3' THEN 2.5::DOUBLE END) AS wanted FROM v_units WHERE bird_id IN ('b1', 'b3') AND offset_ms >= onset_ms GROUP BY bird_id"


def chunks_of_stems(spark: SparkSession, d: str) -> DataFrame:
    """Files of each recording: those of its name and its chunks."""
    files = v.specs(spark, d).withColumn("file", F.when(F.col("doc_id") % 3 == 0, F.concat("stem", F.lit(".npy"))).otherwise(F.concat("stem", F.lit("__ms_0_10.npy"))))
    base, start, _ = names.parse_chunk(F.col("file"))
    wanted = v.table(spark, d, "labels").select(F.concat(F.lit("d"), "doc_id").alias("base"))
    return files.withColumns({"base": base, "chunked": start.isNotNull()}).join(wanted, "base").groupBy("chunked").agg(F.count("*").alias("n"))


CHUNKS_OF_STEMS = "SELECT doc_id % 3 <> 0 AS chunked, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1"


def expected_found(spark: SparkSession, d: str) -> DataFrame:
    """Which brands both, or only one, of two parts of the table have."""
    p = v.table(spark, d, "part").select("p_brand", "p_size")
    a, b = p.where("p_size < 10").select("p_brand").distinct(), p.where("p_size > 48").select("p_brand").distinct()
    parts = {"both": a.intersect(b), "first": a.subtract(b), "second": b.subtract(a)}
    out = [df.withColumn("side", F.lit(k)) for k, df in parts.items()]
    return out[0].union(out[1]).union(out[2])


EXPECTED_FOUND = """WITH a AS (SELECT DISTINCT p_brand FROM part WHERE p_size < 10), b AS (SELECT DISTINCT p_brand FROM part WHERE p_size > 48) SELECT p_brand, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT p_brand, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT p_brand, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""


def bernoulli_mask(spark: SparkSession, d: str) -> DataFrame:
    """a third of a recording's bins, by a hash: how many, and the sum of their places."""
    # Recordings are dealt out before they become bins, so that tasks have equal shares however few files hold them.
    s = tables.dealt(v.specs(spark, d).where("n_timebins > 0").select("stem", "n_timebins"), "stem")
    s = s.select("stem", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_timebins") - 1)).alias("t"))
    # A column of its own: as a condition of both sums it would be hashed twice.
    s = s.withColumn("masked", names.drawn(1 / 3, 37, F.col("stem"), F.col("t")))
    return s.groupBy("stem").agg(F.count_if("masked").alias("masked"), F.sum(F.when(F.col("masked"), F.col("t")).otherwise(0)).alias("places"))


BERNOULLI_MASK = f"""WITH {v.SPECS}, s AS (SELECT stem, unnest(range(0, n_timebins)) AS t FROM v_specs), p AS (SELECT stem, t, ('0x' || substr(md5('37|' || stem || '|' || t), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 1 / 3::DOUBLE AS m FROM s)
SELECT stem, count(*) FILTER (m) AS masked, coalesce(sum(t) FILTER (m), 0)::BIGINT AS places FROM p GROUP BY stem"""


def linear_probe(spark: SparkSession, d: str) -> DataFrame:
    """Labels of frozen vectors by logistic regression: how many of the held-out ones are right."""
    p = v.patches(spark, d).withColumn("held", F.col("patch_ix") % 5 == 0)
    out = models.linear_probe(p.where("NOT held"), p.where("held"), "h", "label")
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("right"))


def principal_axes(spark: SparkSession, d: str) -> DataFrame:
    """Two coordinates of each vector."""
    return models.coordinates(v.patches(spark, d), "h", 2).select("patch_ix", F.round("axis0", 6).alias("axis0"), F.round("axis1", 6).alias("axis1"))


def neighbour_graph(spark: SparkSession, d: str) -> DataFrame:
    """The 15 most alike others of each vector: of all pairs, or by as many trees of hashed projections as a recall of 0.9 takes where that is less work."""
    return neighbours.grown_graph(v.patches(spark, d), "patch_ix", "h", pairs=neighbours.TREE_PAIRS)[0].withColumn("similarity", F.round("similarity", 6))


def spectral_axes(spark: SparkSession, d: str) -> DataFrame:
    """Two coordinates of each vector from the graph of its nearest neighbours, as ten rounds find them."""
    graph = neighbours.grown_graph(v.patches(spark, d), "patch_ix", "h", pairs=neighbours.TREE_PAIRS)[0]
    return neighbours.spectral_coordinates(graph, "patch_ix", rounds=10).select("patch_ix", F.round("axis0", 3).alias("axis0"), F.round("axis1", 3).alias("axis1"))


def species_names(spark: SparkSession, d: str) -> DataFrame:
    """The species that a text names, and how it is shown; null if it names none."""
    k = F.col("c_custkey") % 6
    text = F.when(k == 0, "zebra finch").when(k == 1, " Canary").when(k == 2, "BENGALESE_FINCH").when(k == 3, "Zebra_Finch").when(k == 4, F.col("c_name"))
    return v.table(spark, d, "customer").select("c_custkey", names.canonical_species(text).alias("species"), names.shown_species(text).alias("shown"))


SPECIES_NAMES = """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Zebra_Finch' WHEN 1 THEN 'Canary' WHEN 2 THEN 'Bengalese_Finch' WHEN 3 THEN 'Zebra_Finch' END AS species,
CASE c_custkey % 6 WHEN 0 THEN 'Zebra Finch' WHEN 1 THEN 'Canary' WHEN 2 THEN 'Bengalese Finch' WHEN 3 THEN 'Zebra Finch' END AS shown FROM customer"""


def train_folders(spark: SparkSession, d: str) -> DataFrame:
    """Bird and training seconds of a folder, from its path or as noted beside it."""
    key, size = F.col("o_orderkey").cast("string"), F.concat(F.lit("train_"), (F.col("o_orderkey") % 50).cast("string"), F.lit("p5s"))
    k = F.col("o_orderkey") % 5
    path = F.when(k == 0, F.concat(F.lit("/d/detect/classify/b"), key, F.lit("/"), size)).when(k == 1, F.concat(F.lit("d/unit_detect/b"), key)).when(k == 2, F.concat(F.lit("/d/detect/x/"), size)).when(k == 3, F.concat(F.lit("/d/canary/b"), key, F.lit("/train/"))).otherwise("")
    bird, seconds = names.train_folder(path, F.when(k != 1, F.concat(key, F.lit(" "))))
    return v.table(spark, d, "orders").select("o_orderkey", bird.alias("bird"), seconds.alias("seconds"))


TRAIN_FOLDERS = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1, 3) THEN 'b' || o_orderkey WHEN o_orderkey % 5 = 2 THEN 'all' ELSE '' END AS bird,
CASE WHEN o_orderkey % 5 IN (0, 2) THEN (o_orderkey % 50) || '.5' WHEN o_orderkey % 5 = 1 THEN '' ELSE o_orderkey::VARCHAR END AS seconds FROM orders"""


def number_texts(spark: SparkSession, d: str) -> DataFrame:
    """numbers of many sizes as short texts."""
    x = F.col("l_orderkey") / F.lit(7.0) * F.pow(F.lit(10.0), F.col("l_linenumber") * 3 - 12)
    return v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", names.general(F.col("l_discount")).alias("discount"), names.general(x).alias("value"))


NUMBER_TEXTS = """SELECT l_orderkey, l_linenumber, printf('%g', l_discount::DOUBLE) AS discount, printf('%g', l_orderkey / 7.0::DOUBLE * pow(10.0::DOUBLE, l_linenumber * 3 - 12)) AS value FROM lineitem"""


def capped_files(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 recordings, by path, of each of the first three birds."""
    return tables.capped(v.specs(spark, d), "bird_id", ["stem"], 20, 3).select("bird_id", "stem")


CAPPED_FILES = f"WITH {v.SPECS} SELECT bird_id, stem FROM v_specs WHERE bird_id IN (SELECT DISTINCT bird_id FROM v_specs ORDER BY bird_id LIMIT 3) QUALIFY row_number() OVER (PARTITION BY bird_id ORDER BY stem) <= 20"


_ALL = {
    "A02_pool_seconds": (pool_seconds, POOL_SECONDS), "J11_token_alignment": (token_alignment, TOKEN_ALIGNMENT), "F13_frame_targets": (frame_targets, FRAME_TARGETS), "A10_micro_pooled": (micro_pooled, MICRO_POOLED), "P17_bird_ids": (bird_ids, BIRD_IDS),
    "P25_number_lists": (number_lists, NUMBER_LISTS), "P34_overrides": (overrides, OVERRIDES), "J07_mapped_labels": (mapped_labels, MAPPED_LABELS), "J08_listed_birds": (listed_birds, LISTED_BIRDS), "J02_chunks_of_stems": (chunks_of_stems, CHUNKS_OF_STEMS),
    "U05_expected_found": (expected_found, EXPECTED_FOUND), "F31_bernoulli_mask": (bernoulli_mask, BERNOULLI_MASK), "P11_species_names": (species_names, SPECIES_NAMES), "P16_train_folders": (train_folders, TRAIN_FOLDERS), "F26_number_texts": (number_texts, NUMBER_TEXTS),
    "T13_capped_files": (capped_files, CAPPED_FILES),
}
#: Fitted models have no equivalent in SQL.
QUERIES = {k: q for k, (q, _) in _ALL.items()} | {"M04_linear_probe": linear_probe, "M06_principal_axes": principal_axes, "M06_neighbour_graph": neighbour_graph, "M06_spectral_axes": spectral_axes}
ORACLES = {k: s for k, (_, s) in _ALL.items()}
