"""Queries over windows, frames and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonogrid.functions import arrays, names
from sonogrid.operators import metrics, windows
from sonogrid.sources import testviews as v

LONG = "bigint"


def tile_windows(spark: SparkSession, d: str) -> DataFrame:
    """Files in windows of 1024 bins."""
    return windows.tiles(v.specs(spark, d), "n_timebins", 1024).select("stem", "start", "length")


TILE_WINDOWS = f"""WITH {v.SPECS}, s AS (SELECT stem, n_timebins AS n, unnest(range(0, greatest(n_timebins, 1), 1024)) AS start FROM v_specs) SELECT stem, start, greatest(0, least(1024, n - start)) AS length FROM s"""


def _chunk(pad: bool):
    def query(spark: SparkSession, d: str) -> DataFrame:
        """Chunks of 400 bins at a stride of 150, named by their milliseconds."""
        c = windows.chunks(v.specs(spark, d), "n_timebins", 400, 150, pad)
        return c.select("stem", "start", "end", names.build_chunk(F.col("stem"), F.col("start") * 2, F.col("end") * 2).alias("name"))

    last = "n_timebins - 1" if pad else "n_timebins - 400"
    sql = f"""WITH {v.SPECS}, s AS (SELECT stem, n_timebins AS n, unnest(range(0, {last} + 1, 150)) AS start FROM v_specs WHERE {last} >= 0)
SELECT stem, start, least(start + 400, n) AS "end", stem || '__ms_' || start * 2 || '_' || least(start + 400, n) * 2 AS name FROM s"""
    return query, sql


def _pool(how: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        """Patches of a bird pooled over windows of 8 at a hop of 4."""
        p = windows.pooled(v.patches(spark, d), "bird", "patch_ix", "h", 8, 4, how)
        return p.select("bird", "window", "dim", F.round("value", 6).alias("value"))

    f = {"mean": "avg", "max": "max", "sum": "sum"}[how]
    sql = f"""WITH {v.PATCHES}, n AS (SELECT bird, h, row_number() OVER (PARTITION BY bird ORDER BY patch_ix) - 1 AS i, count(*) OVER (PARTITION BY bird) AS n FROM v_patches),
w AS (SELECT DISTINCT bird, unnest(range(0, n - 7, 4)) // 4 AS "window" FROM n), x AS (SELECT n.bird, "window", unnest(h) AS x, unnest(range(0, 64)) AS dim FROM n JOIN w ON n.bird = w.bird AND i BETWEEN "window" * 4 AND "window" * 4 + 7)
SELECT bird, "window", dim::INT AS dim, round({f}(x), 6) AS value FROM x GROUP BY bird, "window", dim"""
    return query, sql


def majority_label(spark: SparkSession, d: str) -> DataFrame:
    """The label that most patches of a window of 8 have."""
    p = v.patches(spark, d).withColumn("w", F.floor(F.col("patch_ix") / 8))
    return metrics.majority(p, ["w"], "label")


MAJORITY_LABEL = f"WITH {v.PATCHES}, n AS (SELECT patch_ix // 8 AS w, label, count(*) AS n FROM v_patches GROUP BY ALL) SELECT w, arg_min(label, row(-n, label)) AS majority FROM n GROUP BY w"


def maxpool_labels(spark: SparkSession, d: str) -> DataFrame:
    """The largest label of every four patches, and the place of the four in a context of 16."""
    return v.patches(spark, d).groupBy(F.floor(F.col("patch_ix") / 4).alias("p")).agg(F.max("label").alias("label")).withColumn("place", F.pmod("p", F.lit(16)))


MAXPOOL_LABELS = f"WITH {v.PATCHES} SELECT patch_ix // 4 AS p, max(label) AS label, (patch_ix // 4) % 16 AS place FROM v_patches GROUP BY 1, 3"


def vote_smoothing(spark: SparkSession, d: str) -> DataFrame:
    """Song or silence, smoothed by a vote of 6."""
    p = v.patches(spark, d).withColumn("song", (F.col("label") > 1).cast("int"))
    return p.select("patch_ix", "song", windows.vote(p, "bird", "patch_ix", "song", 6).alias("smooth"))


VOTE_SMOOTHING = f"""WITH {v.PATCHES} SELECT patch_ix, (label > 1)::INT AS song, (sum((label > 1)::INT) OVER (PARTITION BY bird ORDER BY patch_ix ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) > 3)::INT AS smooth FROM v_patches"""


def transition_peak(spark: SparkSession, d: str) -> DataFrame:
    """Where a window of 12 patches sees most changes of label; the first of equal ones."""
    w = Window.partitionBy("bird").orderBy("patch_ix")
    p = v.patches(spark, d).withColumn("change", (F.lag("label").over(w) != F.col("label")).cast("int"))
    p = p.withColumn("n", F.coalesce(F.sum("change").over(w.rowsBetween(1, 11)), F.lit(0).cast(LONG)))
    return p.groupBy("bird").agg(F.max_by("patch_ix", F.struct("n", -F.col("patch_ix"))).alias("start"), F.max("n").alias("changes"))


TRANSITION_PEAK = f"""WITH {v.PATCHES}, c AS (SELECT *, (lag(label) OVER w <> label)::INT AS change FROM v_patches WINDOW w AS (PARTITION BY bird ORDER BY patch_ix)),
n AS (SELECT *, coalesce(sum(change) OVER (PARTITION BY bird ORDER BY patch_ix ROWS BETWEEN 1 FOLLOWING AND 11 FOLLOWING), 0)::BIGINT AS n FROM c) SELECT bird, arg_min(patch_ix, row(-n, patch_ix)) AS start, max(n) AS changes FROM n GROUP BY bird"""


def _long(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("h").alias("dim", "x"))


def position_center(spark: SparkSession, d: str) -> DataFrame:
    """Vectors less the mean of their place in the context."""
    p = _long(v.patches(spark, d), "patch_ix", "pos_id")
    mean = p.groupBy("pos_id", "dim").agg(F.avg("x").alias("m"))
    return p.join(F.broadcast(mean), ["pos_id", "dim"]).select("patch_ix", "dim", F.round(F.col("x") - F.col("m"), 6).alias("z"))


POSITION_CENTER = f"WITH {v.PATCHES}, l AS (SELECT patch_ix, pos_id, unnest(h) AS x, unnest(range(0, 64)) AS dim FROM v_patches) SELECT patch_ix, dim::INT AS dim, round(x - avg(x) OVER (PARTITION BY pos_id, dim), 6) AS z FROM l"


def grid_center(spark: SparkSession, d: str) -> DataFrame:
    """Mean vectors of the places (y, x) of a grid four wide."""
    p = _long(v.patches(spark, d), "pos_id").groupBy(F.floor(F.col("pos_id") / 4).alias("y"), (F.col("pos_id") % 4).alias("x0"), "dim")
    return p.agg(F.round(F.avg("x"), 6).alias("m"), F.count("*").alias("n"))


GRID_CENTER = f"WITH {v.PATCHES}, l AS (SELECT pos_id, unnest(h) AS x, unnest(range(0, 64)) AS dim FROM v_patches) SELECT pos_id // 4 AS y, pos_id % 4 AS x0, dim::INT AS dim, round(avg(x), 6) AS m, count(*) AS n FROM l GROUP BY ALL"


def cosine_to_query(spark: SparkSession, d: str) -> DataFrame:
    """likeness to the first patch of the bird."""
    p = v.patches(spark, d)
    q = p.groupBy("bird").agg(F.min_by("h", "patch_ix").alias("q"))
    return p.join(q, "bird").select("patch_ix", F.round(arrays.cosine(F.col("h"), F.col("q")), 6).alias("cosine"))


COSINE_TO_QUERY = f"WITH {v.PATCHES}, q AS (SELECT bird, arg_min(h, patch_ix) AS q FROM v_patches GROUP BY bird) SELECT patch_ix, round(list_cosine_similarity(h, q), 6) AS cosine FROM v_patches JOIN q USING (bird)"


def patch_norm(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by their own mean and sample deviation."""
    return v.patches(spark, d).select("patch_ix", F.posexplode(F.transform(arrays.patch_norm(F.col("h")), lambda x: F.round(x, 6))).alias("dim", "z"))


PATCH_NORM = f"""WITH {v.PATCHES}, l AS (SELECT patch_ix, unnest(h) AS x, unnest(range(0, 64)) AS dim FROM v_patches), s AS (SELECT patch_ix, avg(x) AS m, var_samp(x) AS v FROM l GROUP BY 1)
SELECT patch_ix, dim::INT AS dim, round((x - m) / sqrt(v + 1e-6), 6) AS z FROM l JOIN s USING (patch_ix)"""


def dataset_mean_std(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation over all cells of a tenth of the files (all, if that is none), from sums by file."""
    p = v.patches(spark, d).withColumn("picked", F.pmod(names.hash_int(F.col("patch_ix").cast("string")), F.lit(10)) == 0)
    per = p.select("picked", F.size("h").cast(LONG).alias("n"), arrays.total(F.col("h")).alias("s"), arrays.dot(F.col("h"), F.col("h")).alias("q"))
    both = per.agg(*(F.sum(F.when(F.col("picked"), F.col(c))).alias(f"{c}1") for c in "nsq"), *(F.sum(c).alias(f"{c}0") for c in "nsq"))
    n, s, q = (F.coalesce(f"{c}1", f"{c}0") for c in "nsq")
    return both.select(n.alias("n"), F.round(s / n, 6).alias("mean"), F.round(F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))), 6).alias("std"))


DATASET_MEAN_STD = f"""WITH {v.PATCHES}, p AS (SELECT *, ('0x' || substr(sha1(patch_ix::VARCHAR), 1, 8))::BIGINT % 10 = 0 AS picked FROM v_patches), l AS (SELECT unnest(h) AS x, picked FROM p), u AS (SELECT x FROM l WHERE picked OR NOT (SELECT bool_or(picked) FROM l))
SELECT count(*) AS n, round(avg(x), 6) AS mean, round(sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)), 6) AS std FROM u"""


def zscore_frames(spark: SparkSession, d: str) -> DataFrame:
    """all frames by the mean and deviation of all cells, which a join of one row brings in."""
    p = v.patches(spark, d)
    s = p.agg(F.sum(F.size("h").cast(LONG)).alias("n"), F.sum(arrays.total(F.col("h"))).alias("s"), F.sum(arrays.dot(F.col("h"), F.col("h"))).alias("q"))
    s = s.select((F.col("s") / F.col("n")).alias("m"), F.sqrt(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2).alias("std"))
    return p.withColumn("one", F.lit(1)).join(F.broadcast(s.withColumn("one", F.lit(1))), "one").select("patch_ix", F.posexplode(F.transform(arrays.zscore(F.col("h"), F.col("m"), F.col("std")), lambda x: F.round(x, 5))).alias("dim", "z"))


ZSCORE_FRAMES = f"WITH {v.PATCHES}, l AS (SELECT patch_ix, unnest(h) AS x, unnest(range(0, 64)) AS dim FROM v_patches), s AS (SELECT avg(x) AS m, stddev_pop(x) AS std FROM l) SELECT patch_ix, dim::INT AS dim, round((x - m) / std, 5) AS z FROM l, s"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Of vectors read as logits the likeliest class and its share, a sigmoid, the vector padded with its least value, and its values repeated three times and cut."""
    p = v.patches(spark, d)
    total = lambda x: F.round(F.aggregate(x, F.lit(0.0), lambda a, y: a + y), 6)
    padded, repeated = arrays.pad_right(F.col("h"), 70, F.array_min("h")), arrays.repeated(F.col("h"), 3, 190)
    return p.select(
        "patch_ix", arrays.argmax(F.col("h")).alias("pred"), F.round(F.array_max(arrays.softmax(F.col("h"))), 6).alias("p"), F.round(1 / (1 + F.exp(-F.get("h", F.lit(0)))), 6).alias("sigmoid"),
        F.size(padded).alias("padded"), F.round(F.get(padded, F.lit(69)), 6).alias("pad"), total(padded).alias("padded_sum"), F.size(repeated).alias("repeated"), F.round(F.get(repeated, F.lit(100)), 6).alias("repeated_100"), total(repeated).alias("repeated_sum"),
    )


PREDICTIONS = f"""WITH {v.PATCHES}, e AS (SELECT patch_ix, any_value(h) OVER (PARTITION BY patch_ix) AS h, x, c FROM (SELECT patch_ix, h, unnest(h) AS x, unnest(range(0, 64)) AS c FROM v_patches)),
s AS (SELECT patch_ix, any_value(h) AS h, arg_min(c, row(-x, c)) AS pred, round(exp(max(x)) / sum(exp(x)), 6) AS p FROM e GROUP BY patch_ix)
SELECT patch_ix, pred, p, round(1 / (1 + exp(-h[1])), 6) AS sigmoid, 70 AS padded, round(list_min(h), 6) AS pad, round(list_sum(h) + 6 * list_min(h), 6) AS padded_sum, 190 AS repeated, round(h[34], 6) AS repeated_100,
       round(list_sum(list_transform(range(0, 190), lambda i: h[i // 3 + 1])), 6) AS repeated_sum FROM s"""


def resampled(spark: SparkSession, d: str) -> DataFrame:
    """Vectors read at 10 places, ends on ends: the nearest value and the one on the line."""
    p = v.patches(spark, d).select("patch_ix", "h", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i"))
    at = F.col("i") * 63 / 9.0
    return p.select("patch_ix", "i", F.round(F.get("h", arrays.nearest_index(F.col("i"), F.lit(64), F.lit(10)).cast("int")), 6).alias("nearest"), F.round(arrays.interpolated(F.col("h"), at), 6).alias("line"))


RESAMPLED = f"""WITH {v.PATCHES}, p AS (SELECT patch_ix, h, unnest(range(0, 10))::INT AS i FROM v_patches)
SELECT patch_ix, i, round(h[round_even(i * 63 / 9::DOUBLE, 0)::INT + 1], 6) AS nearest, round(h[floor(i * 63 / 9::DOUBLE)::INT + 1] + (h[least(floor(i * 63 / 9::DOUBLE)::INT + 1, 63) + 1] - h[floor(i * 63 / 9::DOUBLE)::INT + 1]) * (i * 63 / 9::DOUBLE - floor(i * 63 / 9::DOUBLE)), 6) AS line FROM p"""


def patchify(spark: SparkSession, d: str) -> DataFrame:
    """frames of 64 bins in patches of 16 bins by 4 frames, and their tokens in row order."""
    cell = _long(v.patches(spark, d), "patch_ix")
    token = F.floor(F.col("dim") / 16) * 8 + F.floor(F.pmod("patch_ix", F.lit(32)) / 4)
    return cell.groupBy(F.floor(F.col("patch_ix") / 32).alias("image"), token.alias("token")).agg(F.round(F.sum("x"), 6).alias("total"), F.count("*").alias("n"))


PATCHIFY = f"WITH {v.PATCHES}, l AS (SELECT patch_ix, unnest(h) AS x, unnest(range(0, 64)) AS dim FROM v_patches) SELECT patch_ix // 32 AS image, (dim // 16) * 8 + (patch_ix % 32) // 4 AS token, round(sum(x), 6) AS total, count(*) AS n FROM l GROUP BY ALL"


def voronoi_mask_cells(spark: SparkSession, d: str) -> DataFrame:
    """a mask of three quarters of an 8 by 16 grid for each image of 32 patches: cells by their distance to the nearest of some seeds, ties by a hash.

    Seeds are few and their number is fixed by the grid, so each cell has them as an array.
    """
    images = v.patches(spark, d).select(F.floor(F.col("patch_ix") / 32).alias("image")).distinct()
    cells = images.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(127)))).withColumn("y", F.floor(F.col("c") / 16)).withColumn("x", F.col("c") % 16)
    rank = F.row_number().over(Window.partitionBy("image").orderBy(names.shuffled(1, F.col("image"), F.col("c"))))
    seeds = cells.withColumn("k", rank).where("k <= 6").groupBy("image").agg(F.collect_list(F.struct("y", "x")).alias("seeds"))
    near = F.array_min(F.transform("seeds", lambda s: (s["y"] - F.col("y")) * (s["y"] - F.col("y")) * 4 + (s["x"] - F.col("x")) * (s["x"] - F.col("x"))))
    order = Window.partitionBy("image").orderBy("near", names.shuffled(2, F.col("image"), F.col("c")))
    return cells.join(seeds, "image").withColumn("near", near).withColumn("k", F.row_number().over(order)).select("image", F.col("c").cast(LONG).alias("c"), "near", (F.col("k") <= 96).alias("masked"))


VORONOI = """WITH c AS (SELECT image, c.range AS c, c.range // 16 AS y, c.range % 16 AS x FROM (SELECT DISTINCT vec_id // 32 AS image FROM embeddings) i, range(0, 128) c), s AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY md5('1|' || image || '|' || c)) AS k FROM c),
n AS (SELECT c.image, c.c, min((s.y - c.y) * (s.y - c.y) * 4 + (s.x - c.x) * (s.x - c.x)) AS near FROM c JOIN s ON c.image = s.image AND s.k <= 6 GROUP BY c.image, c.c)
SELECT image, c, near, row_number() OVER (PARTITION BY image ORDER BY near, md5('2|' || image || '|' || c)) <= 96 AS masked FROM n"""


def learning_rates(spark: SparkSession, d: str) -> DataFrame:
    """F32: the rate of each logged step, which warms up and falls by a cosine."""
    step = F.col("event_id")
    return v.table(spark, d, "events").select(step.alias("step"), F.round(arrays.warmup_cosine(step, 2e-4, 200, 2000, 1e-6) * 1e6, 6).alias("lr"))


LEARNING_RATES = "SELECT event_id AS step, round(CASE WHEN event_id < 200 THEN 2e-4 * event_id / 200 ELSE 1e-6 + (2e-4 - 1e-6) * 0.5 * (1 + cos(3.141592653589793 * least((event_id - 200) / 1800.0::DOUBLE, 1))) END * 1e6, 6) AS lr FROM events"


def colours(spark: SparkSession, d: str) -> DataFrame:
    """two coordinates as shares of their ranges."""
    p = v.patches(spark, d).select("patch_ix", "bird", F.get("h", F.lit(0)).alias("a"), F.get("h", F.lit(1)).alias("b"))
    w = Window.partitionBy("bird")
    share = lambda c: F.round((F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + 1e-8), 6)
    return p.select("patch_ix", share("a").alias("red"), share("b").alias("green"))


COLOURS = f"WITH {v.PATCHES}, p AS (SELECT patch_ix, bird, h[1] AS a, h[2] AS b FROM v_patches) SELECT patch_ix, round((a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w + 1e-8), 6) AS red, round((b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w + 1e-8), 6) AS green FROM p WINDOW w AS (PARTITION BY bird)"


def reconstruction_error(spark: SparkSession, d: str) -> DataFrame:
    """Mean squared error against the vector before, over all and over masked cells (NaN without any), by bird and over all."""
    p = v.patches(spark, d).withColumn("before", F.lag("h").over(Window.partitionBy("bird").orderBy("patch_ix"))).where("before IS NOT NULL")
    sq = F.transform(F.zip_with("h", "before", lambda a, b: a - b), lambda x: x * x)
    p = p.select("bird", F.size("h").alias("n"), arrays.total(sq).alias("sse"), F.when(F.col("label") > 1, F.size("h")).alias("mn"), F.when(F.col("label") > 1, arrays.total(sq)).alias("msse"))
    masked = F.when(F.sum("mn") > 0, F.round(F.sum("msse") / F.sum("mn"), 6)).otherwise(F.lit(float("nan")))
    return p.rollup("bird").agg(F.round(F.sum("sse") / F.sum("n"), 6).alias("mse_all"), masked.alias("mse_masked"))


RECONSTRUCTION_ERROR = f"""WITH {v.PATCHES}, b AS (SELECT bird, label, h, lag(h) OVER (PARTITION BY bird ORDER BY patch_ix) AS g FROM v_patches), l AS (SELECT bird, label, unnest(h) AS x, unnest(g) AS y FROM b WHERE g IS NOT NULL)
SELECT bird, round(avg((x - y) * (x - y)), 6) AS mse_all, coalesce(round(avg((x - y) * (x - y)) FILTER (label > 1), 6), 'nan'::DOUBLE) AS mse_masked FROM l GROUP BY ROLLUP (bird)"""

_C0, _C1, _POOL = _chunk(False), _chunk(True), {h: _pool(h) for h in ("mean", "max", "sum")}
QUERIES = {
    "W01_tile_windows": tile_windows, "W02_chunk_stride_drop": _C0[0], "W02_chunk_stride_pad": _C1[0], **{f"W03_sliding_pool_{h}": q for h, (q, _) in _POOL.items()}, "A24_majority_label": majority_label, "A25_maxpool_labels": maxpool_labels,
    "W10_vote_smoothing": vote_smoothing, "W14_transition_peak": transition_peak, "A21_position_center": position_center, "A22_grid_center": grid_center, "F21_cosine_to_query": cosine_to_query, "A40_patch_norm": patch_norm,
    "A01_dataset_mean_std": dataset_mean_std, "F14_zscore_frames": zscore_frames, "F16_predictions": predictions, "J18_resampled": resampled, "F19_patchify": patchify, "F30_voronoi_mask_cells": voronoi_mask_cells,
    "F32_learning_rates": learning_rates, "F34_colours": colours, "A26_reconstruction_error": reconstruction_error,
}
ORACLES = {
    "W01_tile_windows": TILE_WINDOWS, "W02_chunk_stride_drop": _C0[1], "W02_chunk_stride_pad": _C1[1], **{f"W03_sliding_pool_{h}": s for h, (_, s) in _POOL.items()}, "A24_majority_label": MAJORITY_LABEL, "A25_maxpool_labels": MAXPOOL_LABELS,
    "W10_vote_smoothing": VOTE_SMOOTHING, "W14_transition_peak": TRANSITION_PEAK, "A21_position_center": POSITION_CENTER, "A22_grid_center": GRID_CENTER, "F21_cosine_to_query": COSINE_TO_QUERY, "A40_patch_norm": PATCH_NORM,
    "A01_dataset_mean_std": DATASET_MEAN_STD, "F14_zscore_frames": ZSCORE_FRAMES, "F16_predictions": PREDICTIONS, "J18_resampled": RESAMPLED, "F19_patchify": PATCHIFY, "F30_voronoi_mask_cells": VORONOI,
    "F32_learning_rates": LEARNING_RATES, "F34_colours": COLOURS, "A26_reconstruction_error": RECONSTRUCTION_ERROR,
}
