"""Writing tables so that a second run changes nothing."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sonogrid import schemas
from sonogrid.operators.tables import insert_only


def existing(df: DataFrame, path: str) -> DataFrame | None:
    """The table at a path, or None if there is none."""
    try:
        return df.sparkSession.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Appends the rows whose key the table lacks."""
    old = existing(df, path)
    (df if old is None else df.join(old.select(*key), key, "left_anti")).write.mode("append").parquet(path)


def upsert(df: DataFrame, path: str, key: list[str], to: str) -> None:
    """The table with its rows of the same key replaced, written to another path, so that a failure leaves the old one whole."""
    old = existing(df, path)
    out = df if old is None else old.join(df.select(*key), key, "left_anti").unionByName(df, allowMissingColumns=True)
    out.write.mode("overwrite").parquet(to)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder for each split; splits that df has are overwritten, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(split).parquet(path)


def unique_names(df: DataFrame, name: str, how: str = "number") -> DataFrame:
    """Df with target: names that occur again get _1, _2 ('number'), or __dup1, __dup2 ('dup'), only the first stays ('skip'), or they are an error ('fail')."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(*[c for c in df.columns])) - 1
    out = df.withColumn("_k", k)
    if how == "skip":
        return out.where("_k = 0").withColumn("target", F.col(name)).drop("_k")
    if how == "fail":
        return out.where(F.assert_true(F.col("_k") == 0, F.concat(F.lit("two files named "), name)).isNull()).withColumn("target", F.col(name)).drop("_k")
    mark = {"number": "_", "dup": "__dup"}[how]
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return out.withColumn("target", F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat(stem, F.lit(mark), F.col("_k").cast("string"), ext))).drop("_k")


def write_metrics(df: DataFrame, old: DataFrame | None, path: str, key: str = "run_name") -> None:
    """One CSV file of metrics; runs that are there stay as they are, new columns are added."""
    (df if old is None else insert_only(old, df, key)).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_manifest(index: DataFrame, wanted: DataFrame, path: str) -> None:
    """Stem and path of the wanted stems; missing or ambiguous ones are an error."""
    lost = wanted.join(index, "stem", "left_anti").limit(5).collect()
    twice = index.join(wanted, "stem", "left_semi").where("n > 1").limit(5).collect()
    if lost or twice:
        raise ValueError(f"missing: {[r['stem'] for r in lost]}; ambiguous: {[r['stem'] for r in twice]}")
    index.join(wanted, "stem", "left_semi").select("stem", "path").coalesce(1).sortWithinPartitions("stem").write.mode("overwrite").json(path)


def write_results(df: DataFrame, good: str, failed: str, error: str = "error") -> None:
    """Rows without an error to one table, and the errors to a log."""
    df.where(F.col(error).isNull()).drop(error).write.mode("append").parquet(good)
    df.where(F.col(error).isNotNull()).select("stem", error).write.mode("append").csv(failed, sep="\t")


def write_params(params: DataFrame, stats: DataFrame, path: str, key: str = "dataset") -> None:
    """Each dataset's parameters with its statistics over what stood there, one JSON folder a dataset, keys in order; datasets that params lacks get statistics alone."""
    both = params.alias("p").join(stats.alias("s"), key, "full")
    names = sorted({*params.columns, *stats.columns} - {key})
    merged = [F.coalesce(*(F.col(f"{side}.{n}") for side, df in (("s", stats), ("p", params)) if n in df.columns)).alias(n) for n in names]
    text = both.select(key, F.to_json(F.struct(*merged)).alias("value"))
    text.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).text(path)


def write_filtered(docs: DataFrame, path: str) -> None:
    """Documents as JSON, as read_annotations() takes them."""
    docs.write.mode("overwrite").json(path)


def write_bundle(rows: DataFrame, settings: DataFrame, path: str) -> None:
    """Arrays as rows of Parquet and the settings they were made with as JSON beside them."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    settings.write.mode("overwrite").json(f"{path}/settings")


def append_losses(df: DataFrame, path: str) -> None:
    """A line for each step in the order of read_losses(), null fields blank."""
    form = {"train_loss": "%.6f", "val_loss": "%.6f", "gnorm": "%.6f", "steps_per_sec": "%.2f", "samples_per_sec": "%.1f"}
    names = [c.split()[0] for c in schemas.LOSSES.split(", ")]
    cells = [F.when(F.col(c).isNotNull(), F.format_string(form[c], c)) if c in form else F.col(c).cast("string") for c in names]
    df.select(F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in cells)).alias("value")).write.mode("append").text(path)


def archive(spark: SparkSession, path: str) -> str | None:
    """Moves what stands at a path to archive/<name>_<UTC time> beside it, and says where; None if nothing stands there."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    old = hadoop.Path(path)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(old):
        return None
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    new = hadoop.Path(hadoop.Path(old.getParent(), "archive"), f"{old.getName()}_{stamp}")
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"{path} can't be moved to {new}")
    return new.toString()
