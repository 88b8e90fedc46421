"""What the text operators share: scratch tables, folds, and walks over Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space, which is also how bytes.split() cuts.
SPACE = r"[\x20\x09-\x0D]+"
#: The bytes of A-Z, and of all others as they are.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of the cluster (spark.checkpoint.dir); where that is unset and Spark runs on this machine alone, in a local one. It goes when the driver ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/sonogrid"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of scratch() that a later one has replaced."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Groups that are broadcast at most (some MB), and tasks over which the rows of one group are dealt where they are more.
GROUPS, SALTS = 1 << 16, 16


def grouped_join(rows: DataFrame, groups: DataFrame, key: str, spread: str, most: int = GROUPS) -> DataFrame:
    """rows joined with groups (one row for each key): broadcast if they are counted as few, else with the rows of a key dealt over SALTS tasks by the column `spread`."""
    groups = written(groups)
    if groups.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(groups), key)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"]).drop("_salt")


def copies_join(rows: DataFrame, groups: DataFrame, key: str, share: int = 1024) -> DataFrame:
    """rows joined with groups (a written table: one row for each key, and `copies`, the number of its rows). Keys with over one row in `share`, fewer than `share` by that, are broadcast; the others meet by a shuffle."""
    total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    heavy = F.col("copies") * share > F.lit(total)
    hot = F.broadcast(groups.where(heavy))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(groups.where(~heavy), key)).drop("copies")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns named, and text with null as the empty text; other columns are not read."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold(doc_id: Column) -> Column:
    """0 to 3; rows of fold 2 are held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER_AZ, LOWER_AZ)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about `most` bytes of text at most (one row at least), and their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            part = batch.slice(at, end - at)
            yield part, part[column].to_pylist()
            at = end


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each run of the given lengths; empty runs give 0."""
    ends = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    at = np.concatenate(([0], np.cumsum(lengths)))
    return ends[at[1:]] - ends[at[:-1]]
