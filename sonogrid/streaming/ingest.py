"""Annotations and losses that arrive as files, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sonogrid.sources import sinks

UNITS = "stem string, bird_id string, onset_ms double, offset_ms double, id int, at timestamp"


def arriving(spark: SparkSession, path: str, schema: str = UNITS, per_trigger: int = 100) -> DataFrame:
    """Rows of JSON files in a folder as they come, a bounded number of files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def ingest(units: DataFrame, table: str, checkpoint: str, key: list[str] | None = None, seconds: int | None = None) -> StreamingQuery:
    """Each unit once in the table, whatever comes twice or is read again after a failure; every so many seconds, or all there is and then an end."""
    key = key or ["stem", "onset_ms", "offset_ms"]

    def add(batch: DataFrame, _: int) -> None:
        sinks.append_new(batch.dropDuplicates(key), table, key)

    writer = units.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def song_sessions(units: DataFrame, gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """W08 on a stream: units of a recording no further apart than the gap, as sessions with their count; units that come later than the watermark are dropped."""
    s = units.withWatermark("at", late).groupBy("stem", F.session_window("at", gap).alias("s"))
    return s.agg(F.count("*").alias("n"), F.sum(F.col("offset_ms") - F.col("onset_ms")).alias("ms")).select("stem", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "ms")


def losses_by_minute(losses: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A32 on a stream: mean loss of each minute."""
    return losses.withWatermark("at", late).groupBy("run", F.window("at", "1 minute").alias("w")).agg(F.avg("loss").alias("loss"), F.count("*").alias("n")).select("run", F.col("w.start").alias("start"), "loss", "n")
