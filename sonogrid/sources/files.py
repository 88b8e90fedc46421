"""Audio and array files: discovery, decoding in Arrow batches, and writing."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonogrid import schemas
from sonogrid.functions import names, signal

AUDIO = r"(?i)\.(wav|mp3|ogg|flac)$"


def discover(spark: SparkSession, path: str, pattern: str = AUDIO) -> DataFrame:
    """Files below a folder whose path fits, in whatever case; contents are read only if asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(pattern)).withColumn("stem", names.stem(F.col("path")))


def index(files: DataFrame) -> DataFrame:
    """One path for each stem, the first in order, and how many there are."""
    w = Window.partitionBy("stem")
    return files.select("stem", "path").withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("path"))).where("k = 1").drop("k")


def latest_step(files: DataFrame, every: int = 1) -> DataFrame:
    """The file of the highest step in its name of each folder; only steps that are multiples of `every`."""
    step = F.nullif(F.regexp_extract("path", r"step_?([0-9]+)[^/]*$", 1), F.lit("")).cast("bigint")
    return files.withColumn("step", step).where(F.col("step") % every == 0).groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.max_by("path", "step").alias("path"), F.max("step").alias("step"))


def run_dirs(spark: SparkSession, path: str) -> DataFrame:
    """Folders that hold a config.json, with the run's name and the probe it lies under (null at the top)."""
    c = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "config.json").load(path)
    folder = F.regexp_extract("path", "^(.*)/config.json$", 1)
    below = F.expr("substring(folder, instr(folder, root) + length(root) + 1)")
    return c.select(folder.alias("folder"), F.decode("content", "UTF-8").alias("config"), F.lit(path.split("://")[-1].rstrip("/")).alias("root")).withColumn("below", below).select("folder", "config", F.element_at(F.split("below", "/"), -1).alias("run_name"), F.when(F.size(F.split("below", "/")) > 1, F.get(F.split("below", "/"), F.lit(0))).alias("probe"))


def mapped(files: DataFrame, make: Callable[[bytes], list[list[float]]]) -> DataFrame:
    """Files with a spectrogram made of their contents; what can't be read has none, and the error's text.

    A file is decoded at a time, so a batch needs no more memory than its largest file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec_type = pa.list_(pa.list_(pa.float32()))
        for batch in batches:
            for k in range(batch.num_rows):
                try:
                    spec, error = make(batch["content"][k].as_py()), None
                except Exception as e:
                    spec, error = None, f"{type(e).__name__}: {e}"
                rows = None if spec is None else [np.asarray(r, np.float32) for r in spec]
                yield pa.RecordBatch.from_arrays(
                    [batch["stem"].slice(k, 1), pa.array([None if rows is None else len(rows)], pa.int32()), pa.array([None if rows is None else len(rows[0]) if rows else 0], pa.int64()), pa.array([rows], spec_type), pa.array([error], pa.string())],
                    ["stem", "n_mels", "n_timebins", "spec", "error"],
                )

    return files.select("stem", "content").mapInArrow(run, schemas.SPECS + ", error string")


def audio_to_specs(files: DataFrame, rate: int = 32_000, n_fft: int = 1024, hop: int = 64, n_mels: int | None = 128, least_ms: float = 0.0) -> DataFrame:
    """Spectrograms of audio files, resampled; too short ones are an error in their row."""

    def make(data: bytes):
        x, own = signal.decode_wav(data)
        if 1000 * len(x) / own < least_ms:
            raise ValueError("too short")
        return signal.spectrogram(signal.resample(x, own, rate), rate, n_fft, hop, n_mels)

    return mapped(files, make)


def audio_windows(files: DataFrame, windows: DataFrame, rate: int = 32_000, n_fft: int = 1024, hop: int = 64, n_mels: int | None = 128) -> DataFrame:
    """A spectrogram for each window (stem, start_s, end_s) of audio files; only its frames are decoded, and a file is read once for all its windows.

    A window is cut to its file; one without a sample, or a file that can't be decoded, is an error in its row. Windows without a file give none.
    """
    schema = "stem string, start_s double, end_s double, n_mels int, n_timebins bigint, spec array<array<float>>, error string"
    kinds = pa.schema([("stem", pa.string()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("n_mels", pa.int32()), ("n_timebins", pa.int64()), ("spec", pa.list_(pa.list_(pa.float32()))), ("error", pa.string())])

    def made(data: bytes, start: float, end: float) -> dict:
        try:
            x, own = signal.decode_wav(data, start, end - max(start, 0.0))
            if not len(x):
                raise ValueError("no samples")
            spec = signal.spectrogram(signal.resample(x, own, rate), rate, n_fft, hop, n_mels)
            return {"n_mels": spec.shape[0], "n_timebins": spec.shape[1], "spec": list(spec)}
        except Exception as e:
            return {"error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data = batch["content"][k].as_py()
                for w in batch["_windows"][k].as_py():
                    row = {"stem": batch["stem"][k].as_py(), "start_s": w["start_s"], "end_s": w["end_s"]}
                    yield pa.RecordBatch.from_pylist([row | made(data, w["start_s"], w["end_s"])], kinds)

    wanted = windows.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct(F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s")))).alias("_windows"))
    return files.join(wanted, "stem").select("stem", "content", "_windows").mapInArrow(run, schema)


def mean_std(specs: DataFrame) -> DataFrame:
    """Cells, mean and population std over all cells of spectrograms; a batch is summed as one array, and a row without a spectrogram has no cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, 0.0, 0.0
        for batch in batches:
            x = batch["spec"].flatten().flatten().to_numpy(zero_copy_only=False)
            x = x[~np.isnan(x)].astype(np.float64)
            n, total, squares = n + len(x), total + float(x.sum()), squares + float(x @ x)
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [total], "q": [squares]})

    sums = specs.select("spec").mapInArrow(run, "n long, s double, q double").agg(F.sum("n").alias("cells"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.nullif("cells", F.lit(0))
    return sums.select("cells", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.nullif("cells", F.lit(0)) - mean * mean)).alias("std"))


def npy_to_specs(files: DataFrame) -> DataFrame:
    """Arrays (mel, time) of .npy files. An array that is not two-dimensional is an error in its row."""

    def make(data: bytes):
        a = np.load(io.BytesIO(data), allow_pickle=False)
        if a.ndim != 2:
            raise ValueError(f"{a.ndim} dimensions")
        return a.astype(np.float32)

    return mapped(files, make)


def chunk_columns(specs: DataFrame) -> DataFrame:
    """base_stem and the chunk's times of each file."""
    base, start, end = names.parse_chunk(F.col("stem"))
    return specs.withColumns({"base_stem": base, "chunk_start_ms": start, "chunk_end_ms": end})


def windows_of(bundle: DataFrame) -> DataFrame:
    """Prediction bundles of parallel arrays (filenames, window_starts, window_lengths, logits, labels) as a row for each window; arrays of other lengths are an error."""
    parts = ["window_starts", "window_lengths", "logits", "labels"]
    same = F.lit(True)
    for p in parts:
        same = same & (F.size(p) == F.size("filenames"))
    checked = bundle.where(F.assert_true(same, "the arrays of a bundle differ in length").isNull())
    return checked.select("run_name", F.posexplode(F.arrays_zip("filenames", *parts)).alias("win_id", "w")).select("run_name", "win_id", F.col("w.filenames").alias("filename"), F.col("w.window_starts").alias("start"), F.col("w.window_lengths").alias("length"), "w.logits", "w.labels")


def read_bundles(files: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Arrays of .npz files: a row for each file and wanted name, with the array under the first of its keys that the file has: shape and values (row by row). A name without any of its keys, or a broken file, is an error in its row."""
    schema = "stem string, name string, shape array<bigint>, values array<double>, error string"

    def made(stem: str, data: bytes) -> Iterator[dict]:
        try:
            with np.load(io.BytesIO(data), allow_pickle=False) as held:
                for name, keys in wanted.items():
                    key = next((k for k in keys if k in held), None)
                    a = None if key is None else np.asarray(held[key], np.float64)
                    yield {"stem": stem, "name": name, "shape": None if a is None else list(a.shape), "values": None if a is None else a.ravel(), "error": f"none of {', '.join(keys)}" if a is None else None}
        except Exception as e:
            yield {"stem": stem, "name": None, "shape": None, "values": None, "error": f"{type(e).__name__}: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("stem", pa.string()), ("name", pa.string()), ("shape", pa.list_(pa.int64())), ("values", pa.list_(pa.float64())), ("error", pa.string())])
        for batch in batches:
            for k in range(batch.num_rows):
                for row in made(batch["stem"][k].as_py(), batch["content"][k].as_py()):
                    yield pa.RecordBatch.from_pylist([row], kinds)

    return files.select("stem", "content").mapInArrow(run, schema)
