"""Data sources: folders of arrays, and samples that arrive in shards.

    spark.dataSource.register(ArrayFolder)
    spark.read.format("array_folder").option("shape", "true").load("file:///data/specs")

Files are reached through pyarrow's file systems, so a path is a folder that all executors see or the address of an object store.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes that a task reads, about; a file of which only the header is read counts as so many.
TASK_BYTES, HEADER_BYTES = 128 << 20, 64 << 10
SHAPE = "stem string, path string, n_mels int, n_timebins bigint, error string"
WHOLE = SHAPE + ", spec array<array<float>>"


def listed(path: str, suffix: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    """Files of a folder (not of those below it) whose names end so, with their sizes, in the order of their paths."""
    system, base = fs.FileSystem.from_uri(path)
    found = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.File and f.path.endswith(suffix))
    if not found:
        raise FileNotFoundError(f"no {suffix} files in {path}")
    return system, found


@dataclass
class Files(InputPartition):
    paths: list[str]


def header(f) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and type of an array file; nothing after its header is read."""
    version = np.lib.format.read_magic(f)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"array format {version}")
    shape, _, kind = read(f)
    if len(shape) != 2:
        raise ValueError(f"{len(shape)} dimensions")
    return shape, kind


def nested(a: np.ndarray) -> pa.Array:
    """One row that holds a matrix."""
    n, m = a.shape
    inner = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(np.ascontiguousarray(a, np.float32).ravel()))
    return pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), inner)


class ArrayReader(DataSourceReader):
    def __init__(self, path: str, shape: bool, task_bytes: int):
        self.path, self.shape, self.task_bytes = path, shape, task_bytes

    def partitions(self) -> list[Files]:
        """Files in order, as many to a task as make up its bytes."""
        out, held = [], self.task_bytes
        for path, size in listed(self.path, ".npy")[1]:
            size = min(size, HEADER_BYTES) if self.shape else size
            if held + size > self.task_bytes:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(path)
            held += size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            shape, spec, error = (None, None), None, None
            try:
                with system.open_input_file(path) as f:
                    if self.shape:
                        shape = header(f)[0]
                    else:
                        spec = np.load(io.BytesIO(f.read()), allow_pickle=False)
                        if spec.ndim != 2:
                            raise ValueError(f"{spec.ndim} dimensions")
                        shape = spec.shape
            except Exception as e:
                shape, spec, error = (None, None), None, f"{type(e).__name__}: {e}"
            columns = [pa.array([PurePosixPath(path).stem]), pa.array([path]), pa.array([shape[0]], pa.int32()), pa.array([shape[1]], pa.int64()), pa.array([error], pa.string())]
            names = ["stem", "path", "n_mels", "n_timebins", "error"]
            if not self.shape:
                columns.append(pa.nulls(1, pa.list_(pa.list_(pa.float32()))) if spec is None else nested(spec))
                names.append("spec")
            yield pa.RecordBatch.from_arrays(columns, names)


class ArrayFolder(DataSource):
    """The .npy files of a folder in order of their paths: stem, path, n_mels, n_timebins, error and spec. With the option `shape` there is no spec and only headers are read.

    A file that can't be read, or isn't a matrix, is an error in its row; a folder without files is an error. Option `task_bytes`: bytes for a task.
    """

    @classmethod
    def name(cls) -> str:
        return "array_folder"

    def _shape(self) -> bool:
        return self.options.get("shape", "false").lower() == "true"

    def schema(self) -> str:
        return SHAPE if self._shape() else WHOLE

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options["path"], self._shape(), int(self.options.get("task_bytes", TASK_BYTES)))


# Samples


SAMPLES = "idx bigint, name string, path string, rate int, audio binary, error string"


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    begin: int
    end: int


def sample_name(idx: int, filepath: str | None, path: str | None) -> str:
    """The stem of the sample's file, else of its audio's, else its number."""
    given = filepath or path
    return PurePosixPath(given).stem if given else f"sample_{idx:06d}"


class SampleReader(DataSourceStreamReader):
    """Samples are numbered through all shards in the order of their names; the number of samples read is the offset. A shard that arrives must come after those read."""

    def __init__(self, path: str, batch: int, task: int):
        self.path, self.batch, self.task = path, batch, task
        self.at, self.sizes = None, {}

    def shards(self) -> list[tuple[str, int]]:
        """Shards and their rows, told by their footers, which are read once."""
        try:
            system, found = listed(self.path, ".parquet")
        except FileNotFoundError:
            return []
        for path, _ in found:
            if path not in self.sizes:
                with system.open_input_file(path) as f:
                    self.sizes[path] = pq.read_metadata(f).num_rows
        return [(path, self.sizes[path]) for path, _ in found]

    def initialOffset(self) -> dict:
        return {"samples": 0}

    def latestOffset(self) -> dict:
        """At most a batch after what was planned last. After a restart Spark plans the last batch again first, which tells where that was."""
        self.at = min(sum(n for _, n in self.shards()), (self.at or 0) + self.batch)
        return {"samples": self.at}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        begin, stop = start["samples"], end["samples"]
        self.at = max(self.at or 0, stop)
        out, first = [], 0
        for path, n in self.shards():
            for a in range(max(begin, first), min(stop, first + n), self.task):
                out.append(Rows(path, first, a - first, min(a + self.task, stop, first + n) - first))
            first += n
        return out

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["samples"])

    def read(self, partition: Rows) -> Iterator[tuple]:
        """Only the row groups that hold the rows are read. A sample without audio is an error in its row."""
        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as f:
            shard, row = pq.ParquetFile(f), 0
            for k in range(shard.num_row_groups):
                n = shard.metadata.row_group(k).num_rows
                a, b = max(partition.begin, row), min(partition.end, row + n)
                if a < b:
                    for i, x in enumerate(shard.read_row_group(k).slice(a - row, b - a).to_pylist()):
                        idx, audio = partition.first + a + i, x.get("audio")
                        error = None if audio else "no audio"
                        yield (idx, sample_name(idx, x.get("filepath"), x.get("path")), x.get("path") or x.get("filepath"), x.get("sampling_rate"), audio, error)
                row += n


class SampleStream(DataSource):
    """Samples of a data set that arrives as Parquet shards (filepath, path, sampling_rate, audio: a file's bytes), as a stream of idx, name, path, rate, audio and error.

    Options: `batch`, samples of a micro-batch at most; `task`, of a task. Numbers and names are the same whenever a batch is read again.
    """

    @classmethod
    def name(cls) -> str:
        return "sample_stream"

    def schema(self) -> str:
        return SAMPLES

    def streamReader(self, schema) -> SampleReader:
        return SampleReader(self.options["path"], int(self.options.get("batch", 10_000)), int(self.options.get("task", 250)))


def register(spark) -> None:
    for source in (ArrayFolder, SampleStream):
        spark.dataSource.register(source)
