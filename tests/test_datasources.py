"""Sources of arrays and samples, and islands on a stream."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sonogrid.operators import intervals
from sonogrid.sources import datasources
from sonogrid.streaming import islands


@pytest.fixture
def sources(spark):
    datasources.register(spark)
    return spark


def test_array_folder(sources, tmp_path):
    want = {}
    for k in (2, 0, 1):
        want[f"s{k}__ms_0_9"] = a = np.arange(3 * (k + 4), dtype=np.float64).reshape(3, -1) + k
        np.save(tmp_path / f"s{k}__ms_0_9.npy", np.asfortranarray(a) if k == 1 else a)
    (tmp_path / "below").mkdir()
    np.save(tmp_path / "below" / "no.npy", np.zeros((2, 2)))
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    (tmp_path / "broken.npy").write_bytes(b"no array")
    (tmp_path / "note.txt").write_text("x")
    for task in ("1", "1000000"):
        df = sources.read.format("array_folder").option("task_bytes", task).load(f"file://{tmp_path}")
        got = df.collect()
        assert [r.stem for r in got] == sorted([*want, "broken", "cube"]) and df.rdd.getNumPartitions() == (5 if task == "1" else 1)
        for r in got:
            if r.stem in want:
                assert (np.array(r.spec) == want[r.stem]).all() and (r.n_mels, r.n_timebins) == want[r.stem].shape and r.error is None
            else:
                assert r.spec is None and r.n_mels is None and r.error
    with pytest.raises(Exception, match="no .npy files"):
        (tmp_path / "empty").mkdir()
        sources.read.format("array_folder").load(f"file://{tmp_path}/empty").count()


def test_shapes_need_headers_only(sources, tmp_path, monkeypatch):
    """Files that end after their headers have their shapes; of a real one some hundred bytes are read."""
    for k in range(4):
        with open(tmp_path / f"f{k}.npy", "wb") as f:
            np.lib.format.write_array_header_1_0(f, {"shape": (128, 10**9 + k), "fortran_order": False, "descr": "<f4"})
    got = sources.read.format("array_folder").option("shape", "true").load(str(tmp_path))
    assert got.columns == ["stem", "path", "n_mels", "n_timebins", "error"]
    assert [(r.n_mels, r.n_timebins, r.error) for r in got.orderBy("path").collect()] == [(128, 10**9 + k, None) for k in range(4)]
    np.save(tmp_path / "real.npy", np.zeros((128, 50_000), np.float32))
    with open(tmp_path / "real.npy", "rb") as f:
        assert datasources.header(f)[0] == (128, 50_000) and f.tell() < 300
    assert len(datasources.ArrayReader(str(tmp_path), True, datasources.TASK_BYTES).partitions()) == 1


def shard(path, rows):
    kind = pa.schema([("filepath", pa.string()), ("path", pa.string()), ("sampling_rate", pa.int32()), ("audio", pa.binary())])
    pq.write_table(pa.Table.from_pylist(rows, kind), path, row_group_size=7)


def test_samples_survive_a_restart_in_mid_stream(sources, tmp_path):
    src, out, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    src.mkdir()
    sample = lambda k: {"filepath": f"a/XC{k}.ogg" if k % 3 == 0 else None, "path": f"b/p{k}.wav" if k % 3 == 1 else None, "sampling_rate": 32_000, "audio": b"x" * (k % 5)}
    shard(src / "part-000.parquet", [sample(k) for k in range(40)])
    shard(src / "part-001.parquet", [sample(k) for k in range(40, 55)])
    sizes = []

    def start(fail_at=None):
        def keep(batch, n):
            rows = batch.collect()
            sizes.append(len(rows))
            if n == fail_at:
                raise RuntimeError("lost")
            batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

        stream = sources.readStream.format("sample_stream").option("batch", 12).option("task", 5).load(f"file://{src}")
        return stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(check)).start()

    q = start(fail_at=2)
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination(60)
        q.processAllAvailable()
    q = start()
    q.processAllAvailable()
    shard(src / "part-002.parquet", [sample(k) for k in range(55, 75)])
    q.processAllAvailable()
    q.stop()
    q = start()
    shard(src / "part-003.parquet", [sample(k) for k in range(75, 80)])
    q.processAllAvailable()
    q.stop()
    got = sources.read.parquet(str(out)).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(80)) and max(sizes) <= 12
    assert [r.name for r in got[:4]] == ["XC0", "p1", "sample_000002", "XC3"] and all((r.error == "no audio") == (r.idx % 5 == 0) for r in got)
    assert got[77].name == "sample_000077" and got[76].path == "b/p76.wav"


def test_islands_on_a_stream_are_those_of_all_units(spark, tmp_path):
    rng = random.Random(7)
    t0 = datetime(2024, 1, 1)
    units = [(f"r{rng.randrange(5)}", round(rng.uniform(0, 4000), 1), 0.0, t0 + timedelta(seconds=rng.randrange(50))) for _ in range(250)]
    units = [(s, a, a + rng.choice([5.0, 30.0, 200.0]), at) for s, a, _, at in units]
    schema = "stem string, onset_ms double, offset_ms double, at timestamp"
    batch = spark.createDataFrame([u[:3] for u in units], "stem string, onset_ms double, offset_ms double")
    want = sorted((r.stem, r.onset_ms, r.offset_ms, r.n) for r in intervals.merged(batch, "stem", tolerance=50.0).collect())
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", islands.STORE)
    try:
        for turn in range(2):
            src, out, check = tmp_path / f"in{turn}", tmp_path / f"out{turn}", tmp_path / f"check{turn}"
            order = rng.sample(units, len(units))
            parts = [order[k::4] for k in range(4)] + [[("end", 0.0, 1.0, t0 + timedelta(hours=3))], [("end", 0.0, 1.0, t0 + timedelta(hours=9))]]
            for k, part in enumerate(parts):
                rows = part + ([(None, 1.0, 2.0, t0), ("r0", None, 2.0, t0)] if k == 1 else [])
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
                # Each part is a run of its own, so that state is read back.
                stream = islands.merged_stream(spark.readStream.schema(schema).parquet(str(src)))
                q = stream.writeStream.format("parquet").option("checkpointLocation", str(check)).outputMode("append").trigger(availableNow=True).start(str(out))
                q.awaitTermination(120)
            got = sorted((r.stem, r.onset_ms, r.offset_ms, r.n) for r in spark.read.schema(islands.ISLANDS).parquet(str(out)).where("stem <> 'end'").collect())
            assert got == want
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    assert islands.joined([(0, 1, 1), (5, 6, 2), (1, 4, 1)], 1) == [(0, 6, 4)] and islands.joined([], 1) == []
