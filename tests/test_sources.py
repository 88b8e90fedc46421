from __future__ import annotations

import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonogrid.functions import signal
from sonogrid.sources import annotations, files, sinks
from sonogrid.streaming import ingest

DOC = {
    "metadata": {"units": "ms"},
    "recordings": [
        {"recording": {"filename": "a.wav", "bird_id": "b1", "detected_vocalizations": 2}, "detected_events": [{"onset_ms": 0.0, "offset_ms": 50.0, "units": [{"onset_ms": 0.0, "offset_ms": 10.0, "id": 3}, {"onset_ms": 20.0, "offset_ms": 50.0, "id": None}]}]},
        {"recording": {"filename": "a.wav"}, "detected_events": [{"onset_ms": 60.0, "offset_ms": 70.0, "units": [{"onset_ms": 60.0, "offset_ms": 70.0, "id": 4}]}]},
        {"recording": {"filename": "c.wav"}, "detected_events": []},
    ],
}


@pytest.fixture
def doc(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(DOC))
    return str(tmp_path / "a.json")


def test_annotations(spark, doc):
    d = annotations.read_annotations(spark, doc)
    assert annotations.units(d).count() == 2 and annotations.units(d, "detect").count() == 2
    u = annotations.units(d)
    assert [r.id for r in annotations.one_recording(u, "first").collect()] == [3] and [r.id for r in annotations.one_recording(u, "last").collect()] == [4]
    with pytest.raises(ValueError, match="mode"):
        annotations.units(d, "other")
    specs = spark.createDataFrame([("a",), ("zz",)], "base_stem string")
    with pytest.raises(ValueError, match="zz"):
        annotations.attach(specs, u)
    assert annotations.attach(specs, u, "skip").count() == 2
    back = annotations.documents(u).collect()
    assert sum(r.recording.detected_vocalizations for r in back) == 2


def test_audio_params(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"sr": 32000, "mels": 128}')
    with pytest.raises(Exception, match="hop_size"):
        annotations.read_audio_params(spark, str(tmp_path / "p.json")).collect()
    row = annotations.read_audio_params(spark, str(tmp_path / "p.json"), {"hop_size": 64}).first()
    assert (row.sr, row.hop_size, row.mean) == (32000, 64, None)


def test_csv_of_both_kinds(spark, tmp_path):
    (tmp_path / "bird1.csv").write_text("﻿label,audio_file,onset_s,offset_s\na,x.wav,1.5,1.0\n\nb,x.wav,,2\n")
    (tmp_path / "bird2.csv").write_text("label\taudio_file\tonset_ms\toffset_ms\nc\ty.wav\t5\t9\n")
    got = annotations.read_units_csv(spark, str(tmp_path)).orderBy("bird_id").collect()
    assert [(r.bird_id, r.label, r.onset_ms, r.offset_ms) for r in got] == [("bird1", "a", 1000.0, 1500.0), ("bird2", "c", 5.0, 9.0)]


def test_xml(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<Sequences><Sequence><WaveFileName>q.WAV</WaveFileName><Position>32000</Position><Length>10</Length><NumNote>1</NumNote><Note><Position>320</Position><Length>64</Length><Label>7</Label></Note></Sequence></Sequences>")
    assert tuple(annotations.read_sequences_xml(spark, str(tmp_path / "s.xml")).first()) == ("q", 0, 1010.0, 1012.0, "7")


def test_detections(spark, tmp_path):
    seg = {"onset_timebin": 1, "offset_timebin": 2, "onset_ms": 9.0, "offset_ms": 3.0}
    (tmp_path / "d.json").write_text(json.dumps([{"filename": "a", "song_present": True, "segments": [seg, seg]}, {"filename": "b", "song_present": False, "segments": []}]))
    got = annotations.read_detections(spark, str(tmp_path / "d.json")).collect()
    assert [(r.filename, r.onset_ms, r.offset_ms) for r in got] == [("a", 3.0, 9.0)]
    (tmp_path / "e.json").write_text(json.dumps([{"filename": "b", "song_present": True, "segments": []}]))
    with pytest.raises(Exception, match="contradicts"):
        annotations.read_detections(spark, str(tmp_path / "e.json")).collect()


def test_logs_metrics_and_maps(spark, tmp_path):
    (tmp_path / "l.txt").write_text("step,train_loss,val_loss\n1,0.5,\n2,,0.4\nbroken\n")
    assert [(r.step, r.train_loss, r.val_loss) for r in annotations.read_losses(spark, str(tmp_path / "l.txt")).orderBy("step").collect()] == [(1, 0.5, None), (2, None, 0.4)]
    labels = spark.createDataFrame([("7",), ("b",), ("a",), ("2",), ("a",)], "l string")
    assert {r.label: r.id for r in annotations.label_map(labels, "l").collect()} == {"7": 7, "2": 2, "a": 8, "b": 9}


def tone(rate=16_000, hz=1000.0, seconds=0.25) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        x = (np.sin(2 * np.pi * hz * np.arange(int(rate * seconds)) / rate) * 20000).astype("<i2")
        w.writeframes(np.repeat(x, 2).tobytes())
    return out.getvalue()


def test_audio_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/t.WAV").write_bytes(tone())
    (tmp_path / "bad.wav").write_bytes(b"no audio")
    (tmp_path / "other.txt").write_text("x")
    found = files.discover(spark, str(tmp_path))
    assert {r.stem for r in files.index(found).collect()} == {"t", "bad"}
    got = {r.stem: r for r in files.audio_to_specs(found, n_mels=None).collect()}
    assert got["bad"].spec is None and got["bad"].error and got["t"].error is None and got["t"].n_mels == 513
    mean = np.array(got["t"].spec).mean(axis=1)
    assert abs(int(mean.argmax()) - 1000 * 1024 / 32000) <= 1 and abs(np.array(got["t"].spec).max()) < 1e-4
    assert files.audio_to_specs(found, least_ms=1e6).where("error IS NULL").count() == 0


def test_mel_filters_cover_the_band():
    f = signal.mel_filters(32_000, 1024, 40)
    assert f.shape == (40, 513) and (f.sum(axis=1) > 0).all() and abs(float(signal.hz_of(signal.mel_of(np.array(440.0)))) - 440) < 1e-6


def test_npy_and_chunks(spark, tmp_path):
    np.save(tmp_path / "x__ms_5_10.npy", np.ones((4, 7), np.float64))
    np.save(tmp_path / "flat.npy", np.ones(3))
    got = {r.stem: r for r in files.chunk_columns(files.npy_to_specs(files.discover(spark, str(tmp_path), r"\.npy$"))).collect()}
    assert (got["x__ms_5_10"].n_mels, got["x__ms_5_10"].n_timebins, got["x__ms_5_10"].base_stem) == (4, 7, "x") and "dimensions" in got["flat"].error


def test_runs_and_checkpoints(spark, tmp_path):
    for p in ("lin/run1", "run0"):
        (tmp_path / p).mkdir(parents=True)
        (tmp_path / p / "config.json").write_text("{}")
    for s in (5, 40, 100):
        (tmp_path / f"run0/model_step_{s}.pth").write_text("x")
    assert {(r.run_name, r.probe) for r in files.run_dirs(spark, str(tmp_path)).collect()} == {("run1", "lin"), ("run0", None)}
    steps = files.discover(spark, str(tmp_path), r"\.pth$")
    assert files.latest_step(steps).first().step == 100 and files.latest_step(steps, 8).first().step == 40


def test_bundle(spark):
    schema = "run_name string, filenames array<string>, window_starts array<bigint>, window_lengths array<bigint>, logits array<array<array<float>>>, labels array<array<bigint>>"
    good = spark.createDataFrame([("r", ["a", "b"], [0, 8], [8, 3], [[[0.1]], [[0.2]]], [[1], [2]])], schema)
    assert [(r.win_id, r.filename, r.length) for r in files.windows_of(good).orderBy("win_id").collect()] == [(0, "a", 8), (1, "b", 3)]
    with pytest.raises(Exception, match="differ in length"):
        files.windows_of(spark.createDataFrame([("r", ["a"], [0, 8], [8], [[[0.1]]], [[1]])], schema)).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int")
    p = str(tmp_path / "t")
    for _ in range(2):
        sinks.append_new(df, p, ["k"])
    assert spark.read.parquet(p).count() == 2
    sinks.upsert(spark.createDataFrame([("b", 9)], "k string, x int"), p, ["k"], str(tmp_path / "u"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "u")).collect()} == {("a", 1), ("b", 9)}
    names = spark.createDataFrame([("x.wav", i) for i in range(3)], "name string, i int")
    assert {r.target for r in sinks.unique_names(names, "name").collect()} == {"x.wav", "x_1.wav", "x_2.wav"}
    assert sinks.unique_names(names, "name", "skip").count() == 1
    with pytest.raises(Exception, match="two files"):
        sinks.unique_names(names, "name", "fail").collect()
    index = spark.createDataFrame([("a", "/a", 1), ("b", "/b", 2)], "stem string, path string, n int")
    with pytest.raises(ValueError, match="ambiguous"):
        sinks.write_manifest(index, index.select("stem"), str(tmp_path / "m"))
    sinks.write_manifest(index, index.where("n = 1").select("stem"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1
    sinks.write_metrics(df.withColumnRenamed("k", "run_name"), None, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["run_name", "x"]
    sinks.write_splits(df.withColumnRenamed("k", "split"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'a'").count() == 1
    sinks.write_results(spark.createDataFrame([("a", None), ("b", "bad")], "stem string, error string"), str(tmp_path / "ok"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1 and spark.read.csv(str(tmp_path / "log"), sep="\t").first()[1] == "bad"


def test_stream_ingests_each_unit_once(spark, tmp_path):
    rows = [{"stem": "a", "bird_id": "b", "onset_ms": float(i), "offset_ms": i + 1.0, "id": 1, "at": f"2024-01-01T00:0{i}:00Z"} for i in range(3)]
    src, table, ck = (str(tmp_path / x) for x in ("src", "table", "ck"))
    (tmp_path / "src").mkdir()
    for name, part in (("1.json", rows[:2]), ("2.json", rows[1:])):
        (tmp_path / "src" / name).write_text("\n".join(map(json.dumps, part)))
        ingest.ingest(ingest.arriving(spark, src), table, ck).awaitTermination(120)
    assert spark.read.parquet(table).count() == 3
    q = ingest.song_sessions(ingest.arriving(spark, src)).writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("sessions").select("n").first().n == 4


def test_losses_by_minute(spark):
    df = spark.createDataFrame([("r", 1.0, "2024-01-01 00:00:10"), ("r", 3.0, "2024-01-01 00:00:50"), ("r", 5.0, "2024-01-01 00:01:10")], "run string, loss double, at string").withColumn("at", F.to_timestamp("at"))
    assert [(r.loss, r.n) for r in ingest.losses_by_minute(df).orderBy("start").collect()] == [(2.0, 2), (5.0, 1)]


@pytest.mark.parametrize("text", ['{"a": "/x/a.wav", "b": "/y/b.wav"}', '[{"stem": "a", "path": "/x/a.wav"}, {"stem": "b", "path": "/y/b.wav"}]', '[["a", "/x/a.wav"], ["b", "/y/b.wav"]]', "# wavs\na\t/x/a.wav\n\n/y/b.wav  # second\n"])
def test_wav_manifests(spark, tmp_path, text):
    (tmp_path / "m").write_text(text)
    assert {tuple(r) for r in annotations.read_wav_manifest(spark, str(tmp_path / "m")).collect()} == {("a", "/x/a.wav"), ("b", "/y/b.wav")}


def test_wav_manifest_with_two_paths(spark, tmp_path):
    (tmp_path / "m").write_text("a\t/x/a.wav\na\t/y/a.wav\n")
    with pytest.raises(Exception, match="two paths"):
        annotations.read_wav_manifest(spark, str(tmp_path / "m")).collect()


def test_filtered_documents(spark, doc, tmp_path):
    d = annotations.read_annotations(spark, doc)
    sinks.write_filtered(annotations.of_bird(d, "b1"), str(tmp_path / "f"))
    back = annotations.read_annotations(spark, str(tmp_path / "f"))
    assert [r.stem for r in annotations.recordings(back).collect()] == ["a"] and back.first().metadata.units == "ms"
    assert annotations.recordings(annotations.of_bird(d, None)).count() == 3
    with pytest.raises(ValueError, match="b9"):
        annotations.of_bird(d, "b9")


def test_params_take_statistics(spark, tmp_path):
    params = spark.createDataFrame([("x", 128, 0.5), ("y", 64, None)], "dataset string, mels int, mean double")
    stats = spark.createDataFrame([("x", 1.5, 2.0), ("z", 3.0, 4.0)], "dataset string, mean double, std double")
    sinks.write_params(params, stats, str(tmp_path / "p"))
    got = {r.dataset: r.value for r in spark.read.text(str(tmp_path / "p")).collect()}
    assert got == {"x": '{"mean":1.5,"mels":128,"std":2.0}', "y": '{"mels":64}', "z": '{"mean":3.0,"std":4.0}'}


def test_npz_bundles(spark, tmp_path):
    np.savez(tmp_path / "a.npz", old=np.arange(6.0).reshape(2, 3), sr=np.array(32000))
    (tmp_path / "b.npz").write_bytes(b"no")
    got = files.read_bundles(files.discover(spark, str(tmp_path), r"\.npz$"), {"h": ["new", "old"], "sr": ["sr"], "z": ["z"]})
    rows = {(r.stem, r.name): r for r in got.collect()}
    assert rows["a", "h"].shape == [2, 3] and rows["a", "h"]["values"] == [0, 1, 2, 3, 4, 5] and rows["a", "sr"]["values"] == [32000]
    assert rows["a", "z"].error == "none of z" and rows["b", None].error
    sinks.write_bundle(got, spark.createDataFrame([(4,)], "patch int"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 4 and spark.read.json(str(tmp_path / "out/settings")).first().patch == 4


def test_losses_and_archive(spark, tmp_path):
    path = str(tmp_path / "runs/r1")
    assert sinks.archive(spark, path) is None
    rows = spark.createDataFrame([(1, 0.5, None, 1.0, 8, None, None), (2, 0.25, 0.75, 1.0, 16, 2.0, 3.0)], annotations.schemas.LOSSES)
    for r in (1, 2):
        sinks.append_losses(rows.where(f"step = {r}").coalesce(1), path)
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["1,0.500000,,1.000000,8,,", "2,0.250000,0.750000,1.000000,16,2.00,3.0"]
    assert annotations.read_losses(spark, path).orderBy("step").collect() == rows.collect()
    new = sinks.archive(spark, path)
    assert "/runs/archive/r1_" in new and spark.read.text(new).count() == 2


def test_quoted_fields_keep_their_separators(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"label",audio_file,onset_ms,"offset_ms"\n"a, b","x, ""y"".wav",1,2\nc,z.wav,"5",3\nshort,z\n')
    (tmp_path / "b.tsv").write_text('label\taudio_file\tonset_s\toffset_s\n"a\tb"\tx,y.wav\t1\t2\n')
    got = annotations.read_units_csv(spark, str(tmp_path)).orderBy("bird_id", "label").collect()
    assert [(r.bird_id, r.label, r.audio_file, r.onset_ms, r.offset_ms) for r in got] == [("a", "a, b", 'x, "y".wav', 1, 2), ("a", "c", "z.wav", 3, 5), ("b", "a\tb", "x,y.wav", 1000, 2000)]


def test_mean_and_std_of_all_cells(spark):
    specs = [np.arange(6, dtype=np.float32).reshape(2, 3), np.full((1, 4), -3, np.float32)]
    df = spark.createDataFrame([(s.tolist(),) for s in specs] + [(None,), ([],)], "spec array<array<float>>").repartition(3)
    cells = np.concatenate([s.ravel() for s in specs])
    r = files.mean_std(df).first()
    assert r.cells == 10 and np.allclose([r["mean"], r["std"]], [cells.mean(), cells.std()]) and files.mean_std(df.limit(0)).first()["mean"] is None
