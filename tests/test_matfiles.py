"""Version 5 files made here byte by byte, and windows of audio."""

from __future__ import annotations

import io
import struct
import wave
import zlib

import numpy as np
import pytest

from sonogrid.functions import signal
from sonogrid.sources import files, matfiles


def element(code: int, content: bytes, order: str = "<") -> bytes:
    if 0 < len(content) <= 4:
        return struct.pack(order + "I", len(content) << 16 | code) + content.ljust(4, b"\0")
    return struct.pack(order + "II", code, len(content)) + content + b"\0" * (-len(content) % 8)


def matrix(name: str, value, order: str = "<", packed: bool = False, code: int | None = None) -> bytes:
    if isinstance(value, str):
        kind, shape = 4, (1, len(value))
        data = element(code or 16, value.encode({16: "utf-8", 4: "utf-16-le" if order == "<" else "utf-16-be"}[code or 16]), order)
    else:
        a = np.asarray(value)
        kind, shape = 6, a.shape
        data = element(code or 9, a.ravel(order="F").astype(order + {9: "f8", 2: "u1", 4: "u2"}[code or 9]).tobytes(), order)
    body = element(6, struct.pack(order + "II", kind, 0), order) + element(5, struct.pack(order + "ii", *shape), order) + element(1, name.encode(), order) + data
    whole = element(14, body, order)
    if packed:
        z = zlib.compress(whole)
        return struct.pack(order + "II", 15, len(z)) + z
    return whole


def mat(*parts: bytes, order: str = "<") -> bytes:
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(order + "H", 0x100) + {"<": b"IM", ">": b"MI"}[order] + b"".join(parts)


def test_variables_of_a_file():
    for order in "<>":
        for packed in (False, True):
            got = matfiles.read_mat(mat(matrix("labels", "iab c", order, packed), matrix("m", [[1, 2], [3, 4.5]], order, packed), matrix("s", [[5]], order, packed, 2), matrix("u", "né", order, packed, 4), matrix("e", np.zeros((0, 0)), order, packed), order=order))
            assert got["labels"] == "iab c" and got["u"] == "né" and got["m"].tolist() == [[1, 2], [3, 4.5]] and got["s"].tolist() == [[5]] and got["e"].size == 0
    with pytest.raises(ValueError, match="version 5"):
        matfiles.read_mat(b"x" * 200)
    with pytest.raises(ValueError, match="ends after"):
        matfiles.read_mat(mat(matrix("m", [[1, 2], [3, 4.5]]))[:-8])


def test_syllables_and_broken_files(spark):
    times = lambda *x: np.array([x]).T
    good = mat(matrix("fname", "C:\\birds\\llb3_0003.cbin"), matrix("labels", "ab c\n", packed=True), matrix("onsets", times(10, 30, 50, 70)), matrix("offsets", times(20, 25, np.nan), packed=True))
    rows = [
        ("/d/B12/llb3_0003.cbin.not.mat", good), ("/d/x/song.wav.not.mat", mat(matrix("labels", "aa"), matrix("onsets", times(1, 2)), matrix("offsets", times(2, 3)))),
        ("/d/x/empty.not.mat", mat(matrix("labels", ""), matrix("onsets", times(1)), matrix("offsets", times(2)))), ("/d/x/none.not.mat", mat(matrix("labels", "a"))), ("/d/x/bad.not.mat", b"bad"), ("/d/x/cut.not.mat", good[:-8]),
    ]
    got = matfiles.read_not_mat(spark.createDataFrame(rows, "path string, content binary")).orderBy("path", "ordinal").collect()
    by = {p: [r for r in got if r.path == p] for p, _ in rows}
    assert [(r.filename, r.bird_id, r.ordinal, r.label, r.onset_ms, r.offset_ms) for r in by[rows[0][0]]] == [("llb3_0003.cbin", "B12", 0, "a", 10, 20), ("llb3_0003.cbin", "B12", 1, "b", 25, 30)]
    assert [(r.filename, r.bird_id, r.label) for r in by[rows[1][0]]] == [("song.wav", "song.wav", "a")] * 2
    assert [by[p][0].error.split(": ")[1][:10] for p, _ in rows[2:]] == ["no syllabl", "no onsets", "not a vers", "an element"] and all(len(by[p]) == 1 for p, _ in rows[2:])
    assert matfiles.bird_of("/a/c.not.mat", "b7/x") == "B7" and matfiles.bird_of("/a/or12_3.not.mat", "") == "or12"


def wav(x: np.ndarray, rate: int, channels: int = 1) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_windows_of_audio_are_slices_of_the_whole(spark):
    x = np.sin(np.arange(64_000) * 0.05) * 0.5
    data = wav(x, 32_000)
    whole, rate = signal.decode_wav(data)
    for a, n in ((0.0, 0.5), (0.25, 1.0), (1.9, 5.0), (-1.0, 0.1), (3.0, 1.0)):
        got, _ = signal.decode_wav(data, a, n)
        first = int(max(a, 0) * rate)
        assert (got == whole[first : first + round(n * rate)]).all()
    stereo = wav(np.stack([x, -x], axis=1).ravel(), 32_000, 2)
    assert len(signal.decode_wav(stereo, 0.5, 0.5)[0]) == 16_000 and np.abs(signal.decode_wav(stereo)[0]).max() == 0
    f = spark.createDataFrame([("a", data), ("b", b"no wav"), ("c", data)], "stem string, content binary")
    w = spark.createDataFrame([("a", 0.5, 1.0), ("a", 0.0, 9.0), ("a", 5.0, 6.0), ("b", 0.0, 1.0), ("z", 0.0, 1.0)], "stem string, start_s double, end_s double")
    got = {(r.stem, r.start_s): r for r in files.audio_windows(f, w, n_mels=16).collect()}
    assert set(got) == {("a", 0.0), ("a", 0.5), ("a", 5.0), ("b", 0.0)}
    assert np.allclose(np.array(got["a", 0.5].spec), signal.spectrogram(whole[16_000:32_000], 32_000, n_mels=16)) and got["a", 0.5].n_timebins == 251
    assert np.allclose(np.array(got["a", 0.0].spec), signal.spectrogram(whole, 32_000, n_mels=16)) and "no samples" in got["a", 5.0].error and got["b", 0.0].error and got["b", 0.0].spec is None
