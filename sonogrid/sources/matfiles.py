"""Annotations in MATLAB's version 5 files: numbers and texts of a file's variables, and labelled intervals out of them."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format: numbers by type code, the codes of texts, of a matrix and of a compressed element, and the classes of arrays of text and of numbers.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
TEXTS = {16: "utf-8", 17: "utf-16", 18: "utf-32"}
MATRIX, COMPRESSED = 14, 15
CHARS, NUMERIC = 4, range(6, 16)
HEADER = 128


def elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """Type codes and contents of data elements; compressed ones are unpacked. What ends early is an error."""
    at = 0
    while at + 8 <= len(data):
        code, size = struct.unpack_from(order + "II", data, at)
        if code >> 16:  # a small element: size and type share four bytes, the content follows in four
            code, size, begin, step = code & 0xFFFF, code >> 16, at + 4, 8
        else:
            begin, step = at + 8, 8 + size + (-size % 8 if code != COMPRESSED else 0)
        content = data[begin : begin + size]
        if len(content) < size:
            raise ValueError(f"an element of {size} bytes ends after {len(content)}")
        if code == COMPRESSED:
            yield from elements(zlib.decompress(content), order)
        else:
            yield code, content
        at += step


def value_of(content: bytes, order: str) -> tuple[str, np.ndarray | str | None]:
    """Name and value of a matrix: a text (by columns), an array of numbers, or None for other classes."""
    parts = elements(content, order)
    flags, shape, name = next(parts)[1], next(parts)[1], next(parts)[1].decode("latin-1")
    kind = struct.unpack_from(order + "I", flags)[0] & 0xFF
    if kind != CHARS and kind not in NUMERIC:
        return name, None
    size = np.frombuffer(shape, order + "i4")
    code, raw = next(parts, (1, b""))
    if kind == CHARS and code in TEXTS:
        return name, raw.decode(TEXTS[code] + ({"<": "-le", ">": "-be"}[order] if code != 16 else ""))
    flat = np.frombuffer(raw, order + NUMBERS[code])
    if kind == CHARS:
        return name, "".join(map(chr, flat.tolist()))
    return name, flat.astype(np.float64).reshape(size, order="F")


def read_mat(data: bytes) -> dict[str, np.ndarray | str]:
    """The variables of a file that hold text or real numbers."""
    order = {b"IM": "<", b"MI": ">"}.get(data[126:128])
    if order is None or struct.unpack_from(order + "H", data, 124)[0] >> 8 != 1:
        raise ValueError("not a version 5 file")
    found = (value_of(content, order) for code, content in elements(data[HEADER:], order) if code == MATRIX)
    return {name: value for name, value in found if value is not None}


def bird_of(path: str, name: str) -> str:
    """B and digits anywhere in the path's parts or the recording's, else letters and digits, the last part first; else the file's own name."""
    parts = [p for p in path.split("/")[::-1] if p] + [p for p in name.replace("\\", "/").split("/") if p]
    found = []
    for p in parts:
        for pattern, upper in ((r"([A-Za-z]+\d+)", False), (r"(?:^|[^A-Za-z0-9])([Bb]\d{1,4})", True)):
            if m := re.search(pattern, p):
                found.append(m[1].upper() if upper else m[1])
    best = next((x.upper() for x in found if re.fullmatch(r"[Bb]\d+", x)), found[0] if found else None)
    return best or re.sub(r"(?i)\.not\.mat$", "", parts[0])


def syllables(path: str, data: bytes) -> list[dict]:
    """Labelled intervals of a file, as many as the shortest of labels, onsets and offsets; blank labels take no place, reversed times are swapped."""
    held = read_mat(data)
    labels = [c for c in str(held.get("labels", "")) if c not in " \n\r\t"]
    times = []
    for field in ("onsets", "offsets"):
        if not isinstance(held.get(field), np.ndarray) or not held[field].size:
            raise ValueError(f"no {field}")
        times.append(held[field].ravel(order="F").tolist())
    name = held.get("fname") if isinstance(held.get("fname"), str) else ""
    recording = re.split(r"[\\/]", name)[-1] or re.sub(r"(\.[^.]*){1,2}$", "", path.split("/")[-1])
    rows = [{"filename": recording, "bird_id": bird_of(path, name), "label": c, "onset_ms": min(a, b), "offset_ms": max(a, b)} for c, a, b in zip(labels, *times, strict=False) if not (math.isnan(a) or math.isnan(b))]
    if not rows:
        raise ValueError("no syllables")
    return rows


SYLLABLES = "path string, filename string, bird_id string, ordinal bigint, label string, onset_ms double, offset_ms double, error string"


def read_not_mat(files: DataFrame) -> DataFrame:
    """A row for each labelled interval of .not.mat files (path, content), in order; a file that can't be read, or has none, is one row with an error."""
    kinds = pa.schema([("path", pa.string()), ("filename", pa.string()), ("bird_id", pa.string()), ("ordinal", pa.int64()), ("label", pa.string()), ("onset_ms", pa.float64()), ("offset_ms", pa.float64()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                try:
                    rows = [x | {"path": path, "ordinal": k} for k, x in enumerate(syllables(path, data.as_py()))]
                except Exception as e:
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return files.select("path", "content").mapInArrow(run, SYLLABLES)
