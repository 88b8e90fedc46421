"""Operator 6: packing into windows by Karmarkar-Karp multiway differencing.

A document's ids beyond full windows are cut into pieces of at most PIECE ids. When a
task has ids for GROUP windows, it keeps the last of them (RESERVE for each window) back
and differences the pieces before: the two partial partitions with the largest spread
merge, the fullest windows of the one with the emptiest of the other, until one
partition is left, whose windows are near equal. If the fullest exceeds the capacity,
the window count rises by one and the group is differenced again. The ids kept back
then fill up what the windows lack, a run for each.
Windows depend on the rows of their own task alone, so nothing is shuffled, and a lost
task gives the same windows again.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from sonogrid.llm.common import blocks, whole

TOKENIZER = "byte_bpe_50k.json"
CAPACITY, END = 1024, 0
#: Windows of a group, ids of a piece at most, and ids for each window that fill up what differencing leaves uneven.
GROUP, PIECE, RESERVE = 64, 512, 128

Piece = tuple[int, int, int]


def byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes bytes as letters: printable ones as themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Ids:
    """Token ids of texts as little-endian 32-bit integers.

    Pre-tokens never cross a space that a non-space follows, so a text is cut at its
    spaces and the ids of each part are remembered, the latest `most` of them. Parts of
    letters, with signs after them or a line break among them, are pre-tokens as they
    stand and go to the vocabulary's model directly; others, and texts in which white
    space follows a space or that hold an added token, are encoded in full.
    """

    ODD = re.compile(r" \s")
    SIGNS = ".,;:!?#*$%&|<>"

    def __init__(self, name: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.most, self.known = most, {}
        self.line = self.whole(["\n"])[0]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pretoken(self, text: str) -> bytes:
        found = self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))
        return b"".join([x.id.to_bytes(4, "little") for x in found])

    def part(self, space: str, text: str) -> bytes:
        """Ids of a part without spaces, with the space before it if there is one."""
        if text.isalpha():
            return self.pretoken(space + text)
        word = text.rstrip(self.SIGNS)
        if word.isalpha():
            return self.pretoken(space + word) + self.pretoken(text[len(word) :])
        # A line break between two lines that white space neither ends nor begins is a pre-token of its own.
        lines = text.split("\n")
        if len(lines) > 1 and not any(not x or x[0].isspace() or x[-1].isspace() for x in lines):
            return self.line.join([self.part(space if not k else "", x) for k, x in enumerate(lines)])
        return self.whole([space + text])[0]

    def __call__(self, text: str) -> bytes:
        if self.ODD.search(text) or any(x in text for x in self.added):
            return self.whole([text])[0]
        first, *parts = text.split(" ")
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            rest = b"".join([known[p] for p in parts])
        except KeyError:
            for p in parts:
                if p not in known:
                    known[p] = self.part(" ", p)
            rest = b"".join([known[p] for p in parts])
        return (self.part("", first) if first else b"") + rest


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """The pieces of each of `windows` near-equal windows, by largest differencing first. Empty windows are left out of the partitions until they are needed."""
    heap = [(-n, k, [(n, [k])]) for k, n in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        free = windows - len(a)
        # b's windows from the fullest on meet a's empty windows first, then a's windows from the emptiest on.
        merged = a[:] + b[:free]
        for (n, pieces), at in zip(b[free:], range(len(a) - 1, -1, -1), strict=False):
            merged[at] = (merged[at][0] + n, merged[at][1] + pieces)
        merged.sort(key=lambda w: -w[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, made, merged))
        made += 1
    return [pieces for _, pieces in heap[0][2]] if heap else []


def split(pieces: list[Piece], size: int) -> tuple[list[Piece], list[Piece]]:
    """The pieces' first `size` ids, and what is left."""
    head, rest = [], []
    for row, start, n in pieces:
        take = min(n, size)
        size -= take
        if take:
            head.append((row, start, take))
        if n > take:
            rest.append((row, start + take, n - take))
    return head, rest


def balanced(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Windows of the pieces, none over the capacity; all are full if the pieces fill a whole number of windows and the count need not rise."""
    total = sum(p[2] for p in pieces)
    if not total:
        return []
    n = -(-total // capacity)
    main, rest = split(pieces, max(0, total - n * min(RESERVE, capacity // 4)))
    sizes = [p[2] for p in main]
    while True:
        found = difference(sizes, n)
        if all(sum(sizes[k] for k in w) <= capacity for w in found):
            break
        n += 1
    windows = [[main[k] for k in w] for w in found] + [[] for _ in range(n - len(found))]
    for window in windows:
        more, rest = split(rest, capacity - sum(p[2] for p in window))
        window += more
    return [w for w in windows if w]


def tail(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Windows of the pieces that a task ends with: full ones by differencing, and the rest cut at powers of two, which need no padding."""
    total = sum(p[2] for p in pieces)
    head, rest = split(pieces, total // capacity * capacity)
    out, left = balanced(head, capacity), sum(p[2] for p in rest)
    for power in (1 << k for k in range(left.bit_length() - 1, -1, -1)):
        if left & power:
            window, rest = split(rest, power)
            out.append(window)
    return out


def packing(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, group: int = GROUP, piece: int = PIECE) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    Every row of docs, also with a null or repeated doc_id, is a document of its own: its ids and then id 0, so that
    null and empty texts have one id. sequence_id holds the task's number in its high bits. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(tokenizer)
        number, waiting, waiting_size = TaskContext.get().partitionId() << 33, [], 0
        open_rows: list[tuple[object, bytes]] = []

        def emit(windows: list[list[Piece]], rows: list[tuple[object, bytes]]) -> pa.RecordBatch:
            nonlocal number
            out: list[list] = [[] for _ in range(7)]
            for window in windows:
                at = 0
                for row, start, size in window:
                    doc_id, raw = rows[row]
                    for column, v in zip(out, (doc_id, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), len(raw) // 4, number, at), strict=True):
                        column.append(v)
                    at += size
                number += 1
            return pa.RecordBatch.from_arrays([pa.array(out[0], doc_type), *(pa.array(x, pa.int64()) for x in out[1:])], names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        doc_type = None
        for part, texts in blocks(batches, most=1 << 20):
            doc_type = part.schema.field("doc_id").type
            full = []
            for doc_id, text in zip(part["doc_id"].to_pylist(), texts, strict=True):
                raw = ids(text) + END.to_bytes(4, "little")
                n, row = len(raw) // 4, len(open_rows)
                open_rows.append((doc_id, raw))
                whole_windows = n // capacity * capacity
                full += [[(row, s, capacity)] for s in range(0, whole_windows, capacity)]
                for s in range(whole_windows, n, piece):
                    waiting.append((row, s, min(piece, n - s)))
                waiting_size += n - whole_windows
            yield emit(full, open_rows)
            while waiting_size >= group * capacity:
                head, rest = split(waiting, group * capacity)
                yield emit(balanced(head, capacity), open_rows)
                waiting, waiting_size = rest, waiting_size - sum(p[2] for p in head)
            kept = sorted({p[0] for p in waiting})
            at = {row: k for k, row in enumerate(kept)}
            open_rows = [open_rows[row] for row in kept]
            waiting = [(at[row], start, size) for row, start, size in waiting]
        if doc_type is not None:
            yield emit(tail(waiting, capacity), open_rows)

    return whole(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
