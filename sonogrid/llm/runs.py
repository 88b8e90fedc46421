"""Operator 11: runs of repeated words, by Crochemore's partition refinement.

The places of a text fall into classes of equal factors of a length, and the length
grows by one. A class is split by the classes of the places that follow its own, and
only those of classes that came off as smaller ones (all children but a largest) are
asked: a place is asked a logarithm of its text's length times. Members of a class
stand in a list by place; neighbours in it whose distance is the length are the starts
of a square of a primitive root, and starts in a row make a run. A run that counts
holds its period four times, so each of its starts has two others in its class:
smaller classes are dropped.

All texts of a block are refined in step, by numpy; classes never cross texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sonogrid.llm.common import blocks, whole

#: Words of a run at least, and how often it holds its period at least.
LEAST, TIMES = 6, 4
#: Members of a class that can hold a start of such a run.
MEMBERS = 3
#: Bytes of text that are refined together, at least one text.
BLOCK = 1 << 22


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[k] to starts[k] + lengths[k] - 1 of all k, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Classes:
    """Places of all texts of a block by equal factors of a length.

    `order` holds the members of a class side by side, `where` is a place's position in it; `before` and
    `after` are a place's neighbours in its class (-1: none), and a place that is dropped has class -1.
    """

    def __init__(self, words: np.ndarray, texts: np.ndarray):
        """words: the word of each place, -1 after the end of each text. texts: the text of each place."""
        n = len(words)
        self.label, self.where = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.before, self.after = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.due: dict[int, list[np.ndarray]] = defaultdict(list)
        real = np.flatnonzero(words >= 0)
        self.order = real[np.lexsort((real, words[real], texts[real]))]
        w, t = words[self.order], texts[self.order]
        heads = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (t[1:] != t[:-1])))) if len(real) else np.zeros(0, np.int64)
        size = np.diff(np.append(heads, len(real)))
        self.start, self.size, self.count = np.zeros(2 * n + 2, np.int64), np.zeros(2 * n + 2, np.int64), len(heads)
        self.start[: len(heads)], self.size[: len(heads)] = heads, size
        self.label[self.order] = np.repeat(np.arange(len(heads)), size)
        self.where[self.order] = np.arange(len(real))
        self.chain(self.order, self.label[self.order], 0)
        #: Places whose class came off as a smaller one, or that were dropped: at first all.
        small = np.flatnonzero(size < MEMBERS)
        self.label[self.order[ranges(heads[small], size[small])]] = -1
        self.active = int(size[size >= MEMBERS].sum())
        self.moved = np.arange(n)

    def chain(self, places: np.ndarray, classes: np.ndarray, length: int) -> None:
        """Members of classes, sorted by class and place, become neighbours."""
        same = classes[1:] == classes[:-1]
        a, b = places[:-1][same], places[1:][same]
        self.before[places], self.after[places] = -1, -1
        self.after[a], self.before[b] = b, a
        self.await_(a, b - a, length)

    def await_(self, places: np.ndarray, gaps: np.ndarray, length: int) -> None:
        """Keeps places for the length that is their distance to the next one."""
        later = gaps > length
        places, gaps = places[later], gaps[later]
        if not len(places):
            return
        if len(places) > 1:
            by = np.argsort(gaps, kind="stable")
            places, gaps = places[by], gaps[by]
        cut = np.flatnonzero(gaps[1:] != gaps[:-1]) + 1
        for gap, part in zip(gaps[np.concatenate(([0], cut))].tolist(), np.split(places, cut), strict=True):
            self.due[gap].append(part)

    def squares(self, length: int) -> np.ndarray:
        """Places whose next one in their class is `length` away, in order."""
        found = self.due.pop(length, None)
        if not found:
            return np.zeros(0, np.int64)
        at = np.unique(np.concatenate(found))
        return at[(self.label[at] >= 0) & (self.after[at] - at == length)]

    def refine(self, length: int) -> None:
        """From classes of factors of `length` words to those of one more."""
        asked = self.moved[self.moved > 0] - 1
        asked = asked[self.label[asked] >= 0]
        if not len(asked):
            self.moved = asked
            return
        parent, key = self.label[asked], self.label[asked + 1]
        by = np.lexsort((asked, key, parent))
        asked, parent, key = asked[by], parent[by], key[by]
        head = np.concatenate(([True], parent[1:] != parent[:-1]))
        first = np.flatnonzero(head)
        parents, taken = parent[first], np.diff(np.append(first, len(asked)))
        rest = self.size[parents] - taken
        # Those that are asked leave the list and the front of their class's stretch of `order`.
        self.unlink(asked, parent, rest, taken, length)
        front = self.start[parents] + rest
        self.settle(asked, np.repeat(front, taken), ranges(front, taken))
        group = np.flatnonzero(head | np.concatenate(([True], key[1:] != key[:-1])))
        sizes, of = np.diff(np.append(group, len(asked))), np.cumsum(head)[group] - 1
        kept = (key[group] >= 0) & (sizes >= MEMBERS)
        new = np.where(kept, self.count + np.cumsum(kept) - 1, -1)
        self.count += int(kept.sum())
        if self.count > len(self.start) - 1:
            self.start, self.size = (np.concatenate([x, np.zeros(max(len(x), self.count), np.int64)]) for x in (self.start, self.size))
        self.start[new[kept]], self.size[new[kept]] = self.where[asked[group[kept]]], sizes[kept]
        label = np.repeat(new, sizes)
        self.label[asked] = label
        stay = label >= 0
        self.chain(asked[stay], label[stay], length)
        # The smaller children: all but one of the largest, which is what was left or a group of those asked.
        self.size[parents] = rest
        largest = np.zeros(len(parents), np.int64)
        np.maximum.at(largest, of, np.where(kept, sizes, 0))
        left_over = (rest >= largest) & (rest >= MEMBERS)
        top = np.full(len(parents), len(group))
        best = np.flatnonzero(kept & (sizes == largest[of]) & ~left_over[of])
        np.minimum.at(top, of[best], best)
        come_off = np.ones(len(group), bool)
        come_off[top[top < len(group)]] = False
        few = (rest > 0) & ~left_over
        others = self.order[ranges(self.start[parents[few]], rest[few])]
        dropped = np.repeat((rest < MEMBERS)[few], rest[few])
        self.label[others[dropped]] = -1
        self.active -= int(dropped.sum()) + len(asked) - int(stay.sum())
        self.moved = np.concatenate([asked[np.repeat(come_off, sizes)], others])

    def unlink(self, asked: np.ndarray, parent: np.ndarray, rest: np.ndarray, taken: np.ndarray, length: int) -> None:
        """Takes places, sorted by class, out of their lists; those that stay on either side become neighbours."""
        by = np.lexsort((asked, parent))
        out, some = asked[by], np.repeat(rest > 0, taken)
        out = out[some]
        if not len(out):
            return
        joined = self.after[out[:-1]] == out[1:]
        left, right = self.before[out[np.concatenate(([True], ~joined))]], self.after[out[np.concatenate((~joined, [True]))]]
        self.after[left[left >= 0]] = right[left >= 0]
        self.before[right[right >= 0]] = left[right >= 0]
        both = (left >= 0) & (right >= 0)
        self.await_(left[both], right[both] - left[both], length)

    def settle(self, asked: np.ndarray, front: np.ndarray, slots: np.ndarray) -> None:
        """Moves places to the slots at the end of their classes' stretches; those that stood there go where these come from."""
        at = self.where[asked]
        outside = at < front
        self.label[asked] = -2
        inside = self.order[slots]
        stayed = inside[self.label[inside] != -2]
        holes = at[outside]
        self.order[holes], self.where[stayed] = stayed, holes
        self.order[slots], self.where[asked] = asked, slots


def starts_of_squares(words: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Lengths and the places (in the texts one after the other, a place between them) of squares of that length."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    most = int(lengths.max(initial=0)) // TIMES
    if most < 1:
        return
    classes = Classes(np.concatenate([np.append(w, -1) for w in words]), np.repeat(np.arange(len(words)), lengths + 1))
    for length in range(1, most + 1):
        if not classes.active:
            return
        if len(at := classes.squares(length)):
            yield length, at
        classes.refine(length)


def runs_of(words: list[np.ndarray], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Of texts given as numbers of words: their runs (start, length, period), by start and period."""
    begin = np.cumsum([0, *(len(w) + 1 for w in words)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for period, at in starts_of_squares(words):
        cut = np.flatnonzero(np.diff(at) != 1)
        first, last = at[np.concatenate(([0], cut + 1))], at[np.append(cut, len(at) - 1)]
        length = last - first + 2 * period
        ok = length >= max(least, TIMES * period)
        for s, k in zip(first[ok].tolist(), length[ok].tolist(), strict=True):
            text = int(np.searchsorted(begin, s, "right")) - 1
            out[text].append((s - int(begin[text]), k, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def repeating(words: list[bytes], h: int) -> list[bytes]:
    """The words that the query judges: those of one text in ten go round and round from a place on."""
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The places that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.flatnonzero(np.cumsum(depth[:n]) == 0)


FIELDS = ["n_runs", "start", "length", "period", "exponent_milli"]


def periodic_runs(docs: DataFrame, prepare=lambda doc_id, words: words, block: int = BLOCK) -> DataFrame:
    """doc_id, words (after prepare), runs (start, length, period of each, by start and period) and kept (the numbers of the words that stay once repeats go) of each row.

    Words are runs of anything but ASCII white space. A null text is an empty one, and a text without words or with fewer than six
    has no runs. Rows with a null or repeated doc_id are judged one by one; other columns are not read.
    A block of texts, or one long text, is held by a task at a time; one partition needs no other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, runs in judged(batches, prepare, block):
            columns = [ids, pa.array(words, pa.list_(pa.binary())), pa.array([[{"start": s, "length": k, "period": p} for s, k, p in r] for r in runs], RUNS), pa.array([kept(len(w), r) for w, r in zip(words, runs, strict=True)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "words", "runs", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, words array<binary>, runs array<struct<start: long, length: long, period: long>>, kept array<long>")


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def judged(batches: Iterator[pa.RecordBatch], prepare, block: int) -> Iterator[tuple[pa.Array, list[list[bytes]], list[list[tuple[int, int, int]]]]]:
    """The ids, words and runs of blocks of rows."""
    for part, texts in blocks(batches, most=block):
        words = [prepare(i, t.encode("utf-8", "surrogatepass").split()) for i, t in zip(part["doc_id"].to_pylist(), texts, strict=True)]
        numbers: dict[bytes, int] = {}
        number = numbers.setdefault
        coded = [np.array([number(w, len(numbers)) for w in x], dtype=np.int64) for x in words]
        yield part["doc_id"], words, runs_of(coded)


def hashed_id(doc_id) -> int:
    """The crc32 of an id as text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def run_digests(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, n_runs, the longest run (ties: least start, then period; nulls without a run), and the hashes of all runs and of the words kept. One text in ten, by its id, is made periodic first. Odd rows are as in periodic_runs()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, runs in judged(batches, lambda i, w: repeating(w, hashed_id(i)), block):
            rows = []
            for w, r in zip(words, runs, strict=True):
                s, k, p = min(r, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
                left = w if not r else [w[i] for i in kept(len(w), r).tolist()]
                listed = "".join(f"{a},{b},{c}\n" for a, b, c in r)
                rows.append((len(r), s, k, p, None if s is None else 1000 * k // p, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()))
            kinds = [pa.int64()] * len(FIELDS) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *FIELDS, "runs_sha256", "collapsed_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return whole(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in FIELDS) + ", runs_sha256 string, collapsed_sha256 string")
