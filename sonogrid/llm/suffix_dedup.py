"""Operator 7: removal of repeated byte strings by suffix arrays.

Documents are dealt into shards; copies of a whole text by a larger doc_id are removed
as such. Anchors are chosen by content, so that equal strings of LENGTH bytes have the
same anchors: of the hashes of GRAM bytes in the string, the smallest. The context of an
anchor is as far as such strings with it reach. Anchors with their contexts' hashes meet
in one shuffle: an anchor that one document alone has can't lie in a repeated string; a
context that a smaller document has is a range to remove; and where an anchor has
several contexts, one of each goes to a suffix shard. That sorts their suffixes by
Larsson-Sadakane refinement, finds common prefixes by Kasai's rule, and each run of
suffixes that share LENGTH bytes tells the smallest document. An anchor of very many
contexts is dealt over several suffix shards; their sorted strings are merged, and
each shard finds the smallest document of its own strings in the merged ones by binary
search. The ranges found go back to the documents' shards.

Text is shuffled once, and that exchange serves all three visits to it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonogrid.llm.common import written

LENGTH, GRAM = 50, 20
#: Bytes of text in a shard, and contexts of an anchor in a suffix shard.
SHARD_BYTES, HOT = 4 << 20, 8192
#: Bytes of text whose anchors are found at a time, and suffix shards for each shard of text: both keep the work in a core's cache.
BLOCK_BYTES, FINER = 1 << 16, 8
#: Texts of more than this share of all rows (one in so many) are broadcast: there are at most as many of them.
HEAVY = 10_000
#: Shards whose anchors tell which ones are common: those seen so many times there and that many times, at that rate, in all shards. They are few (a shard has a bounded number of anchors) and broadcast.
SEEN_SHARDS, SEEN, COMMON = 8, 16, 16_384
#: Suffix shards of hot anchors have numbers from here on.
HOT_BUCKET = 1 << 62
PRIMES = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * PRIMES[0]
    return h ^ h >> np.uint64(29)


def string_hashes(b: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the strings of each size from each place on, put together from strings of powers of two."""
    powers, out = {1: b.astype(np.uint64)}, []
    for size in sizes:
        total, whole = 0, None
        for k in reversed(range(size.bit_length())):
            if not size >> k & 1:
                continue
            for j in range(k):
                if 2 << j not in powers:
                    x = powers[1 << j]
                    powers[2 << j] = x[: -(1 << j)] * PRIMES[j % 5] + x[1 << j :]
            part = powers[1 << k][total:]
            whole = part if whole is None else whole[: len(part)] * PRIMES[(k + 1) % 5] + part
            total += 1 << k
        out.append(mixed(whole))
    return out


def sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """of over each `width` successive values."""
    span = 1
    while 2 * span <= width:
        x = of(x[:-span], x[span:])
        span *= 2
    return of(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(b: np.ndarray, lengths: np.ndarray, length: int, most: int = BLOCK_BYTES) -> list[np.ndarray]:
    """What block_anchors() gives, over blocks of `most` bytes of whole texts (one at least)."""
    ends, out, at = np.cumsum(lengths), [block_anchors(b[:0], lengths[:0], length)], 0
    while at < len(lengths):
        start = int(ends[at] - lengths[at])
        end = max(at + 1, int(np.searchsorted(ends, start + most, "right")))
        hashes, row, context, lo, hi = block_anchors(b[start : ends[end - 1]], lengths[at:end], length)
        out.append((hashes, row + at, context, lo + start, hi + start))
        at = end
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def block_anchors(b: np.ndarray, lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in texts laid end to end: hashes that are the smallest of some string of `length` bytes within a text.

    Returns the anchors' hashes, the rows of their texts, their contexts' hashes, and where in b these start and end.
    """
    width, reach = length - GRAM + 1, 2 * length - GRAM
    if len(b) < length:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    (h,) = string_hashes(b, (GRAM,))
    least = sliding(h, width, np.minimum)
    ends = np.cumsum(lengths)
    row_end = np.repeat(ends, lengths)[: len(least)]
    least = np.where(np.arange(len(least)) + length <= row_end, least, np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    at = np.flatnonzero((most == h) & (most > 0))
    row = np.searchsorted(ends, at, "right")
    lo, hi = np.maximum(at - (length - GRAM), (ends - lengths)[row]), np.minimum(at + length, ends[row])
    context = np.zeros(len(at), np.uint64)
    full = hi - lo == reach
    if full.any():
        (whole,) = string_hashes(b, (reach,))
        context[full] = whole[lo[full]]
    raw = b.tobytes()
    for k in np.flatnonzero(~full).tolist():
        context[k] = int.from_bytes(hashlib.blake2b(raw[lo[k] : hi[k]], digest_size=8).digest(), "little")
    return h[at], row, context, lo, hi


def suffixes(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of b sorted by their first `length` (over 32, under 65) bytes, and ranks: the place of the first suffix with the same ones.

    Suffixes start out sorted by eight bytes. Larsson-Sadakane: sorted groups of one
    stay as they are; in the others, the rank of the suffix h places on decides next.
    """
    n = len(b)
    padded = np.concatenate([b, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    head = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    for step in (8, 16, length - 32):
        single = head & np.concatenate((head[1:], [True]))
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        some = order[slots]
        after = some + step
        key2 = rank[some] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        sort = np.argsort(key2, kind="stable")
        some, key2 = some[sort], key2[sort]
        order[slots] = some
        head[slots] = np.concatenate(([True], key2[1:] != key2[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    return order, rank


def common_prefixes(b: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place in the order, the bytes that its suffix shares with the one before it, up to `most`.

    Kasai: in text order the length falls by one at most. Where the bytes before both
    suffixes are equal it falls by just one, and only the other places are compared;
    those are compared eight bytes at a time.
    """
    n, words = len(b), -(-most // 8)
    padded = np.concatenate([b, np.zeros(8 * (words + 1), np.uint8)])
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    same_left = (at > 0) & (before > 0)
    same_left[same_left] = b[at[same_left] - 1] == b[before[same_left] - 1]
    # A place follows from the one to its left only if that one's neighbour is the left neighbour of its own.
    same_left[1:] &= before[:-1] == before[1:] - 1
    same_left[0] = False
    todo = np.flatnonzero(~same_left & (before >= 0))
    length = np.zeros(n, np.int64)
    value = np.lib.stride_tricks.as_strided(padded, (n + 8 * words, 8), (1, 1))
    for w in range(words):
        x = np.ascontiguousarray(value[todo + 8 * w]).view("<u8").ravel() ^ np.ascontiguousarray(value[before[todo] + 8 * w]).view("<u8").ravel()
        low = x & (~x + np.uint64(1))
        length[todo] += np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        todo = todo[x == 0]
    known = np.maximum.accumulate(np.where(same_left, -1, at))
    length = np.maximum(length[known] - (at - known), 0)
    # A value that was cut at `most` says no more about the places after it than this.
    short = np.flatnonzero(same_left & (length < most) & (length + (at - known) >= 8 * words))
    for w in range(words):
        if not len(short):
            break
        if w == 0:
            length[short] = 0
        x = np.ascontiguousarray(value[short + 8 * w]).view("<u8").ravel() ^ np.ascontiguousarray(value[before[short] + 8 * w]).view("<u8").ravel()
        low = x & (~x + np.uint64(1))
        length[short] += np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        short = short[x == 0]
    room = n - np.maximum(at, np.maximum(before, 0))
    return np.minimum(np.minimum(length, room), most)[order]


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with their texts compressed, for the shuffle: better than its own codec does."""
    codec = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = pa.array([codec.compress(x) for x in batch["raw"].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([texts if n == "raw" else batch[n] for n in batch.schema.names], batch.schema.names)


def shard_rows(table: pa.Table) -> list[tuple[int, bytes, int]]:
    """Id, text and tag of the rows of a shard, in order."""
    codec = zstandard.ZstdDecompressor()
    return sorted((i, codec.decompress(x), tag) for i, x, tag in zip(*(table[c].to_pylist() for c in ("doc_id", "raw", "tag")), strict=True))


class Shard:
    """Rows of a shard in order, and their anchors; rows that are alike are interchangeable. Whole copies have no anchors."""

    def __init__(self, table: pa.Table, copies: set[int], length: int):
        rows = shard_rows(table)
        self.ids, self.raw = np.array([r[0] for r in rows], dtype=np.int64), [r[1] for r in rows]
        self.copy = [r[2] in copies for r in rows]
        used = [b"" if c else r for r, c in zip(self.raw, self.copy, strict=True)]
        lengths = np.array([len(r) for r in used], dtype=np.int64)
        self.b = np.frombuffer(b"".join(used), np.uint8)
        hashes, self.row, context, lo, hi = anchors(self.b, lengths, length)
        self.hash, self.context = hashes.view(np.int64), context.view(np.int64)
        self.base = (np.cumsum(lengths) - lengths)[self.row] if len(self.row) else self.row
        self.lo, self.hi = lo, hi
        self.key = self.hash ^ self.context
        # The first place of a key in a shard is in its smallest document.
        self.distinct, self.first, self.number = np.unique(self.key, return_index=True, return_inverse=True)


def marked(table: pa.Table) -> set[int]:
    return {x for x in table["copy"].to_pylist() if x is not None}


def own_anchors(length: int):
    """Distinct anchors and contexts of a shard, each with the smallest document that has it."""

    def run(table: pa.Table, copies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("hash", "context", "doc")})
        shard = Shard(table, marked(copies), length)
        return pa.table({"hash": shard.hash[shard.first], "context": shard.context[shard.first], "doc": shard.ids[shard.row[shard.first]]})

    return run


CONTEXT = "bucket long, first long, ctx binary, shard long, row int, lo int, hi int, places binary"


def contexts(length: int, buckets: int):
    """Of a shard's anchors: contexts that suffix shards have to compare, and ranges (ctx null) of contexts that a smaller document is known to have.

    shared tells, by key, how many suffix shards the anchor has; 0: a smaller document has the context. A context that
    a text has at many places, as in long runs of a byte, is sent once with all its places (32-bit integers).
    """

    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        out: dict[str, list] = {k.split()[0]: [] for k in CONTEXT.split(", ")}
        if table.num_rows:
            number = table["shard"][0].as_py()
            shard = Shard(table, marked(shared), length)
            known = shared.filter(shared["key"].is_valid())
            keys, salts = known["key"].to_numpy(), known["salts"].to_numpy()
            order = np.argsort(keys, kind="stable")
            keys, salts = keys[order], salts[order]
            salt = np.full(len(shard.distinct), -1)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, shard.distinct), len(keys) - 1)
                salt = np.where(keys[at] == shard.distinct, salts[at], -1)
            salt, doc = salt[shard.number], shard.ids[shard.row]
            later = doc > doc[shard.first][shard.number]
            gone = np.flatnonzero(later | (salt == 0))
            lo, hi, row = (shard.lo - shard.base)[gone], (shard.hi - shard.base)[gone], shard.row[gone]
            new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])))) if len(gone) else gone
            last = np.concatenate((new[1:], [len(gone)])) - 1 if len(gone) else gone
            for r, x, y in zip(row[new].tolist(), lo[new].tolist(), hi[last].tolist(), strict=True):
                for column, v in zip(out.values(), (-1 - number, None, None, number, r, x, y, None), strict=True):
                    column.append(v)
            raw = shard.b.tobytes()
            sent = np.flatnonzero(~later & (salt > 0))
            sent = sent[np.lexsort((sent, shard.row[sent], shard.number[sent]))]
            head = np.flatnonzero(np.concatenate(([True], (shard.number[sent][1:] != shard.number[sent][:-1]) | (shard.row[sent][1:] != shard.row[sent][:-1])))) if len(sent) else sent
            starts = (shard.lo - shard.base)[sent].astype("<i4").tobytes()
            for at, after in zip(head.tolist(), [*head[1:].tolist(), len(sent)], strict=True):
                k = int(sent[at])
                code, x, y = int(shard.hash[k]), int(shard.lo[k]), int(shard.hi[k])
                ctx = raw[x:y]
                bucket = code % buckets if salt[k] < 2 else HOT_BUCKET | ((code ^ (zlib.crc32(ctx) % int(salt[k]) * 0x9E3779B97F4A7C15)) & (HOT_BUCKET - 1))
                for column, v in zip(out.values(), (bucket, int(doc[k]), ctx, number, int(shard.row[k]), None, None, starts[4 * at : 4 * after]), strict=True):
                    column.append(v)
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

    return run


class SuffixShard:
    """Runs of equal strings among the contexts of a suffix shard: sorted by run, the strings' places (b), contexts and run numbers; each run's smallest document."""

    def __init__(self, table: pa.Table, length: int):
        ctx = table["ctx"].to_pylist()
        self.firsts = table["first"].to_numpy()
        sizes = np.array([len(c) for c in ctx], dtype=np.int64)
        self.b = np.frombuffer(b"".join(ctx), np.uint8)
        self.starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(ctx)), sizes)
        order, _ = suffixes(self.b, length)
        run = np.cumsum(common_prefixes(self.b, order, length) < length)
        inside = order - self.starts[owner[order]] + length <= sizes[owner[order]]
        self.at, run = order[inside], run[inside]
        self.owner = owner[self.at]
        self.head = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        self.run = np.cumsum(np.concatenate(([True], run[1:] != run[:-1]))) - 1
        self.least = np.minimum.reduceat(self.firsts[self.owner], self.head)
        self.length = length

    def strings(self) -> np.ndarray:
        """Each run's string, in order, with a byte added so that numpy keeps zeros at its end."""
        at = self.at[self.head]
        out = np.ones((len(at), self.length + 1), np.uint8)
        out[:, :-1] = self.b[at[:, None] + np.arange(self.length)]
        return out.view(f"S{self.length + 1}").ravel()

    def merge(self, strings: np.ndarray, least: np.ndarray) -> None:
        """Takes in other shards' smallest documents of strings, which are sorted, by binary search."""
        own = self.strings()
        at = np.minimum(np.searchsorted(strings, own), len(strings) - 1)
        hit = strings[at] == own
        self.least[hit] = np.minimum(self.least[hit], least[at[hit]])

    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Contexts with strings that a smaller document has, and what these cover; strings of one context overlap, so that is one range."""
        hit = self.least[self.run] < self.firsts[self.owner]
        owner, place = self.owner[hit], (self.at - self.starts[self.owner])[hit]
        found = np.unique(owner)
        lo = np.full(len(self.starts), 1 << 30)
        hi = np.zeros(len(self.starts), np.int64)
        np.minimum.at(lo, owner, place)
        np.maximum.at(hi, owner, place + self.length)
        return found, lo[found], hi[found]


def hot_strings(length: int):
    """For suffix shards of hot anchors: each string and the smallest document that this shard knows for it."""

    def run(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < HOT_BUCKET:
            return pa.table({"bucket": pa.array([], pa.int64()), "string": pa.array([], pa.binary()), "least": pa.array([], pa.int64())})
        shard = SuffixShard(table, length)
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()] * len(shard.least), pa.int64()), "string": pa.array(shard.strings().tolist(), pa.binary()), "least": shard.least})

    return run


RANGE = "shard long, row int, lo int, hi int"


def joined(shard: np.ndarray, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
    """Ranges of texts, those of a text that touch made one."""
    order = np.lexsort((lo, row, shard))
    shard, row, lo, hi = shard[order], row[order], lo[order], hi[order]
    text = np.cumsum(np.concatenate(([0], (shard[1:] != shard[:-1]) | (row[1:] != row[:-1])))) if len(order) else order
    # Ends are kept apart by text, so that one running maximum serves all texts.
    reach = np.maximum.accumulate(hi + (text << 32)) if len(order) else hi
    new = np.flatnonzero(np.concatenate(([True], lo[1:] + (text[1:] << 32) > reach[:-1]))) if len(order) else order
    last = np.concatenate((new[1:], [len(order)])) - 1 if len(order) else order
    return pa.table({"shard": shard[new], "row": pa.array(row[new], pa.int32()), "lo": pa.array(lo[new], pa.int32()), "hi": pa.array(reach[last] & 0xFFFFFFFF, pa.int32())})


def found_ranges(length: int):
    """Ranges of texts (shard, row) that smaller documents have."""

    def run(table: pa.Table, hot: pa.Table) -> pa.Table:
        columns = ["shard", "row", "lo", "hi"]
        if not table.num_rows or table["bucket"][0].as_py() < 0:
            return table.select(columns)
        shard = SuffixShard(table, length)
        if hot.num_rows:
            strings = np.array(hot["string"].to_pylist(), dtype=f"S{length + 1}")
            order = np.argsort(strings)
            shard.merge(strings[order], hot["least"].to_numpy()[order])
        owner, lo, hi = shard.ranges()
        places = [np.frombuffer(x, "<i4") for x in table["places"].take(pa.array(owner)).to_pylist()]
        n = [len(x) for x in places]
        base = np.concatenate([*places, np.zeros(0, np.int32)]).astype(np.int64)
        text = np.repeat(owner, n)
        return joined(table["shard"].to_numpy()[text], table["row"].to_numpy()[text], base + np.repeat(lo, n), base + np.repeat(hi, n))

    return run


PACKED = "shard long, doc_id long, raw binary, tag long"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removal(length: int, keep_text: bool):
    """The texts of a shard without the ranges, and whole copies without anything."""

    def run(table: pa.Table, ranges: pa.Table) -> pa.Table:
        copies, by_row = marked(ranges), {}
        rows = shard_rows(table)
        for row, lo, hi in sorted(x for x in zip(*(ranges[c].to_pylist() for c in ("row", "lo", "hi")), strict=True) if x[0] is not None):
            spans = by_row.setdefault(row, [])
            if spans and spans[-1][1] >= lo:
                spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
            else:
                spans.append((lo, hi))
        out: dict[str, list] = {k.split()[0]: [] for k in RESULT.split(", ")}
        texts = []
        for r, (doc_id, text, tag) in enumerate(rows):
            spans, parts, at = [(0, len(text))] if tag in copies else by_row.get(r, []), [], 0
            for lo, hi in spans:
                parts.append(text[at:lo])
                at = hi
            kept = b"".join([*parts, text[at:]])
            texts.append(kept)
            for column, v in zip(out.values(), (doc_id, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(v)
        found = pa.table({k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()})
        return found.append_column("kept", pa.array(texts, pa.binary())) if keep_text else found

    return run


def whole_copies(rows: DataFrame, length: int, heavy: int) -> DataFrame:
    """shard and tag of rows whose whole text a smaller document has.

    Texts of more than `heavy` rows, of which there are few, are broadcast to their rows; the others meet them in a shuffle.
    """
    texts = rows.where(F.length("raw") >= length).select("shard", "doc_id", "tag", F.unhex(F.sha2("raw", 256)).alias("sha"))
    again = written(texts.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").select("sha", "first", F.col("n") > heavy))
    again = again.toDF("sha", "first", "heavy")
    many, few = again.where("heavy").select("sha", F.col("first").alias("known")), again.where("NOT heavy").select("sha", "first")
    told = texts.join(F.broadcast(many), "sha", "left")
    rest = told.where("known IS NULL").select("shard", "doc_id", "tag", "sha").join(few, "sha")
    found = told.where("known IS NOT NULL").select("shard", "doc_id", "tag", F.col("known").alias("first")).unionByName(rest.select("shard", "doc_id", "tag", "first"))
    return found.where("doc_id > first").select("shard", F.col("tag").alias("copy"))


def common_anchors(seen: DataFrame, shards: int) -> DataFrame:
    """hash and expected (rows in all shards) of anchors that are common, by what SEEN_SHARDS of the shards have."""
    expected = F.floor(F.col("seen") * max(1.0, shards / SEEN_SHARDS)).alias("expected")
    return seen.groupBy("hash").agg(F.count("*").alias("seen")).where(F.col("seen") >= SEEN).select("hash", expected).where(F.col("expected") >= COMMON)


def shared_anchors(found: DataFrame, common: DataFrame, hot: int) -> DataFrame:
    """doc, hash, context and salts of the rows of found (hash, context, doc: one for each shard, anchor and context) whose strings other documents may have; see contexts().

    The rows of an anchor meet in a task, but those of common ones (hash, expected) by context, of which a shard has one row;
    these are taken to have other contexts, and their number is the expected one: that only deals the work.
    """
    common = F.broadcast(common)
    rows = found.join(common.select("hash", F.lit(True).alias("_often")), "hash", "left").select("hash", "context", "doc", F.when(F.col("_often"), F.col("context")).alias("apart"))
    anchor, same = Window.partitionBy("hash", "apart"), Window.partitionBy("hash", "apart", "context")
    told = rows.select("hash", "context", "doc", "apart", F.count("*").over(anchor).alias("n"), F.min("context").over(anchor).alias("c1"), F.max("context").over(anchor).alias("c2"), F.min("doc").over(same).alias("least"))
    # Whoever has the smallest document of a context stands for it where the anchor has others.
    told = told.where("apart IS NOT NULL OR (n > 1 AND (doc > least OR c1 <> c2))").join(common, "hash", "left")
    salts = F.when(F.col("doc") > F.col("least"), 0).otherwise(F.ceil(F.coalesce("expected", "n") / hot)).cast("int")
    return told.select("doc", "hash", "context", salts.alias("salts"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot: int = HOT, keep_text: bool = False) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans and kept_sha256; with keep_text also the bytes kept.

    doc_id is an integer. A null text counts as empty. Rows with a null doc_id have no
    order: nothing is removed from them or for their sake. Rows with the same doc_id are
    judged one by one and don't count against each other. Other columns are not read.
    """
    if not 33 <= length <= 64:
        raise ValueError("length must be 33 to 64")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    size, n = rows.agg(F.sum(F.length("raw")), F.count("*")).first()
    shards = max(1, -(-(size or 0) // shard_bytes))
    shard_of = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).alias("shard")
    some = rows.where("doc_id IS NOT NULL").select(shard_of("doc_id"), "doc_id", "raw", F.xxhash64("doc_id", "raw").alias("tag"))
    copies = written(whole_copies(some, length, n // HEAVY))
    anchors_of = lambda x: x.groupBy("shard").cogroup(copies.groupBy("shard")).applyInArrow(own_anchors(length), "hash long, context long, doc long")
    common = written(common_anchors(anchors_of(some.where(F.col("shard") < SEEN_SHARDS).mapInArrow(packed, PACKED)), shards))
    some = some.mapInArrow(packed, PACKED)
    told = shared_anchors(anchors_of(some), common, hot)
    shared = told.select(shard_of("doc"), F.col("hash").bitwiseXOR(F.col("context")).alias("key"), "salts").unionByName(copies, allowMissingColumns=True)
    cut = some.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(contexts(length, FINER * shards), CONTEXT)
    strings = cut.groupBy("bucket").applyInArrow(hot_strings(length), "bucket long, string binary, least long")
    # A string that one shard alone has needs no merging.
    same = Window.partitionBy("string")
    merged = strings.select("bucket", "string", F.min("least").over(same).alias("least"), F.count("*").over(same).alias("n")).where("n > 1").drop("n")
    ranges = cut.groupBy("bucket").cogroup(merged.groupBy("bucket")).applyInArrow(found_ranges(length), RANGE).unionByName(copies, allowMissingColumns=True)
    out = some.groupBy("shard").cogroup(ranges.groupBy("shard")).applyInArrow(removal(length, keep_text), RESULT + ", kept binary" * keep_text)
    rest = rows.where("doc_id IS NULL").select("doc_id", F.length("raw").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("raw", 256).alias("kept_sha256"), *[F.col("raw").alias("kept")] * keep_text)
    return out.unionByName(rest)
