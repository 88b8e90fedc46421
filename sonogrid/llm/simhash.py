"""Operator 8: SimHash near-duplicates by tiled exact comparison.

Two fingerprints within the radius r agree in e of any r + e blocks of their bits, so
the comparison is laid out in tables, one for each choice of e blocks, and in buckets
of equal bits. Within a bucket the distinct fingerprints, sorted by their population
count, are compared tile by tile by exclusive-or and bit counts; tiles whose counts
differ by more than the radius are skipped. Buckets with more than TILE rows are dealt
out as pairs of tiles. What a task finds leaves it as a forest of its links.

For similarities that need a radius of many bits, near_duplicates() takes wide
fingerprints of sets of shingles, whose share of differing bits tells the similarity
closely, and buckets of equal lanes of bits. Lanes widen with the number of sets, so that
buckets stay about as large, and grow in number, so that pairs at the similarity share
one: by simulation all but 0.03 % with 50 lanes of 12 bits, all but 0.8 % for 10^9 sets. Sets of at most SMALL shingles also meet by the
first shingles of each, of which similar sets share one at least. What is found are
candidates: a link counts if the Jaccard similarity of the two sets says so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonogrid.llm.common import LOWER, blocks, copies_join, whole, written
from sonogrid.llm.components import Links, components, forest

SHINGLE, RADIUS, EQUAL, TILE, SEED = 3, 3, 2, 4096, 42
#: Words of 64 bits in a wide fingerprint, bits of a lane at least, and the share of pairs at the similarity that may have no equal lane.
WIDE, LANE, MISS = 10, 12, 6e-4
#: Words of a wide fingerprint that are compared with each other: what they let through is checked by the sets.
COMPARED = 4
#: Shingles of a set that is compared by its first ones too, and rows of a component's tile.
SMALL, MEMBERS = 24, 512
#: Tasks over which the rows of one component or vertex are dealt, and sets whose texts are looked up by a broadcast at most.
SALTS, FEW = 16, 1 << 18


def shingle_hashes(text: str, shingle: int) -> list[int]:
    """XXH64 of the shingles of a text, repeats included; of all its words if they are fewer."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, SEED)] if words else []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1)
    return [digest(joined[a:b], SEED) for a, b in zip((ends - lengths - 1)[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash made of a hash; that of 0 is itself."""
    if k:
        h = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        h = h ^ h >> np.uint64(31)
    return h


def fingerprint_of(texts: list[str], shingle: int = SHINGLE, width: int = 1) -> np.ndarray:
    """Fingerprints of texts, unsigned: rows of `width` 64-bit words."""
    return fingerprint_of_hashes([np.array(shingle_hashes(t, shingle), dtype=np.uint64) for t in texts], width)


def fingerprint_of_hashes(hashes: list[np.ndarray], width: int) -> np.ndarray:
    n, out = np.array([len(h) for h in hashes], dtype=np.int64), np.zeros((len(hashes), width), np.uint64)
    if n.any():
        some, h = np.flatnonzero(n), np.concatenate(hashes)
        for k in range(width):
            bits = np.unpackbits(mixed(h, k).astype(">u8").view(np.uint8)).reshape(-1, 64)
            ones = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
            out[some, k] = np.packbits(2 * ones > n[some, None], axis=1).view(">u8").ravel()
    return out


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct hashes of the shingles of a text, in order."""
    return np.unique(np.array(shingle_hashes(text, shingle), dtype=np.uint64))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets, in order, is as high."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def names(width: int) -> list[str]:
    return [f"fp{k}" for k in range(width)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, width: int = 1) -> DataFrame:
    """doc_id and fp0, fp1 and so on (the fingerprint as signed longs) of each row."""
    columns = names(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, most=1 << 20):
            fp = fingerprint_of(texts, shingle, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(width))], ["doc_id", *columns])

    return whole(docs, "doc_id").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in columns))


def spanning(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of links that join the same values as all links a, b do, the nearest ones first (Boruvka)."""
    order = np.argsort(far, kind="stable")
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)][order], at[len(a) :][order]
    label, chosen, none = np.arange(len(values)), [np.zeros(0, np.int64)], len(order)
    while True:
        cross = np.flatnonzero(label[i] != label[j])
        if not len(cross):
            return order[np.unique(np.concatenate(chosen))]
        best = np.full(len(values), none)
        np.minimum.at(best, label[i[cross]], cross)
        np.minimum.at(best, label[j[cross]], cross)
        pick = np.unique(best[best < none])
        chosen.append(pick)
        other, root = forest(label[i[pick]], label[j[pick]])
        new = np.arange(len(values))
        new[other] = root
        label = new[label]


class Candidates:
    """Pairs found so far with their distances, cut down to the nearest that join the same values whenever they are many."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.n, self.parts = most, 0, []

    def add(self, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> None:
        self.parts.append((a, b, far.astype(np.int64)))
        self.n += len(a)
        if self.n > self.most:
            self.parts, self.n = [self.least()], 0

    def least(self) -> tuple[np.ndarray, ...]:
        a, b, far = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (zip(*self.parts, strict=True) if self.parts else [()] * 3))
        kept = spanning(a, b, far)
        return a[kept], b[kept], far[kept]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in self.least()], ["a", "b", "far"])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints; the words are in the last axis."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for k in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., k] ^ b[..., k])
    return out


def dense_spanning(far: np.ndarray, radius: int, square: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of links within the radius that join the same rows and columns as all of them do, the nearest ones first (Boruvka on the matrix). Square: rows and columns are the same."""
    n, m = far.shape
    none = np.int16(np.iinfo(np.int16).max)
    masked = np.where(far <= radius, far, none)
    if square:
        np.fill_diagonal(masked, none)
    label, out = np.arange(n if square else n + m), [np.zeros(0, np.int64)]
    while True:
        columns = label if square else label[n:]
        masked[label[:n, None] == columns[None, :]] = none
        at = np.arange(n) * m + masked.argmin(axis=1)
        ask = label[:n]
        if not square:
            at = np.concatenate([at, masked.argmin(axis=0) * m + np.arange(m)])
            ask = label
        value = masked.ravel()[at].astype(np.int64)
        some = value < none
        if not some.any():
            x, y = np.divmod(np.unique(np.concatenate(out)), m)
            return x, y
        rank = value[some] * (n * m) + at[some]
        best = np.full(len(label), np.iinfo(np.int64).max)
        np.minimum.at(best, ask[some], rank)
        pick = np.unique(best[best < np.iinfo(np.int64).max]) % (n * m)
        out.append(pick)
        x, y = np.divmod(pick, m)
        other, root = forest(label[x], label[y if square else n + y])
        new = np.arange(len(label))
        new[other] = root
        label = new[label]


def compare_tiles(ids: np.ndarray, fps: np.ndarray, radius: int, links: Links | Candidates, tile: int = 1024) -> None:
    """Links that join what all pairs of distinct fingerprints within the radius join. Tiles with many such pairs give their nearest ones only."""
    counts = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    ids, fps, counts = ids[order], fps[order], counts[order]
    for i in range(0, len(fps), tile):
        a = fps[i : i + tile]
        for j in range(i, len(fps), tile):
            if counts[j] - counts[i + len(a) - 1] > radius:
                break
            far = distances(a[:, None, :], fps[None, j : j + tile, :])
            if np.count_nonzero(far <= radius) > 4 * sum(far.shape):
                x, y = dense_spanning(far, radius, i == j)
            else:
                x, y = np.nonzero(far <= radius)
                if i == j:
                    x, y = x[x < y], y[x < y]
            links.add(ids[i + x], ids[j + y], *[far[x, y]] * isinstance(links, Candidates))


BUCKET = ["t", "key", "lo", "hi"]


def compare_buckets(radius: int, few: int = 32, found: type = Links, open_table: int = -1):
    """For mapInArrow over partitions sorted by bucket (four columns, then id and fingerprint): the links within buckets. In the table of number open_table any distance will do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, rest, n = found(), None, len(BUCKET)

        def whole_buckets(rows: np.ndarray) -> None:
            change = np.flatnonzero((rows[1:, :n] != rows[:-1, :n]).any(axis=1)) + 1
            starts = np.concatenate(([0], change))
            sizes = np.diff(np.concatenate((starts, [len(rows)])))
            bucket, ids, fp = np.repeat(np.arange(len(starts)), sizes), rows[:, n], rows[:, n + 1 :].view(np.uint64)
            small = np.repeat(sizes <= few, sizes)
            most = np.where(rows[:, 0] == open_table, 64 * fp.shape[1], radius)
            for k in range(1, min(few, int(sizes.max(initial=0)))):
                at = np.flatnonzero((bucket[k:] == bucket[:-k]) & small[k:])
                if not len(at):
                    break
                far = distances(fp[at], fp[at + k])
                near = far <= most[at]
                links.add(ids[at[near]], ids[at[near] + k], *[far[near]] * (found is Candidates))
            for i in np.flatnonzero(sizes > few):
                own = slice(starts[i], starts[i] + sizes[i])
                compare_tiles(ids[own], fp[own], int(most[starts[i]]), links)

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            rows = rows if rest is None else np.concatenate([rest, rows])
            if len(rows):
                other = np.flatnonzero((rows[:, :n] != rows[-1, :n]).any(axis=1))
                last = int(other[-1]) + 1 if len(other) else 0
                if last:
                    whole_buckets(np.ascontiguousarray(rows[:last]))
                rest = rows[last:]
        if rest is not None and len(rest):
            whole_buckets(np.ascontiguousarray(rest))
        yield links.batch()

    return run


def block_keys(radius: int, equal: int) -> list[Column]:
    """The bits of fp0 in each choice of `equal` of the radius + equal blocks."""
    n = radius + equal
    edges = [64 * i // n for i in range(n + 1)]
    masks = [sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in chosen) for chosen in combinations(range(n), equal)]
    return [F.col("fp0").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks]


def lanes(n: int, p: float, width: int, tile: int = TILE) -> tuple[int, list[tuple[int, int]]]:
    """Bits of half a lane, and the lanes (two halves each) for n fingerprints of `width` words whose similar pairs differ in a share p of the bits.

    A lane has LANE bits, or as many more as keep a bucket of it at about a tile; there are as many lanes as
    leave MISS of the pairs without an equal one. Neighbouring halves come first, so that the first lanes are disjoint.
    """
    half = max(LANE, math.ceil(math.log2(max(1, n) / tile))) + 1 >> 1
    wanted = max(1, math.ceil(math.log(MISS) / math.log1p(-((1 - p) ** (2 * half)))))
    count = 64 // half * width
    pairs = [(k, k + 1) for k in range(0, count - 1, 2)]
    pairs += [(k, (k + step) % count) for step in range(2, count // 2) for k in range(count)]
    return half, pairs[:wanted]


def lane_keys(n: int, p: float, width: int) -> list[Column]:
    half, pairs = lanes(n, p, width)
    each = 64 // half
    part = lambda k: F.shiftrightunsigned(f"fp{k // each}", half * (k % each)).bitwiseAND(F.lit((1 << half) - 1))
    return [part(x) + F.shiftleft(part(y), half) for x, y in pairs]


def close(fps: DataFrame, keys: list[Column], width: int, radius: int, tile: int = TILE, first: str | None = None) -> DataFrame:
    """Links (a, b) that join the same ids of fps (id and a fingerprint that no other row has) as all pairs within the radius, by the first `width` words, that share a key do.

    With `first`, a column of keys, so do pairs at any distance that share one of these; links are pairs found and come with their distances (far).
    Keys of more than a tile are a table whose size Spark knows: it is broadcast if it is small.
    """
    columns = ["id", *names(width)]

    def keyed(*carried: str) -> DataFrame:
        rows = fps.select(*carried, F.posexplode(F.array(*keys))).select(F.col("pos").cast("long").alias("t"), F.col("col").cast("long").alias("key"), *carried)
        return rows.unionByName(fps.select(F.lit(len(keys)).cast("long").alias("t"), F.explode(first).alias("key"), *carried)) if first else rows

    large = written(keyed().groupBy("t", "key").agg(F.ceil(F.count("*") / tile).alias("tiles")).where("tiles > 1"))
    tiles = F.coalesce("tiles", F.lit(1).cast("long"))
    dealt = keyed(*columns).join(large, ["t", "key"], "left").withColumn("tile", F.pmod(F.xxhash64("id"), tiles)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    pairs = dealt.select("t", "key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), *columns)
    found = compare_buckets(radius, found=Candidates, open_table=len(keys)) if first else compare_buckets(radius)
    return pairs.repartition(*BUCKET).sortWithinPartitions(*BUCKET).mapInArrow(found, "a long, b long" + ", far long" * bool(first))


def salted_join(rows: DataFrame, groups: DataFrame, key: str, spread: str, salts: int = SALTS) -> DataFrame:
    """rows joined with groups (one row for each key), the rows of a key dealt over `salts` tasks by the column `spread`."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copied = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [key, "_salt"]).drop("_salt")


def grouped(own: DataFrame, keys: list[Column], width: int, radius: int, tile: int) -> DataFrame:
    """own (doc_id and a fingerprint) with component_id, the smallest doc_id that links of distinct fingerprints reach."""
    columns = names(width)
    number = F.col("fp0") if width == 1 else F.xxhash64(*columns)
    fps = written(own.groupBy(*columns).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).withColumn("id", number))
    members = components(written(close(fps, keys, width, radius, tile)))
    members = fps.select("id", "first", "copies").join(members, F.col("id") == F.col("vertex"), "left").select("id", "first", "copies", F.coalesce("root", "id").alias("root"))
    smallest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    found = written(salted_join(members, smallest, "root", "id").select("id", "copies", "component_id"))
    return copies_join(own.withColumn("id", number), found, "id")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, equal: int = EQUAL, tile: int = TILE) -> DataFrame:
    """One row for each document: doc_id, fingerprint and component_id.

    Texts without words (null, empty, blank) have fingerprint zero and are linked like
    any other. Rows with a repeated doc_id are fingerprinted one by one; a null doc_id
    is never the smallest, and a component of null ids only has a null component_id.
    Other columns are not read.
    """
    out = grouped(written(fingerprints(docs, shingle)), block_keys(radius, equal), 1, radius, tile)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def text_key(text: Column) -> Column:
    """16 bytes that tell texts apart; a null text counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def texts_of(texts: DataFrame, some: DataFrame, few: int = FEW) -> DataFrame:
    """id and text of some sets (a written table of id and key), out of texts with their keys. Of copies, one for each task is shuffled."""
    if some.limit(few + 1).count() <= few:
        return texts.select("key", "text").join(F.broadcast(some), "key").groupBy("id").agg(F.first("text").alias("text"))
    return texts.groupBy("key").agg(F.first("text").alias("text")).join(some, "key").select("id", "text")


def set_fingerprints(docs: DataFrame, shingle: int, similarity: float, width: int) -> DataFrame:
    """doc_id, key (of the text), id (a hash of the set of shingles), the set's fingerprint and, of small sets, the first shingles."""
    columns = ["doc_id", "key", "id", *names(width), "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, most=1 << 20):
            sets = [shingle_set(t, shingle) for t in texts]
            fp = fingerprint_of_hashes(sets, width).view(np.int64)
            ids = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], dtype=np.uint64).view(np.int64)
            # Of similar sets in one order, the first ones that can be left over share one.
            first = [x[: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1].view(np.int64) if len(x) <= SMALL else [] for x in sets]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["key"], pa.array(ids), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(width)), pa.array([list(x) for x in first], pa.list_(pa.int64()))], columns)

    rows = whole(docs, "doc_id").withColumn("key", text_key(F.col("text")))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, id long, " + ", ".join(f"{c} long" for c in names(width)) + ", first array<long>")


def spread_links(links: DataFrame) -> DataFrame:
    """Candidates dealt out so that those of one pair meet, however many keys told of it, and those of a vertex in SALTS tasks at most."""
    return links.repartition(F.col("a"), F.pmod(F.xxhash64("b"), F.lit(SALTS)))


def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links (a, b, far) of a partition, the nearest that join the same: those of all partitions still hold the nearest that join all."""
    links = Candidates()
    for x in batches:
        links.add(*(x[c].to_numpy(zero_copy_only=False) for c in ("a", "b", "far")))
    yield links.batch()


def checked(similarity: float):
    """For mapInArrow over pairs with their sets: the pairs whose sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            sets = [[np.frombuffer(s, np.uint64) for s in x[c].to_pylist()] for c in ("set_a", "set_b")]
            ok = pa.array([alike(a, b, similarity) for a, b in zip(*sets, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([x["a"].filter(ok), x["b"].filter(ok)], ["a", "b"])

    return run


def similar(a: list[np.ndarray], b: list[np.ndarray], similarity: float, columns: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of all pairs of sets that are alike: products of 0-1 matrices over the members that a and b share, some columns at a time."""
    sizes = [np.array([len(x) for x in sets]) for sets in (a, b)]
    rows = [np.repeat(np.arange(len(sets)), n) for sets, n in zip((a, b), sizes, strict=True)]
    values = [np.concatenate([*sets, np.zeros(0, np.uint64)]) for sets in (a, b)]
    both = np.intersect1d(*values)
    places = [np.searchsorted(both, v) for v in values]
    known = [(p < len(both)) & (both[np.minimum(p, len(both) - 1)] == v) if len(both) else np.zeros(len(v), bool) for p, v in zip(places, values, strict=True)]
    shared = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, len(both), columns):
        parts = []
        for sets, row, place, ok in zip((a, b), rows, places, known, strict=True):
            own = np.zeros((len(sets), min(columns, len(both) - start)), np.float32)
            at = ok & (place >= start) & (place < start + columns)
            own[row[at], place[at] - start] = 1
            parts.append(own)
        shared += parts[0] @ parts[1].T
    return np.nonzero((shared >= similarity * (sizes[0][:, None] + sizes[1][None, :] - shared) - 1e-9) & (sizes[0][:, None] + sizes[1][None, :] > 0))


def compare_members(similarity: float):
    """For mapInArrow over partitions sorted by root, lo and hi: links between parts of a component that hold alike sets, as a forest for each pair of tiles."""

    def links_of(lo: int, hi: int, rows: list[tuple]) -> pa.RecordBatch:
        parts, tiles = (np.array([r[k] for r in rows], dtype=np.int64) for k in (0, 1))
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        own, other = np.flatnonzero(tiles == lo), np.flatnonzero(tiles == hi)
        x, y = similar([sets[k] for k in own.tolist()], [sets[k] for k in other.tolist()], similarity)
        x, y = parts[own[x]], parts[other[y]]
        pairs = np.unique(np.stack([x, y])[:, x != y], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in forest(*pairs)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for x in batches:
            for r in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if rows and r[:3] != rows[0][:3]:
                    yield links_of(*rows[0][1:3], [q[3:] for q in rows])
                    rows = []
                rows.append(r)
        if rows:
            yield links_of(*rows[0][1:3], [q[3:] for q in rows])

    return run


def settled(loose: DataFrame, links: DataFrame, sets: DataFrame, similarity: float, members: int = MEMBERS, known: DataFrame | None = None) -> DataFrame:
    """vertex and joined (a number that sets linked at the similarity share) of all sets that are linked.

    loose: vertex and root of candidate components, of which no link leads out. links: candidates (a, b) that join each of them; they are checked
    by their sets (id, set). Where that leaves a component in parts, all its sets are compared. known: links that are sure beforehand.
    """
    left, right = (sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    sure = written(links.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(checked(similarity), "a long, b long"))
    sure = sure.union(known) if known is not None else sure
    parts = components(sure).select(F.col("vertex").alias("v"), F.col("root").alias("part"))
    placed = written(loose.join(parts, F.col("vertex") == F.col("v"), "left").select("root", F.col("vertex").alias("id"), F.coalesce("part", "vertex").alias("part")))
    open_roots = placed.groupBy("root").agg(F.count("*").alias("n"), F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("root", F.ceil(F.col("n") / members).alias("tiles"))
    left_over = salted_join(placed, open_roots, "root", "id").join(sets, "id")
    dealt = left_over.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = dealt.select("root", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "part", "tile", "set")
    more = dealt.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi").mapInArrow(compare_members(similarity), "a long, b long")
    return components(sure.union(written(more))).select("vertex", F.col("root").alias("joined"))


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, width: int = WIDE, tile: int = TILE, members: int = MEMBERS) -> DataFrame:
    """One row for each document: doc_id, key (see text_key()) and root, a number that near-duplicates share.

    A Jaccard similarity s of equally large sets of shingles is a cosine of 2s / (1 + s),
    and of others a higher one; the angle's share of a half turn is the expected share of
    differing bits, which with four standard deviations more is the radius of candidates.
    The nearest candidates that join all others are checked by their sets. Where that
    leaves a component in parts, all its candidates across parts are checked.
    """
    bits, p = 64 * COMPARED, math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius, columns = math.ceil(bits * p + 4 * math.sqrt(bits * p * (1 - p))), names(width)
    own = written(set_fingerprints(docs, shingle, similarity, width))
    sets = written(own.groupBy("id").agg(*(F.first(c).alias(c) for c in columns), F.first("first").alias("first"), F.min("key").alias("key"), F.count("*").alias("copies")))
    links = written(close(sets, lane_keys(sets.count(), p, width), COMPARED, radius, tile, "first"))
    loose = written(components(links))
    links = written(spread_links(links).mapInArrow(nearest, "a long, b long, far long"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, most=1 << 20):
            yield pa.RecordBatch.from_arrays([part["id"], pa.array([shingle_set(t, shingle).tobytes() for t in texts], pa.binary())], ["id", "set"])

    some = written(sets.join(loose, F.col("id") == F.col("vertex")).select("id", "key"))
    shingles = written(texts_of(whole(docs).withColumn("key", text_key(F.col("text"))), some).mapInArrow(listed, "id long, set binary"))
    found = settled(loose, links, shingles, similarity, members)
    named = written(sets.select("id", "copies").join(found, F.col("id") == F.col("vertex"), "left").select("id", "copies", F.coalesce("joined", "id").alias("root")))
    return copies_join(own.select("doc_id", "key", "id"), named, "id").select("doc_id", "key", "root")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, width: int = WIDE, tile: int = TILE) -> DataFrame:
    """One row for each document: doc_id and component_id, the smallest doc_id that pairs of a Jaccard similarity of `similarity` reach. Nulls, repeats and empty texts are as in simhash_groups()."""
    own = written(near_groups(docs, shingle, similarity, width, tile))
    return own.join(own.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")
