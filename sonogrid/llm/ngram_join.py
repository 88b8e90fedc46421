"""Operator 12: documents whose sets of word shingles are alike, by token-combination prefixes.

A set's tokens (hashes of its shingles) stand in one order for all sets: rare ones first, by
hash, then common ones by how many documents hold them. Of a set of n tokens, at most
s = n - ceil(0.85 n) are not in a set that is alike, so

* if the first token that two such sets share is rare, it is among the first s + 1 of
  both: each of these is a key of its own, with its place, which bounds what can follow;
* if it is common, all that they share is common. The common tokens are dealt by hash to G
  classes; of G + 1 shared tokens two are of one class. These are among the first s + G + 1
  of both, so the prefix is extended by G and the pairs of tokens of one class are the keys. G goes by the
  band of the set's size, with about as many tokens as classes: keys grow with the prefix, not with its square.

What is rare is told by counting all tokens. Rare keys have few sets, and their pairs are
checked. Sets that meet by keys of common tokens can be a third of all sets: buckets are
dealt out as pairs of tiles, a sketch (tokens counted in bins, whose differences never exceed
that of the sets) leaves out what cannot be alike, and of the rest the nearest pairs that join
the same sets are checked. Where that leaves a part unjoined, all its pairs are compared.
Equal sets are one set throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonogrid.llm.common import LOWER, blocks, copies_join, whole, written
from sonogrid.llm.components import components
from sonogrid.llm.simhash import FEW, Candidates, checked, dense_spanning, mixed, nearest, settled, spread_links, texts_of

SHINGLE, PERCENT = 4, 85
#: Documents that hold a common token at least, and common tokens that are sent to all tasks at most (nine bytes each): where they are more, the least common ones count as rare.
RARE, COMMON = 16, 1 << 20
#: Sets of a tile of a bucket, and rows of a component's tile where all pairs are compared.
TILE, MEMBERS = 512, 512
#: Tokens that are counted together in a task.
COUNTED = 1 << 22
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class Sets:
    """Sets of tokens of texts; the hashes of words are remembered for the most recent ones."""

    def __init__(self, most: int = 300_000):
        self.most, self.codes = most, {}

    def words(self, text: str) -> np.ndarray:
        words, codes = text.encode("utf-8", "surrogatepass").translate(LOWER).split(), self.codes
        if len(words) < SHINGLE:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))][: len(words)], dtype=np.uint64)
        try:
            return np.array([codes[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(codes) > self.most:
                codes.clear()
            for w in words:
                if w not in codes:
                    codes[w] = xxhash.xxh64_intdigest(w)
            return np.array([codes[w] for w in words], dtype=np.uint64)

    def __call__(self, text: str) -> np.ndarray:
        """The distinct hashes of the shingles of a text, in order; of all its words if they are fewer than a shingle, none without words."""
        w = self.words(text)
        if len(w) < SHINGLE:
            return w
        grams = w[: len(w) - SHINGLE + 1] * ODD[0]
        for k in range(1, SHINGLE):
            grams = grams + w[k : len(w) - SHINGLE + 1 + k] * ODD[k]
        return np.unique(mixed(grams, 1))


def slack(n: int) -> int:
    """Tokens of a set of n that a set alike lacks at most."""
    return n - -(-PERCENT * n // 100)


def needed(a, b):
    """Tokens that sets of a and b tokens share at least if they are alike."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


# What is common


def counted(bits: int):
    """For mapInArrow over texts: tokens by 2^bits buckets of their first bits: the next 32 bits of each, once, and places and numbers of those seen more than once."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, n = np.unique(np.concatenate(held) >> np.uint64(32 - bits), return_counts=True)
        edges = np.searchsorted(values, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
        some = np.flatnonzero(np.diff(edges)).tolist()
        more = [(np.flatnonzero(n[edges[k] : edges[k + 1]] > 1), n[edges[k] : edges[k + 1]]) for k in some]
        columns = [pa.array(some, pa.int64()), pa.array([values[edges[k] : edges[k + 1]].astype(np.uint32).tobytes() for k in some], pa.binary()), pa.array([np.concatenate([at, c[at]]).astype(np.uint32).tobytes() for at, c in more], pa.binary())]
        for at in range(0, len(some), 1024):
            yield pa.RecordBatch.from_arrays([c.slice(at, 1024) for c in columns], ["bucket", "tokens", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, n = Sets(), [], 0
        for _, texts in blocks(batches):
            for t in texts:
                held.append(sets(t))
                n += len(held[-1])
                if n >= COUNTED:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def frequent(least: int):
    """For mapInArrow over partitions sorted by bucket: the tokens that at least so many documents hold."""

    def settle(bucket: int, tokens: list[np.ndarray], numbers: list[np.ndarray]) -> pa.RecordBatch:
        values, at = np.unique(np.concatenate(tokens), return_inverse=True)
        n = np.bincount(at, np.concatenate(numbers)).astype(np.int64)
        keep = n >= least
        return pa.RecordBatch.from_arrays([pa.array(values[keep].astype(np.int64) + (bucket << 32)), pa.array(n[keep])], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, tokens, numbers = None, [], []
        for x in batches:
            for k, t, m in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if bucket is not None and k != bucket:
                    yield settle(bucket, tokens, numbers)
                    tokens, numbers = [], []
                bucket = k
                tokens.append(np.frombuffer(t, np.uint32))
                numbers.append(np.ones(len(tokens[-1])))
                at, n = np.frombuffer(m, np.uint32).reshape(2, -1)
                numbers[-1][at] = n
        if bucket is not None:
            yield settle(bucket, tokens, numbers)

    return run


def common_tokens(docs: DataFrame, least: int = RARE, most: int = COMMON) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of bits that tell a token, the common tokens by these bits, in order, and each one's class: the logarithm of its number of documents."""
    parts = docs.rdd.getNumPartitions()
    bits = min(31, 4 + max(3, math.ceil(math.log2(max(1, parts)))))
    found = whole(docs).mapInArrow(counted(bits), "bucket long, tokens binary, more binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(frequent(least), "token long, n long")
    found = written(found.withColumn("class", F.floor(F.log2("n")).cast("int")))
    # Classes are taken from the most common one on, as many as the bound allows.
    held, lowest = 0, 64
    for r in sorted(found.groupBy("class").count().collect(), key=lambda r: -r["class"]):
        held += r["count"]
        if held > most:
            break
        lowest = r["class"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_pydict({"tokens": [x["token"].to_numpy().astype(np.int64).tobytes()], "classes": [x["class"].to_numpy().astype(np.uint8).tobytes()]})

    rows = found.where(F.col("class") >= lowest).select("token", "class").mapInArrow(pack, "tokens binary, classes binary").collect()
    tokens = np.concatenate([np.frombuffer(r["tokens"], np.int64) for r in rows] + [np.zeros(0, np.int64)]).astype(np.uint64)
    classes = np.concatenate([np.frombuffer(r["classes"], np.uint8) for r in rows] + [np.zeros(0, np.uint8)])
    order = np.argsort(tokens)
    return 32 + bits, tokens[order], classes[order]


# Prefixes and keys


def classes_of(tokens: np.ndarray, bits: int, common: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Of each token its class, 0 for rare ones."""
    if not len(common):
        return np.zeros(len(tokens), np.uint8)
    short = tokens >> np.uint64(64 - bits)
    at = np.minimum(np.searchsorted(common, short), len(common) - 1)
    return np.where(common[at] == short, classes[at], 0).astype(np.uint8)


def bands(n: int) -> list[int]:
    """Bands of sizes (by their lower ends, powers of two) in which a set of n tokens meets sets alike: its own, and the next one if a larger set alike can be there."""
    low = 1 << n.bit_length() - 1
    return [low, 2 * low] if 100 * n >= PERCENT * 2 * low else [low]


def pair_keys(tokens: np.ndarray, spare: int, band: int) -> np.ndarray:
    """Keys of the pairs of one class of the first common tokens, in order of all sets; spare: how many of these may be missing elsewhere."""
    groups = max(1, 15 * band // 100)
    first = np.sort(tokens[: spare + groups + 1])
    of = (mixed(first, 2) % np.uint64(groups)).astype(np.int64)
    first, of = first[np.argsort(of, kind="stable")], np.sort(of)
    out = [np.zeros(0, np.uint64)]
    for k in range(1, len(first)):
        at = np.flatnonzero(of[k:] == of[:-k])
        if not len(at):
            break
        out.append(mixed(first[at] * ODD[0] + first[at + k] * ODD[1] + np.uint64(band), 1))
    return np.concatenate(out)


def sketch(tokens: np.ndarray, band: int) -> bytes:
    """Tokens counted in 32 bins, 64 for larger bands, to 255 at most."""
    bins = 32 if band < 1024 else 64
    return np.minimum(np.bincount((tokens & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def keys_of(tokens: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The keys of a set: rare tokens by their place, and those of pairs for each band. Sets of fewer than six tokens are only like equal ones."""
    n, spare = len(tokens), slack(len(tokens))
    rare = tokens[kind == 0]
    if len(rare) > spare:
        return rare[: spare + 1], []
    some = np.flatnonzero(kind)
    some = some[np.lexsort((tokens[some], kind[some]))]
    return rare, [(b, pair_keys(tokens[some], spare - len(rare), b)) for b in bands(n)]


LEAST = 6


def prefixes(bits: int, common: np.ndarray, classes: np.ndarray):
    """For mapInArrow over doc_id, key and text: doc_id, key, id (a hash of the set), n (its size), and for the first row of a set in a task its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen = Sets(), set()
        for part, texts in blocks(batches):
            found = [sets(t) for t in texts]
            kinds = np.split(classes_of(np.concatenate(found), bits, common, classes), np.cumsum([len(x) for x in found])[:-1])
            ids, rare, pairs = [], [], []
            for x, kind in zip(found, kinds, strict=True):
                ids.append(np.uint64(xxhash.xxh64_intdigest(x.tobytes(), 7)).astype(np.int64))
                new = len(x) >= LEAST and ids[-1] not in seen
                if new:
                    seen.add(ids[-1])
                r, p = keys_of(x, kind) if new else (np.zeros(0, np.uint64), [])
                rare.append(r.tobytes())
                pairs.append([{"keys": k.tobytes(), "sketch": sketch(x, b)} for b, k in p])
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["key"], pa.array(ids, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array(rare, pa.binary()), pa.array(pairs, PAIRS)], ["doc_id", "key", "id", "n", "rare", "pairs"])

    return run


PAIRS = pa.list_(pa.struct([("keys", pa.binary()), ("sketch", pa.binary())]))


def rare_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over id, n and rare: a row for each key, with its place."""
    for x in batches:
        for at in range(0, x.num_rows, 256):
            part = x.slice(at, 256)
            keys = [np.frombuffer(b, np.int64) for b in part["rare"].to_pylist()]
            sizes = np.array([len(k) for k in keys], dtype=np.int64)
            places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(pa.array(np.repeat(part[c].to_numpy(), sizes)) for c in ("id", "n")), pa.array(places)], ["key", "id", "n", "place"])


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over id, n, keys and sketch: a row for each key."""
    for x in batches:
        for i, n, keys, s in zip(*(x[c].to_pylist() for c in ("id", "n", "keys", "sketch")), strict=True):
            k = np.frombuffer(keys, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([i] * len(k), pa.int64()), pa.array([n] * len(k), pa.int64()), pa.array([s] * len(k), pa.binary())], ["key", "id", "n", "sketch"])


def rare_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over partitions sorted by key, n and id: pairs of sets of one key that can be alike by their sizes and by what can follow the key."""

    def pairs(rows: np.ndarray) -> pa.RecordBatch:
        rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)))]
        key, ids, n, left = rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 2] - rows[:, 3]
        found, k, at = [np.zeros((0, 2), np.int64)], 1, np.arange(len(rows) - 1)
        while len(at):
            # Sizes rise within a key: where one is too large, so are all later ones.
            at = at[at + k < len(rows)]
            at = at[(key[at] == key[at + k]) & (PERCENT * n[at + k] <= 100 * n[at])]
            ok = at[np.minimum(left[at], left[at + k]) >= needed(n[at], n[at + k])]
            found.append(np.sort(np.stack([ids[ok], ids[ok + k]], axis=1), axis=1))
            k += 1
        a, b = np.unique(np.concatenate(found), axis=0).T
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], ["a", "b"])

    rest = np.zeros((0, 4), np.int64)
    for x in batches:
        rows = np.concatenate([rest, np.stack([x[c].to_numpy() for c in ("key", "id", "n", "place")], axis=1)])
        if len(rows):
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if last:
                yield pairs(rows[:last])
            rest = rows[last:]
    if len(rest):
        yield pairs(rest)


BUCKET = ["key", "lo", "hi"]


def near_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over partitions sorted by key, lo, hi and n: of the sets of each bucket that can be alike by size and sketch, the nearest pairs that join all of them."""
    links = Candidates()

    def compare(ids: np.ndarray, n: np.ndarray, s: np.ndarray, step: int = 256) -> None:
        for i in range(0, len(ids), step):
            for j in range(i, len(ids), step):
                if PERCENT * n[j] > 100 * n[min(i + step, len(ids)) - 1]:
                    break
                a, b = n[i : i + step, None], n[None, j : j + step]
                far = np.zeros((a.shape[0], b.shape[1]), np.int16)
                for c in range(s.shape[1]):
                    far += np.abs(s[i : i + step, None, c] - s[None, j : j + step, c])
                ok = (PERCENT * np.maximum(a, b) <= 100 * np.minimum(a, b)) & (far <= a + b - 2 * needed(a, b))
                x, y = dense_spanning(np.where(ok, far, np.int16(32767)), 32766, i == j)
                links.add(ids[i + x], ids[j + y], far[x, y])

    def bucket(rows: list[tuple[int, int, bytes]]) -> None:
        once = sorted({r[0]: r for r in rows}.values(), key=lambda r: r[1])
        if len(once) > 1:
            compare(np.array([r[0] for r in once]), np.array([r[1] for r in once]), np.frombuffer(b"".join(r[2] for r in once), np.uint8).reshape(len(once), -1).astype(np.int16))

    rows, own = [], None
    for x in batches:
        for r in zip(*(x[c].to_pylist() for c in (*BUCKET, "id", "n", "sketch")), strict=True):
            if r[:3] != own:
                bucket(rows)
                rows, own = [], r[:3]
            rows.append(r[3:])
    bucket(rows)
    yield links.batch()


def tiled(rows: DataFrame, tile: int) -> DataFrame:
    """Rows (key, id, n, sketch) with lo and hi, the tiles of a bucket that meet; a bucket of more than a tile's rows is dealt out as all pairs of its tiles."""
    large = written(rows.groupBy("key").agg(F.ceil(F.count("*") / tile).alias("tiles")).where("tiles > 1"))
    tiles = F.coalesce("tiles", F.lit(1).cast("long"))
    dealt = rows.join(large, "key", "left").withColumn("tile", F.pmod(F.xxhash64("id"), tiles)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    return dealt.select("key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "id", "n", "sketch")


def token_sets(docs: DataFrame, some: DataFrame, few: int = FEW) -> DataFrame:
    """id and set (its tokens) of some sets (id, key: a hash of one of its texts)."""
    found = texts_of(docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).alias("text")), some, few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for part, texts in blocks(batches, most=1 << 20):
            yield pa.RecordBatch.from_arrays([part["id"], pa.array([sets(t).tobytes() for t in texts], pa.binary())], ["id", "set"])

    return written(found.mapInArrow(run, "id long, set binary"))


def similar_sets(docs: DataFrame, least: int = RARE, most: int = COMMON, tile: int = TILE, members: int = MEMBERS, few: int = FEW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, id, n) of all documents, sets (id, copies, first: the smallest doc_id), and for each set that is linked to another its id and root, which sets that links reach share."""
    common = common_tokens(docs, least, most)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = whole(docs, "doc_id").withColumn("key", F.xxhash64("text"))
    table = written(rows.select("doc_id", "key", "text").mapInArrow(prefixes(*common), f"doc_id {kind}, key long, id long, n long, rare binary, pairs array<struct<keys: binary, sketch: binary>>"))
    sets = written(table.groupBy("id").agg(F.min("key").alias("key"), F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    keyed = table.where(F.length("rare") > 0).select("id", "n", "rare").mapInArrow(rare_rows, "key long, id long, n long, place long")
    found = written(keyed.repartition("key").sortWithinPartitions("key", "n", "id").mapInArrow(rare_pairs, "a long, b long").distinct())
    pairs = tiled(table.where(F.size("pairs") > 0).select("id", "n", F.explode("pairs").alias("p")).select("id", "n", "p.keys", "p.sketch").mapInArrow(pair_rows, "key long, id long, n long, sketch binary"), tile)
    links = written(pairs.repartition(*BUCKET).sortWithinPartitions(*BUCKET).mapInArrow(near_in_buckets, "a long, b long, far long"))
    loose = written(components(links))
    links = written(spread_links(links).mapInArrow(nearest, "a long, b long, far long"))
    ids = found.select(F.explode(F.array("a", "b")).alias("id")).union(loose.select("vertex")).distinct()
    tokens = token_sets(docs, written(sets.join(ids, "id", "left_semi").select("id", "key")), few)
    left, right = (tokens.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    sure = written(found.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(checked(PERCENT / 100), "a long, b long"))
    joined = settled(loose, links, tokens, PERCENT / 100, members, sure)
    return table.select("doc_id", "id", "n"), sets.select("id", "copies", "first"), joined.select(F.col("vertex").alias("id"), F.col("joined").alias("root"))


def ngram_groups(docs: DataFrame, **settings: int) -> DataFrame:
    """One row for each document: doc_id, n_shingles (the size of its set of four-word shingles) and component_id, the smallest doc_id that links reach.

    Documents link when their sets share 85 % of their union at least. A-Z are lower-cased, words are runs of anything but ASCII white space, and fewer than
    four words are one shingle. Texts without words (null too) have an empty set, link with nothing and have their own doc_id as component_id.
    Rows that repeat a doc_id or text are judged one by one; a null doc_id is never the smallest, and a component of null ids has a null component_id.
    Other columns are not read. Tokens and sets are told apart by 64-bit hashes.
    """
    rows, sets, found = similar_sets(docs, **settings)
    members = sets.join(found, "id", "left").select("id", "copies", "first", F.coalesce("root", "id").alias("root"))
    smallest = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(members.join(smallest, "root").select("id", "copies", "component_id"))
    joined = copies_join(rows.where("n > 0"), named, "id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
