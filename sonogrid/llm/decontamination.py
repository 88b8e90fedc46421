"""Operator 5: benchmark decontamination by spaced seeds, in DataFrame functions only.

Words are hashed once. At each word a mask picks some of the following words, and the
hash of those picked is a seed: a substituted word that the mask ignores doesn't hide
the passage. Seeds of the benchmark are joined with seeds of the documents; a hit
gives a place in both, around which the words are then compared one by one.

Two bit filters made of the benchmark, of at most FILTER_BITS bits each, leave out most
places before rows are made. The benchmark's seeds are a table whose size Spark knows:
the join broadcasts it if it is small and shuffles what the filters left if not.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonogrid.llm.common import whole, written

# The masks (1: the word counts; all count their first and last word) and what stands between words.
MASKS = ("110110101", "111001011", "101101101")
BETWEEN = r"""[\x20\x09-\x0D.,;:!?"'()\[\]{}|#*$%&<>_-]+"""
#: Overlaps are judged over so many words, of which this share must be equal.
WORDS, SHARE = 13, 0.8
#: Bits of a filter at most (4 MB): a bit for each 64th seed, up to half a million seeds, and fuller beyond.
FILTER_BITS = 1 << 25


def hashed(text: Column) -> Column:
    """The hashes of the words of a text: lower case, signs as spaces."""
    return F.array_remove(F.transform(F.split(F.lower(text), BETWEEN), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def seed(h: Column, i: Column, k: int, mask: str) -> Column:
    """The seed of mask k at place i of the words h; null where the words end before the mask."""
    return F.when(i + len(mask) <= F.size(h), F.xxhash64(F.lit(k), *(F.get(h, i + j) for j, x in enumerate(mask) if x == "1")))


def around(h: Column, words: int, span: int, takes: Callable[[Column], Column] | None = None) -> Column:
    """For each place i of h that `takes` takes: the words from `words` before it to `words` after the mask, and where i is among them."""
    places = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
    if takes is not None:
        places = F.filter(places, takes)
    low = lambda i: F.greatest(i - words, F.lit(0))
    return F.transform(places, lambda i: F.struct(i.alias("i"), (i - low(i)).alias("back"), F.slice(h, low(i) + 1, F.least(F.size(h), i + span + words) - low(i)).alias("near")))


def with_seeds(df: DataFrame, masks: list[str]) -> DataFrame:
    """A row for each place (i, back, near) and seed."""
    made = F.array(*(seed(F.col("near"), F.col("back"), k, m) for k, m in enumerate(masks)))
    return df.withColumn("seed", F.explode(F.array_compact(made)))


class Bits:
    """A set of 64-bit hashes as a literal, with 64 bits and more for each up to `most` bits: never misses one, and takes few others."""

    def __init__(self, hashes: DataFrame, n: int, most: int = FILTER_BITS):
        self.log = max(6, min(6 + max(0, (max(1, n) - 1).bit_length()), most.bit_length() - 1))
        at = F.col("hash").bitwiseAND(F.lit((1 << self.log) - 1))
        words = dict(hashes.select(at.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))")).collect())
        self.column = F.split(F.lit(",".join(str(words.get(i, 0)) for i in range(1 << self.log - 6))), ",").cast("array<bigint>")

    def has(self, hash_: Column) -> Column:
        word = F.get(self.column, F.shiftright(hash_.bitwiseAND(F.lit((1 << self.log) - 1)), 6).cast("int"))
        return F.call_function("getbit", word, hash_.bitwiseAND(F.lit(63)).cast("int")) == 1


def ends(h: Column, i: Column, length: int) -> Column:
    """A hash of the first and last word under a mask."""
    return F.xxhash64(F.lit(length), F.get(h, i), F.get(h, i + (length - 1)))


def likely(h: Column, listed: DataFrame, n: int, masks: list[str], most: int) -> Callable[[Column], Column]:
    """Whether a place of h can be a seed of the benchmark: first by the ends of the masks, then by the seeds."""
    lengths = sorted({len(m) for m in masks})
    pairs = F.array(*(ends(F.col("item_near"), F.col("item_back"), k) for k in lengths))
    firsts, seeds = Bits(listed.select(F.explode(pairs).alias("hash")), n * len(lengths), most), Bits(listed.select(F.col("seed").alias("hash")), n, most)

    def takes(i: Column) -> Column:
        made = lambda: F.array_compact(F.array(*(seed(h, i, k, m) for k, m in enumerate(masks))))
        near = reduce(lambda a, b: a | b, [F.exists(F.array(ends(h, i, k)), firsts.has) for k in lengths])
        return near & F.exists(made(), seeds.has)

    return takes


def decontamination(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, words: int = WORDS, share: float = SHARE, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row for each document: doc_id, contaminated, n_items and items (ids of the benchmark's items found in it, sorted and comma-joined).

    A document holds an item if, in line with a hit, some `words` successive words of
    the item (all of a shorter one) agree in `share` of them at least. An item shorter
    than the masks must be there word by word. Null and empty texts, items without
    words and a null item_id never match. Rows that share a doc_id (null too) count as
    one document and each get its items. Other columns are not read.
    """
    span = max(map(len, masks))
    items = whole(benchmark.where(F.col("item_id").isNotNull()), "item_id").select("item_id", hashed(F.col("text")).alias("h")).where(F.size("h") > 0)
    short = sorted(r[0] for r in items.select(F.size("h").alias("n")).where(F.col("n") < span).distinct().collect())
    all_masks = [*masks, *("1" * n for n in short)]
    listed = with_seeds(items.select("item_id", F.size("h").alias("item_n"), F.explode(around(F.col("h"), words, span)).alias("p")).select("item_id", "item_n", "p.*"), all_masks)
    # A short item is asked for as a whole only.
    listed = listed.where((F.col("item_n") >= span) | (F.col("i") == 0)).select("seed", "item_id", "item_n", F.col("back").alias("item_back"), F.col("near").alias("item_near"))
    listed = written(listed)
    n = listed.count()
    own = whole(docs, "doc_id").select("doc_id", hashed(F.col("text")).alias("h"))
    takes = likely(F.col("h"), listed, n, all_masks, filter_bits)
    places = own.select("doc_id", F.explode(around(F.col("h"), words, span, takes)).alias("p")).select("doc_id", "p.*")
    hits = with_seeds(places, all_masks).join(listed, "seed")
    shift = F.col("back") - F.col("item_back")
    same = F.transform("item_near", lambda w, j: F.when((shift + j >= 0) & (F.get("near", shift + j) == w), 1).otherwise(0))
    window = F.least(F.lit(words), F.col("item_n"))
    least = F.when(F.col("item_n") < span, F.col("item_n")).otherwise(F.ceil(window * share - 1e-9))
    agree = F.exists(F.sequence(F.lit(1), F.size("same") - window + 1), lambda k: F.aggregate(F.slice("same", k, window), F.lit(0), lambda a, x: a + x) >= least)
    held = hits.withColumn("same", same).where(agree).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    ids, held = docs.select(F.col("doc_id")), held.withColumnRenamed("doc_id", "held_id")
    out = ids.join(held, ids["doc_id"].eqNullSafe(held["held_id"]), "left")
    number = F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), number.alias("n_items"), F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("items"))


def sql(masks: tuple[str, ...] = MASKS, words: int = WORDS, share: float = SHARE) -> str:
    """DuckDB's SQL for decontamination(), for items that are no shorter than the masks."""
    span = max(map(len, masks))
    between = BETWEEN.replace("'", "''")
    cut = f"list_filter(string_split_regex(lower(coalesce(text, '')), '{between}'), lambda x: x <> '')"
    made = ", ".join("CASE WHEN i + {n} <= len(h) THEN '{k} ' || {key} END".format(n=len(m), k=k, key=" || ' ' || ".join(f"h[i + {j + 1}]" for j, x in enumerate(m) if x == "1")) for k, m in enumerate(masks))

    def seeds_of(table: str, key: str) -> str:
        return f"SELECT {key}, i, h, unnest([{made}]) AS seed FROM (SELECT {key}, h, unnest(range(0, len(h) - {min(map(len, masks)) - 1})) AS i FROM (SELECT {key}, {cut} AS h FROM {table}))"

    need = math.ceil(words * share - 1e-9)
    return f"""
WITH own AS ({seeds_of("documents", "doc_id")}), listed AS ({seeds_of("benchmark", "item_id")}),
hits AS (SELECT doc_id, item_id, o.h AS h, l.h AS g, o.i AS i, l.i AS j FROM own o JOIN listed l USING (seed)),
near AS (SELECT doc_id, item_id, least(len(g), {words}) AS w, list_transform(range(greatest(j - {words}, 0), least(len(g), j + {span} + {words})), lambda x: CASE WHEN i - j + x >= 0 AND h[i - j + x + 1] = g[x + 1] THEN 1 ELSE 0 END) AS same FROM hits),
held AS (SELECT DISTINCT doc_id, item_id FROM near WHERE list_max(list_transform(range(0, len(same) - w + 1), lambda k: list_sum(same[k + 1:k + w]))) >= CASE WHEN w = {words} THEN {need} ELSE ceil(w * {share} - 1e-9) END),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS items FROM held GROUP BY doc_id)
SELECT d.doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0)::BIGINT AS n_items, coalesce(items, '') AS items FROM documents d LEFT JOIN items USING (doc_id)
"""
