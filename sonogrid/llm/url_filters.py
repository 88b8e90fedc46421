"""Operator 3: URL rules by Bloom filter cascades, in DataFrame functions only.

A rule is a host and a path prefix. A url offers a key for each pair of host depth
and path length that occurs among the rules, so the keys of a url are few, whatever
its length. Rules are a table, and what the plan holds of them is that list of pairs and
the cascades' bits, as literals: its size doesn't grow with the rules. The keys of all urls are the universe over which a cascade is built:
level 0 holds the listed keys, level 1 the keys that level 0 takes by mistake,
level 2 the listed keys that level 1 takes, and so on until no mistake is left.
Level 0 has a false positive rate of about listed / universe, so that the cascade's
size grows with the list and with the logarithm of the corpus.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonogrid.llm.common import lower_az, written

Rule = tuple[str, str, str]
#: The rules of the query: verdict, host, path.
RULES: list[Rule] = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
URL = "://([^/?#]*)([^?#]*)"


class Bloom:
    """Bits of one level as a literal array of 64-bit words; made by a Spark job, asked by column functions."""

    def __init__(self, keys: DataFrame, n: int, rate: float, salt: int):
        self.hashes, self.salt = max(1, round(math.log2(1 / rate))), salt
        self.words = max(1, math.ceil(n * self.hashes / math.log(2) / 64))
        found = keys.select(F.explode(F.array(*self.at(F.col("key")))).alias("bit")).groupBy(F.expr("bit div 64").cast("int").alias("word"))
        bits = dict(found.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).collect())
        self.column = F.split(F.lit(",".join(str(bits.get(i, 0)) for i in range(self.words))), ",").cast("array<bigint>")

    def at(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.salt * 64 + i)), F.lit(64 * self.words)) for i in range(self.hashes)]

    def takes(self, key: Column) -> Column:
        ask = [(F.shiftright(F.get(self.column, (p / 64).cast("int")), 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (p % 64).cast("int"))) != 0) for p in self.at(key)]
        return reduce(lambda a, b: a & b, ask)


class Cascade:
    """Exact membership of the universe's keys in the list."""

    def __init__(self, universe: DataFrame, listed: DataFrame, salt: int):
        inside, outside = listed.select("key").distinct(), universe.join(listed, "key", "left_anti")
        n, total = inside.count(), universe.count()
        self.levels: list[Bloom] = []
        rate = min(0.5, max(n, 1) / max(total, 1))
        while n:
            self.levels.append(Bloom(inside, n, rate, salt + len(self.levels)))
            taken = written(outside.where(self.levels[-1].takes(F.col("key"))))
            inside, outside, n, rate = taken, inside, taken.count(), 0.5

    def takes(self, key: Column) -> Column:
        """The first level that refuses a key decides: it is listed if that level holds mistakes."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[k].takes(key), F.lit(k % 2 == 1)).otherwise(out)
        return out


def offers(host: Column, path: Column, lengths: dict[int, list[int]]) -> Column:
    """The keys that a url offers, as an array of structs (key, length, host_length): for each depth its host has and each length, of those among the rules, that its path has."""
    known = F.from_json(F.lit(json.dumps([{"d": d, "n": n} for d, n in sorted(lengths.items())])), "array<struct<d:int,n:array<int>>>")

    def of_depth(x: Column) -> Column:
        tail = F.call_function("substring_index", host, F.lit("."), -x["d"])
        key = lambda n: F.concat(tail, F.substring(path, F.lit(1), n))
        return F.transform(F.filter(x["n"], lambda n: n <= F.length(path)), lambda n: F.struct(key(n).alias("key"), (F.length(tail) + n).alias("length"), F.length(tail).alias("host_length")))

    return F.flatten(F.transform(F.filter(known, lambda x: x["d"] <= F.size(F.split(host, r"\."))), of_depth))


def url_filters(pages: DataFrame, rules: DataFrame | list[Rule] = RULES) -> DataFrame:
    """One row for each page: page_id, host, path, rule and verdict.

    rules: a table (or list) of verdict (allow or block), host and path. The longest rule
    that fits decides, of equal ones that with the longer host; a url that no list holds is
    allowed, with a null rule. Null urls and urls without :// have empty host and path.
    Rules without a host, and with a path that no url can have, fit nothing. Without rules
    all is allowed. Rows with a null or repeated page_id are judged one by one; columns
    other than page_id and url are not read.
    """
    if isinstance(rules, list):
        rules = pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    parts = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).select("page_id", lower_az(F.regexp_extract("url", URL, 1)).alias("host"), F.regexp_extract("url", URL, 2).alias("path"))
    table = rules.select("verdict", lower_az(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("host <> '' AND verdict IS NOT NULL AND (path = '' OR path LIKE '/%')")
    table = written(table.select("verdict", F.size(F.split("host", r"\.")).alias("depth"), F.length("path").alias("length"), F.concat("host", "path").alias("key")).distinct())
    lengths = dict(table.groupBy("depth").agg(F.sort_array(F.collect_set("length"))).collect())
    offered = parts.withColumn("offers", offers(F.col("host"), F.col("path"), lengths))
    universe = written(offered.select(F.explode("offers.key").alias("key")).distinct())
    cascades = {v: Cascade(universe, table.where(F.col("verdict") == v).select("key"), 1000 * (i + 1)) for i, v in enumerate(sorted(r[0] for r in table.select("verdict").distinct().collect()))}

    def fits(x: Column) -> Column:
        verdicts = F.array_compact(F.array(*(F.when(c.takes(x["key"]), F.lit(v)) for v, c in cascades.items())))
        return F.struct(x["length"].alias("length"), x["host_length"].alias("host_length"), x["key"].alias("rule"), F.array_max(verdicts).alias("verdict"))

    best = F.array_max(F.filter(F.transform("offers", fits), lambda x: x["verdict"].isNotNull())) if cascades else F.lit(None).cast("struct<rule:string,verdict:string>")
    return offered.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


SQL = """
WITH parts AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages),
rules(verdict, rule_host, rule_path) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
judged AS (
    SELECT page_id, host, path,
           (SELECT max(struct_pack(n := length(rule_host || rule_path), rule := rule_host || rule_path, verdict := r.verdict)) FROM rules r
            WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)) AS best
    FROM parts p)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM judged
"""
