"""Operator 10: secret scans by an incremental ledger of blobs, in DataFrame functions only.

Every version of a text is addressed by its SHA-256. The ledger holds a row for each
blob and rule version that has been scanned, with its spans. A scan takes the blobs
that the ledger lacks, once each however many paths hold them, adds them to it, and
joins the spans back to all paths.

Spans come from cutting a text at a kind's pattern: the lengths of the pieces between
and of the matches give the places, added up over a window of the blob and kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonogrid.llm.common import scratch, whole, written

# Kinds in order, their patterns, the group whose length counts, and the least length.
# A run that is taken whole and then dropped for its length gives the same spans as a pattern with that length in it.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
KEY_HEADER = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
# A key runs to its END line, over nothing that looks like another header; where that is missing, over its lines of base64. Of whatever
# length: possessive groups are matched in a loop, without recursion, and never a second time.
KEY_BODY = r"""(?:(?:[A-Za-z0-9+/=\s:,.@_()\\"'>#*;]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{40,}+={0,2}+)++(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]++={1,2}+)?+)?+"""
ADDED = [
    ("key_block", KEY_HEADER + KEY_BODY, 0, 1),
    ("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
]
KINDS = BASE + ADDED
RULE_VERSION = 3
FOUND = "array<struct<start:bigint,kind:int,end:bigint>>"


def measured(k: int, least: int) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("hit"), (F.length(x["counted"]) >= least).alias("ok"))


def of_kind(k: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == k


def pieces(text: Column) -> Column:
    """For each match of each kind: kind, its ordinal, the lengths of the piece before it, of the match, and whether it is long enough."""
    out = []
    for k, (_, pattern, group, least) in enumerate(KINDS):
        gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        zipped = F.transform(F.arrays_zip(hits.alias("hit"), counted.alias("counted"), F.slice(gaps, 1, F.size(hits)).alias("gap")), measured(k, least))
        out.append(F.when(text.rlike(pattern), zipped).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:bigint,hit:bigint,ok:boolean>>")))
    return F.concat(*out)


def scan(blobs: DataFrame) -> DataFrame:
    """sha and spans, sorted by start and kind, of each blob (sha, text) that has any."""
    hits = blobs.select("sha", F.explode(pieces(F.col("text"))).alias("p")).select("sha", "p.*").dropDuplicates(["sha", "kind", "i"])
    before = Window.partitionBy("sha", "kind").orderBy("i")
    placed = hits.withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(before)).where("ok")
    return placed.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct((F.col("end") - F.col("hit")).alias("start"), "kind", "end"))).cast(FOUND).alias("spans"))


def read_ledger(docs: DataFrame, path: str) -> DataFrame:
    spark, kind = docs.sparkSession, f"sha binary, rule_version int, spans {FOUND}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(kind).parquet(path) if there else spark.createDataFrame([], kind)


def ledger_scan(docs: DataFrame, ledger: str | None = None, rule_version: int = RULE_VERSION, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (doc_id if not said) and spans (never null) of each row, after bringing the ledger (a path that all executors share) up to date.

    Each row is a path and a version. A null text counts as empty. Rows with a null or
    repeated doc_id each get the spans of their own text. Without a path the ledger is new.
    """
    ledger = ledger or scratch(docs.sparkSession)
    versions = whole(docs, "doc_id").withColumn("sha", F.unhex(F.sha2("text", 256)))
    seen = read_ledger(docs, ledger).where(F.col("rule_version") == rule_version)
    first = versions.groupBy("sha").agg(F.min("doc_id").alias("first")).join(seen.select("sha"), "sha", "left_anti")
    unseen = written(first)
    texts = versions.alias("v").join(unseen.alias("u"), F.col("v.doc_id").eqNullSafe(F.col("u.first")) & (F.col("v.sha") == F.col("u.sha"))).select("v.sha", "text")
    fresh = unseen.select("sha").join(scan(texts), "sha", "left").select("sha", F.lit(rule_version).alias("rule_version"), "spans")
    fresh.write.mode("append").parquet(ledger)
    # Writers that ran twice or side by side leave a blob's row twice, with the same spans.
    found = read_ledger(docs, ledger).where((F.col("rule_version") == rule_version) & F.col("spans").isNotNull()).select("sha", "spans").dropDuplicates(["sha"])
    rows = docs.select(*[F.col(c) for c in keep or ["doc_id"]], F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("blob"))
    return rows.join(found, rows["blob"] == found["sha"], "left").select(*(keep or ["doc_id"]), F.coalesce("spans", F.array().cast(FOUND)).alias("spans"))


def told(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scans(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """One row for each document: doc_id, the numbers of base spans, base_sha256 and spans. See ledger_scan() for nulls and repeated rows."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    n = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{BASE[k][0]}") for k in range(len(BASE))]
    return ledger_scan(docs, ledger).select("doc_id", *n, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with each run of spans replaced by the mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a, s):
        kept = F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))
        return F.when(s["start"] >= a["at"], F.struct(kept.alias("out"), s["end"].alias("at"))).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at")))

    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def sql() -> str:
    """DuckDB's SQL for secret_scans(), for texts without private keys: of these it tells the header only."""
    parts = []
    for k, (name, pattern, group, least) in enumerate(KINDS):
        pattern = pattern.removesuffix(KEY_BODY)
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT r, {k} AS kind, '{name}' AS name, i, length(gaps[i]) AS gap, length(hits[i]) AS hit, length(counted[i]) >= {least} AS ok FROM "
            f"(SELECT r, gaps, hits, counted, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT r, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {group}) AS counted FROM docs))"
        )
    numbers = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{BASE[k][0]}" for k in range(len(BASE)))
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT *, sum(gap + hit) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM hits),
spans AS (SELECT r, kind, (e - hit)::BIGINT AS s, name || ':' || (e - hit)::BIGINT || ':' || e::BIGINT AS told FROM placed WHERE ok),
told AS (SELECT r, {numbers}, string_agg(told, ',' ORDER BY s, kind) FILTER (kind < {len(BASE)}) AS base, string_agg(told, ',' ORDER BY s, kind) AS spans FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k[0]}, 0)::BIGINT AS n_{k[0]}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (r)
"""
