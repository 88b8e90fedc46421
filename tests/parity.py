"""Spark against DuckDB: python tests/parity.py [sf] [names...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cores: int = 2):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    """Values as both engines can give them: whole floats as they are, others to nine digits."""
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.9g}")
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def compare(spark, query, sql: str, d: str) -> str:
    """Empty if both agree, else what differs."""
    df = query(spark, d)
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{d}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, df.collect()), rows(names, res.fetchall())
    if a == b:
        return "" if a else "no rows"
    return f"{len(a)} and {len(b)} rows; first differing: " + str(next(((x, y) for x, y in zip(a, b) if x != y), None))


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf, only = sys.argv[1], sys.argv[2:]
    spark, bad = session(), 0
    q, o = entry.queries(), entry.oracle_sql()
    for name in q:
        if only and not any(name.startswith(x) for x in only):
            continue
        began = time.time()
        try:
            said = compare(spark, q[name], o[name], f"/root/testdata/{sf}") if name in o else f"rows {q[name](spark, f'/root/testdata/{sf}').count()}" * 1
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said) and not said.startswith("rows ")
        print(f"{name}: {said or 'ok'} ({time.time() - began:.1f} s)", flush=True)
    sys.exit(bool(bad))
