"""Runs registered queries against DuckDB on the same Parquet files."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return f"{v + 0.0:.9g}" if v != 0 else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(cell(x) for x in v.values()) + "}"
    return str(v)


def kind(name: str) -> str:
    n = name.lower()
    for group, members in {
        "int": ("int", "integer"), "bigint": ("bigint", "long"), "double": ("double",), "string": ("string", "varchar"),
        "bool": ("boolean",), "date": ("date",),
    }.items():
        if n in members:
            return group
    return n


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark frame and a SQL result; empty when equal."""
    names = sorted(df.columns)
    got_types = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    got = sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
    rel = con.sql(sql)
    cols = list(rel.columns)
    want_types = {c: kind(str(t)) for c, t in zip(cols, rel.types, strict=True)}
    if sorted(cols) != names:
        return [f"columns {names} != {sorted(cols)}"]
    at = [cols.index(c) for c in names]
    want = sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    out = [f"type of {c}: {got_types[c]} != {want_types[c]}" for c in names if got_types[c] != want_types[c]]
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:3]
        out.append(f"values {names}: {bad}")
    return out


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf = sys.argv[1]
    chosen = [a for a in sys.argv[2:]]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf), oracle_sql(), []
    for name, fn in queries().items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                bad = compare(df, con, oracles[name])
                n = ""
            else:
                bad, n = [], f"rows={len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            bad, n = [f"{type(e).__name__}: {str(e)[:600]}"], ""
        print(f"{'ok  ' if not bad else 'FAIL'} {time.time() - t0:6.2f}s {name} {n}", *bad, sep="\n     " if bad else " ", flush=True)
        if bad:
            failed.append(name)
    print("failed:", failed)
