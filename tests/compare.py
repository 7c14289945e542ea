"""Compare a Spark result with DuckDB: names, type families, rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6f}".replace("-0.000000", "0.000000")
    return str(v)


def _family(t: str) -> str:
    t = t.lower()
    if t.startswith(("bigint", "int", "long", "smallint", "tinyint", "hugeint", "ubigint")):
        return t.replace("integer", "int")
    if t.startswith(("varchar", "string")):
        return "string"
    if t.startswith("timestamp"):
        return "timestamp"
    if t.startswith("decimal"):
        return "decimal"
    return t


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    if sorted(df.columns) != cols:
        return f"columns {sorted(df.columns)} != {cols}"
    theirs_t = dict(zip(rel.columns, [str(t) for t in rel.types]))
    types = [f"{c}: {t} vs {theirs_t[c]}" for c, t in df.dtypes if _family(t) != _family(theirs_t[c])]
    theirs = sorted(tuple(_cell(v) for v in r)
                    for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    mine = sorted(tuple(_cell(r[c]) for c in cols) for r in df.select(*cols).collect())
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ in {cols}, e.g. {bad[:2]}"
    if types:
        return "types: " + "; ".join(types)
    return None
