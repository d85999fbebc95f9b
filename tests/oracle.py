"""Runs a registered query and its SQL side by side."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return str(v)


def compare(db, df, sql: str) -> str | None:
    """None, or what differs."""
    got = df.collect()
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"rows {len(a)} and {len(b)}; first differences {diff}"
    return None
