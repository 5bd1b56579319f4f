"""Compare a Spark result with its SQL equivalent in DuckDB, value by value."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    return v


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a description."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    rows = cur.fetchall()
    order = sorted(names)
    if sorted(df.columns) != order:
        return f"columns: spark {sorted(df.columns)} sql {order}"
    spark_kinds = dict(df.dtypes)
    wrong = {c: (spark_kinds[c], kinds[c]) for c in order if KINDS.get(spark_kinds[c], spark_kinds[c]) != kinds[c]}
    if wrong:
        return f"types: {wrong}"
    a = Counter(tuple(_norm(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    b = Counter(tuple(_norm(r[i]) for i in at) for r in rows)
    if a != b:
        left, right = list((a - b).elements()), list((b - a).elements())
        return (f"rows: spark {sum(a.values())} sql {sum(b.values())}, {len(left)} only in spark, {len(right)} only in sql\n"
                f"  {order}\n  spark {sorted(left, key=repr)[:3]}\n  sql   {sorted(right, key=repr)[:3]}")
    if not rows and not os.environ.get("ALLOW_EMPTY"):
        return "both empty"
    return None
