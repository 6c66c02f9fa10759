"""Run a query and its SQL on the same tables and compare every cell."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_NAMES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def compare(df, con, sql: str) -> list[str]:
    """Differences as text; an empty list means equal."""
    out = con.execute(sql)
    sql_cols = {d[0]: str(d[1]) for d in out.description}
    spark_cols = {f.name: _NAMES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if spark_cols != sql_cols:
        return [f"columns: spark {spark_cols} sql {sql_cols}"]
    names = sorted(spark_cols)
    at = [list(sql_cols).index(n) for n in names]
    theirs = Counter(tuple(_cell(r[i]) for i in at) for r in out.fetchall())
    ours = Counter(tuple(_cell(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect())
    if ours == theirs:
        return [] if ours else ["no rows"]
    only_spark, only_sql = ours - theirs, theirs - ours
    found = [f"rows: spark {sum(ours.values())} sql {sum(theirs.values())}; columns {names}"]
    found += [f"only spark {str(r)[:600]}" for r in list(only_spark)[:3]]
    found += [f"only sql   {str(r)[:600]}" for r in list(only_sql)[:3]]
    return found
