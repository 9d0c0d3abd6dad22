"""Order-insensitive comparison of a Spark result with a DuckDB result (same rules as tools/oracle_check)."""

import datetime as dt
import math
from decimal import Decimal


def canon(v):
    if v is None:
        return ("~null",)
    if isinstance(v, float):
        return ("~nan",) if math.isnan(v) else round(v, 9)
    if isinstance(v, Decimal):
        return round(float(v), 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in data), key=repr)


def duck(sf_dir):
    import duckdb
    from paysift.sources.tables import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def assert_same(spark_df, con, sql):
    scols = spark_df.columns
    srows = [tuple(r) for r in spark_df.collect()]
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(scols) == sorted(dcols), (sorted(scols), sorted(dcols))
    assert len(srows) == len(drows), (len(srows), len(drows))
    a, b = rows(scols, srows), rows(dcols, drows)
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    assert not diff, diff
