"""Run queries against their SQL in DuckDB: python tests/compare.py [--dir DIR] NAME..."""

from __future__ import annotations

import glob
import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings tenants users categories posts accounts payments accounts_replica tenants_replica post_lines".split()


def plain(value):
    if isinstance(value, Decimal):
        return round(float(value), 6)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, int):
        return float(value)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(float(x) if isinstance(x := plain(r[i]), int) else x for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = path if not Path(path).is_dir() else path + "/*.parquet"
        if glob.glob(path):
            con.execute(f"create view {t} as select * from '{path}'")
    return con


def compare(spark, sf_dir, query, sql, con):
    """None, or what differs."""
    df = query(spark, sf_dir)
    mine = bag(df.columns, map(tuple, df.collect()))
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    theirs = bag(columns, got.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if mine != theirs:
        return f"rows {mine.total()} and {theirs.total()}; only here {list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from dumpquarry.session import builder

    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--dir"]:
        sf, args = args[1], args[2:]
    spark = builder().config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    for name in args or list(qs):
        if any(x in name for x in ()):
            continue
        t = time.time()
        try:
            if name in sqls:
                said = compare(spark, sf, qs[name], sqls[name], con) or "same"
            else:
                said = f"no SQL, {qs[name](spark, sf).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = "ERROR " + str(e)[:1500]
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
