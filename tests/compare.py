"""Runs registered queries in Spark and their oracle SQL in DuckDB and compares all values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def kind(v):
    return "null" if v is None else type(v).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(name, df, con, sql):
    s_names, s_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    d_names, d_rows = rows_of([d[0] for d in cur.description], cur.fetchall())
    problems = []
    if s_names != d_names:
        problems.append(f"columns: only spark {set(s_names) - set(d_names)}, only sql {set(d_names) - set(s_names)}")
    elif len(s_rows) != len(d_rows):
        problems.append(f"rows {len(s_rows)} vs {len(d_rows)}")
    else:
        bad = {}
        for a, b in zip(s_rows, d_rows):
            for n, x, y in zip(s_names, a, b):
                if x != y or (kind(x) != kind(y)):
                    bad.setdefault(n, []).append((x, y, a[:3]))
        problems += [f"{n}: {len(v)} differ, e.g. {v[0]}" for n, v in bad.items()]
    return len(s_rows), problems


def session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv):
    import __spark_entry__ as entry

    sf = argv[0] if argv else "/root/testdata/sf0.001"
    wanted = argv[1:]
    spark, con = session(), duck(sf)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                n, problems = compare(name, fn(spark, sf), con, sqls[name])
            else:
                n, problems = len(fn(spark, sf).collect()), ["(no oracle)"]
        except Exception as e:  # noqa: BLE001
            n, problems = -1, [f"{type(e).__name__}: {str(e)[:700]}"]
        real = [p for p in problems if p != "(no oracle)"]
        bad += bool(real)
        print(f"{'BAD ' if real else 'ok  '}{name:44s} rows={n:<7d} {time.time() - t:5.1f}s {' | '.join(problems)[:900]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
