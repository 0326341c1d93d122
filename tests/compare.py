"""Runs registered queries against their SQL twins and reports differences."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return value
    if value is None:
        return None
    if isinstance(value, (int,)):
        return float(value) if abs(value) < 2**53 else value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(rows, key=repr)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    spark_cols, spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    duck_cols, duck_rows = rows_of(rel.columns, rel.fetchall())
    problems = []
    if spark_cols != duck_cols:
        problems.append(f"columns {spark_cols} vs {duck_cols}")
    if len(spark_rows) != len(duck_rows):
        problems.append(f"rows {len(spark_rows)} vs {len(duck_rows)}")
    if not problems and spark_rows != duck_rows:
        left, right = set(spark_rows) - set(duck_rows), set(duck_rows) - set(spark_rows)
        problems.append(f"{len(left)} rows differ")
        for a, b in list(zip(sorted(left, key=repr), sorted(right, key=repr)))[:4]:
            diff = [(c, x, y) for c, x, y in zip(spark_cols, a, b) if x != y]
            problems.append(f"   {a[:6]}: {diff[:8]}")
    return len(spark_rows), problems


def main(argv):
    import __spark_entry__ as entry
    from urlsieve.session import build_session

    sf_dir = f"/root/testdata/{argv[0] if argv else 'sf0.01'}"
    # names to run, by substring; a leading "-" leaves names out
    wanted = [w for w in argv[1:] if not w.startswith("-")]
    unwanted = [w[1:] for w in argv[1:] if w.startswith("-")]
    spark = build_session(
        master="local[8]",
        conf={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
              "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, twins = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted) or any(w in name for w in unwanted):
            continue
        start = time.time()
        try:
            if name in twins:
                n, problems = compare(spark, con, sf_dir, fn, twins[name])
            else:
                n, problems = len(fn(spark, sf_dir).collect()), ["(rows only)"]
        except Exception as error:  # noqa: BLE001
            n, problems = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
        ok = not problems or problems == ["(rows only)"]
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:28s} {n:8d} rows {time.time() - start:6.2f}s {' '.join(problems) if ok else ''}", flush=True)
        if not ok:
            print("\n".join(problems), flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
