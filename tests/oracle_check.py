"""Runs registered queries beside their DuckDB text and compares names, counts and values."""

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, query, sql):
    started = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if sql is None:
        return seconds, len(got), "rows-only" if got else "EMPTY"
    rel = con.sql(sql)
    names, want = rel.columns, rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return seconds, len(got), f"COLUMNS {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return seconds, len(got), f"COUNT {len(got)} != {len(want)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return seconds, len(got), f"VALUES {len(bad)} differ, first {bad[0]}"
    return seconds, len(got), "ok" if got else "EMPTY"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from tidelog.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, query in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            seconds, n, verdict = compare(spark, con, sf_dir, name, query, oracles.get(name))
        except Exception as exc:
            seconds, n, verdict = 0.0, 0, "FAILED " + str(exc)[:700]
        print(f"{name:40s} {seconds:6.2f}s {n:7d} {verdict[:900]}", flush=True)
