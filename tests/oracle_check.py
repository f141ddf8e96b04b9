"""Compare plans with their SQL on DuckDB: python tests/oracle_check.py [sf] [name ...]."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b
    return a == b and type(a) is type(b)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), "rows only"
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return len(got), f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return len(got), f"row count {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if not all(close(p, q) for p, q in zip(x, y))]
    if bad:
        return len(got), f"{len(bad)} rows differ, columns {sorted(cols)}, first spark {bad[0][0]} sql {bad[0][1]}"
    return len(got), "ok"


def main():
    import __spark_entry__ as e
    from conftest import make_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_session(), duck(sf_dir)
    q, o = e.queries(), e.oracle_sql()
    failed = []
    for name, fn in q.items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            n, verdict = compare(spark, con, name, fn, o.get(name), sf_dir)
        except Exception as ex:  # report and go on
            n, verdict = -1, "ERROR " + str(ex)[:600]
            if names:
                traceback.print_exc()
        print(f"{name:34s} rows={n:<7d} {time.time() - t:6.2f}s  {verdict}", flush=True)
        if verdict not in ("ok", "rows only"):
            failed.append(name)
    print("FAILED:", failed, "of", len(q))
    spark.stop()


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    main()
