"""Run registered queries next to their SQL twins in DuckDB and compare values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(r[i] for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)) if v is None else "", repr(v)) for v in r))


def same(a, b, tol=0.0):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        if isinstance(a, float) and math.isnan(a):
            return isinstance(b, float) and math.isnan(b)
        return a == b or abs(a - b) <= tol
    return a == b


def compare(spark, con, sf_dir, fn, sql):
    """(status, detail, spark seconds, duckdb seconds)"""
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols, types = df.columns, dict(df.dtypes)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return "rows-only", f"{len(got)} rows {cols}", t1 - t0, 0.0
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    if sorted(names) != sorted(cols):
        return "FAIL", f"columns {sorted(cols)} vs {sorted(names)}", t1 - t0, t2 - t1
    expect = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    off = [(c, types[c], kinds[c]) for c in cols if expect.get(types[c]) != kinds[c]]
    a, b = rows_of(cols, got), rows_of(names, want)
    if len(a) != len(b):
        return "FAIL", f"{len(a)} rows vs {len(b)}", t1 - t0, t2 - t1
    exact = sum(all(same(x, y) for x, y in zip(r, s)) for r, s in zip(a, b))
    if exact != len(a):
        bad = [(r, s) for r, s in zip(a, b) if not all(same(x, y) for x, y in zip(r, s))]
        return "FAIL", f"{len(bad)}/{len(a)} rows differ: {sorted(cols)} {bad[0]}", t1 - t0, t2 - t1
    note = f"{len(a)} rows" + (f" TYPES {off}" if off else "")
    return ("TYPES" if off else "ok"), note, t1 - t0, t2 - t1


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from posefarm.session import local_session

    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    spark = local_session(8, 8)
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not wanted or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    bad = 0
    for n in names:
        try:
            status, detail, s, d = compare(spark, con, sf, queries[n], sqls.get(n))
        except Exception as e:  # noqa: BLE001
            status, detail, s, d = "ERROR", str(e).replace("\n", " ")[:700], 0, 0
        bad += status not in ("ok", "rows-only")
        print(f"{status:10s} {n:36s} {s:6.2f}s {d:6.2f}s {detail[:900]}", flush=True)
    print("bad:", bad, "of", len(names))
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
