"""Runs registered queries beside their SQL twin and compares whole results.

    python -m tests.compare [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 9)
        return v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, fn, sql, sf_dir):
    """Empty text when both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = dict(zip(names, [str(d[1]) for d in cur.description]))
    want = canonical(cur.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(got)
    spark_kinds = dict(df.dtypes)
    alike = {"BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double", "INTEGER": "int"}
    odd = [(n, spark_kinds[n], kinds[n]) for n in names if alike.get(kinds[n], "?") != spark_kinds[n]]
    note = f"types {odd}" if odd else ""
    if got == want:
        return note, len(got)
    bad = sorted(df.columns)
    mine, theirs = set(map(repr, got)), set(map(repr, want))
    only = sorted(mine - theirs)[:3], sorted(theirs - mine)[:3]
    return f"{note} rows {len(got)} vs {len(want)}; {bad}\n  spark only {only[0]}\n  sql only   {only[1]}", len(got)


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as contract
    from skyledger.session import local_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), duck(sf_dir)
    qs, sqls = contract.queries(), contract.oracle_sql()
    names = [n for n in qs if not argv[1:] or any(n == a or n.startswith(a.rstrip("*")) and a.endswith("*") for a in argv[1:])]
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in sqls:
                text, n = differences(spark, con, qs[name], sqls[name], sf_dir)
            else:
                text, n = "", qs[name](spark, sf_dir).count()
        except Exception as error:  # report every query, then fail
            text, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        if text:
            failed.append(name)
        kind = "sql " if name in sqls else "rows"
        print(f"{'FAIL' if text else 'ok  '} {kind} {name:32s} {n:8d} rows {time.time() - start:6.2f}s {text}", flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
