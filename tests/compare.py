"""Run registered queries and their SQL twins side by side and compare all rows.

    python tests/compare.py <sf> [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}".replace("-0.000000", "0.000000")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return repr(value)


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def expected(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, [str(d[1]) for d in cursor.description], cursor.fetchall()


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, otherwise what differs."""
    df = query(spark, sf_dir)
    got = df.collect()
    if sql is None:
        return None if got else "no rows"
    names, types, want = expected(con, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
             "BOOLEAN": "boolean", "FLOAT": "float", "DOUBLE[]": "array<double>",
             "VARCHAR[]": "array<string>", "BIGINT[]": "array<bigint>"}
    mine = dict(df.dtypes)
    wrong = [(n, mine[n], t) for n, t in zip(names, types) if kinds.get(t) != mine[n]]
    a, b = _rows(got, df.columns), _rows(want, names)
    if len(a) != len(b):
        return f"{len(a)} rows, expected {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {sorted(names)} {bad[0]}"
    return f"types {wrong}" if wrong else None


def main():
    import __spark_entry__ as contract
    from cytogrid.session import local_session

    sf_dir = f"{DATA}/sf{sys.argv[1]}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), 0
    sqls = contract.oracle_sql()
    for name, query in contract.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            problem = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        mark = "ok " if problem is None else "BAD"
        kind = "" if name in sqls else " (rows only)"
        print(f"{mark} {name}{kind} {time.time() - began:.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
