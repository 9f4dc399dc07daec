"""Compare registered queries with their SQL on the given tables.

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

import argparse
import collections
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations").split()
KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
}


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when names, types and rows agree, else what differs first."""
    result = con.execute(sql)
    theirs = {d[0]: str(d[1]) for d in result.description}
    ours = {n: KINDS.get(t, t) for n, t in df.dtypes}
    if set(ours) != set(theirs):
        return f"columns {sorted(ours)} != {sorted(theirs)}"
    kinds = {n: (ours[n], theirs[n]) for n in ours if ours[n] != theirs[n]
             and not ours[n].startswith("array")}
    rows = result.fetchall()
    want = _bag(list(theirs), rows)
    got = _bag(df.columns, [tuple(r) for r in df.collect()])
    if got != want:
        return (f"rows {sum(got.values())} != {sum(want.values())}; ours only "
                f"{list((got - want).items())[:3]}; theirs only {list((want - got).items())[:3]}")
    if kinds:
        return f"types {kinds}"
    return None if rows else "no rows"


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    from gridwarden.session import build_session
    spark = build_session(master="local[8]", spark__ui__enabled="false",
                          spark__sql__shuffle__partitions=8, spark__driver__memory="8g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args.names or queries:
        began = time.time()
        try:
            df = queries[name](spark, args.sf)
            wrong = compare(df, con, sqls[name]) if name in sqls else f"no SQL, {df.count()} rows"
        except Exception as e:  # report and go on with the next query
            wrong = f"{type(e).__name__}: {str(e)[:1500]}"
        good = wrong is None or wrong.startswith("no SQL")
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name} {time.time() - began:.1f}s {wrong or ''}",
              flush=True)
    print(f"{failed} failed")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
