"""Compare registered queries with their SQL on one folder of tables.

    python tests/oracle_check.py [folder] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lurewatch.session import local_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, int):
        return str(value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


FAMILIES = {
    "tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "long",
    "hugeint": "huge", "double": "double", "float": "float", "varchar": "string",
    "string": "string", "boolean": "boolean",
}


def compare(spark, con, folder, query, sql) -> str:
    start = time.time()
    df = query(spark, folder)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return f"rows only: {len(got)} ({took:.1f}s)"
    result = con.execute(sql)
    description = result.description
    columns = [c[0] for c in description]
    names2, want = rows_of(columns, result.fetchall())
    if names != names2:
        return f"FAIL columns {names} != {names2}"
    types = {k: FAMILIES.get(v, v) for k, v in df.dtypes}
    types2 = {c[0]: FAMILIES.get(str(c[1]).lower(), str(c[1])) for c in description}
    note = "" if types == types2 else (
        " types " + str({k: (types[k], types2[k]) for k in types if types[k] != types2[k]})
    )
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        lacking = [r for r in want if r not in set(got)][:2]
        return f"FAIL {len(got)} vs {len(want)} rows{note}\n  columns {names}\n  spark {extra}\n  sql   {lacking}"
    return f"ok {len(got)} rows ({took:.1f}s){note}"


def main() -> None:
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, sql = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    spark, con = local_session(), connect(folder)
    for name in wanted:
        try:
            outcome = compare(spark, con, folder, queries[name], sql.get(name))
        except Exception as problem:  # noqa: BLE001
            outcome = f"ERROR {type(problem).__name__}: {str(problem)[:600]}"
        print(f"{name}: {outcome}", flush=True)
    print("without SQL:", sorted(set(queries) - set(sql)), "unknown SQL:", sorted(set(sql) - set(queries)))


if __name__ == "__main__":
    main()
