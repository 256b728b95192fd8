"""Run registered queries against their reference SQL in DuckDB and compare the results.

Usage: python -m tests.compare [sf_dir] [name ...]
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

# Spark type -> DuckDB types with the same values
SAME = {
    "bigint": {"BIGINT"},
    "int": {"INTEGER"},
    "double": {"DOUBLE"},
    "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"},
    "timestamp_ntz": {"TIMESTAMP"},
    "timestamp": {"TIMESTAMP", "TIMESTAMP WITH TIME ZONE"},
    "date": {"DATE"},
}


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v if not isinstance(v, float) or not math.isnan(v) else 0.0) for v in row)


def mismatch(spark_df, con, sql: str) -> str | None:
    """None when equal, otherwise the first difference as text."""
    rel = con.sql(sql)
    types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    names = sorted(spark_df.columns)
    if names != sorted(types):
        return f"columns {names} != {sorted(types)}"
    for field, kind in spark_df.dtypes:
        if types[field] not in SAME.get(kind, {kind}):
            return f"type of {field}: {kind} != {types[field]}"
    order = [rel.columns.index(n) for n in names]
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=_key)
    got = sorted((tuple(r) for r in spark_df.select(*names).collect()), key=_key)
    if len(want) != len(got):
        return f"{len(got)} rows != {len(want)}"
    for g, w in zip(got, want):
        if g != w:
            return f"{names}: {g} != {w}"
    return None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from voxelith.session import local_session

    root = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session("compare", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(root), []
    todo = argv[1:] or list(queries())
    for name in todo:
        start = time.time()
        try:
            df = queries()[name](spark, root)
            sql = oracle_sql().get(name)
            if sql is None:
                problem, note = None, f"rows only: {df.count()}"
            else:
                problem, note = mismatch(df, con, sql), f"{con.sql(sql).shape[0]} rows"
        except Exception as error:  # report and go on with the next query
            problem, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        print(f"{'ok ' if problem is None else 'BAD'} {name:34s} {time.time() - start:6.2f}s {note} {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print(f"{len(todo) - len(bad)}/{len(todo)} equal; bad: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
