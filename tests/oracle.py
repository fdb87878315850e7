"""Runs a checked query in Spark and its text in DuckDB, and compares them."""

from __future__ import annotations

import sys
import time

import duckdb

from siftstone.plans import catalog
from siftstone.plans.views import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return connection


KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, connection, sf_dir: str, name: str) -> str:
    """'' when rows, names and types agree, else what differs."""
    run, text = catalog.ENTRIES[name]
    started = time.time()
    ours = run(spark, sf_dir)
    columns = sorted(ours.columns)
    kinds = {field.name: field.dataType.simpleString() for field in ours.schema.fields}
    mine = [tuple(row[c] for c in columns) for row in ours.collect()]
    took = time.time() - started
    if text is None:
        return "" if mine else "no rows"
    started = time.time()
    relation = connection.execute(text)
    names = [column[0] for column in relation.description]
    types = {column[0]: str(column[1]) for column in relation.description}
    rows = relation.fetchall()
    if "-v" in sys.argv:
        print(f"{name}: spark {took:.1f}s duckdb {time.time() - started:.1f}s rows {len(mine)}", flush=True)
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    theirs = [tuple(row[names.index(c)] for c in columns) for row in rows]
    wrong = [(c, kinds[c], types[c]) for c in columns if KINDS.get(kinds[c], kinds[c]) != types[c]]
    if wrong:
        return f"types {wrong}"
    key = lambda row: tuple((value is not None, str(type(value)), value) for value in row)
    mine, theirs = sorted(mine, key=key), sorted(theirs, key=key)
    if len(mine) != len(theirs):
        extra = [row for row in mine if row not in set(theirs)][:2], [row for row in theirs if row not in set(mine)][:2]
        return f"rows {len(mine)} != {len(theirs)}: {str(extra)[:600]}"
    if not mine:
        return "both empty"
    for left, right in zip(mine, theirs):
        if left != right:
            bad = sum(a != b for a, b in zip(mine, theirs))
            return f"{bad}/{len(mine)} rows differ, {columns}: {str(left)[:400]} != {str(right)[:400]}"
    return ""


if __name__ == "__main__":
    from siftstone.session import local_session

    args = [a for a in sys.argv[1:] if a != "-v"]
    sf = args[0]
    spark, connection = local_session(8), duck(sf)
    for name in args[1:] or list(catalog.ENTRIES):
        try:
            problem = compare(spark, connection, sf, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        if problem:
            print("FAIL", name, problem, flush=True)
