"""Comparing a query with its SQL on the same files."""

from __future__ import annotations

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (bytearray, memoryview)):
        return bytes(value)
    if isinstance(value, list):
        return [normal(v) for v in value]
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def oracle(sql: str, folder: str = SF):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in sorted(os.listdir(folder)):
        t = name.removesuffix(".parquet")
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{name}{'/*.parquet' if os.path.isdir(f'{folder}/{name}') else ''}')")
    c.execute(sql)
    names = [x[0] for x in c.description]
    return sorted(names), rows_of(names, c.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def assert_same(df, sql: str, folder: str = SF) -> int:
    have, want = spark_rows(df), oracle(sql, folder)
    assert have[0] == want[0], (have[0], want[0])
    extra, missing = set(map(repr, have[1])) - set(map(repr, want[1])), set(map(repr, want[1])) - set(map(repr, have[1]))
    assert have[1] == want[1], f"{len(have[1])} rows for {len(want[1])}; extra {sorted(extra)[:3]}, missing {sorted(missing)[:3]}"
    return len(have[1])
