"""Every query of the library that has SQL gives the same rows in DuckDB, over the same tables."""

from __future__ import annotations

import datetime as dt
import math
import os
from pathlib import Path

import pytest

from skeinflow.plans import appointments, items, linkage, measures, selection, stories, texts  # noqa: F401 - they register their queries
from skeinflow.plans.registry import FLAGSHIP, ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    """A value as it compares: whole numbers alike, NaN as text, times without a zone, numbers to 12 digits."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def in_duckdb(sql: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(sql)
    return rows_of([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_duckdb(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    mine, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), in_duckdb(ORACLE_SQL[name])
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert [x for x in zip(mine[1], theirs[1], strict=True) if x[0] != x[1]][:3] == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_without_sql_run(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.columns and len(df.columns) == len(set(df.columns))
    assert df.count() > 0


def test_flagship_has_rows(spark):
    assert QUERIES[FLAGSHIP](spark, SF_DIR).count() > 0
