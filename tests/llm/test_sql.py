"""The numbered queries that are new with their SQL, over the same tables."""

from pathlib import Path

import duckdb
import pytest

from skeinflow.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_hard_negatives"])
def test_same_rows_as_duckdb(spark, name):
    con = duckdb.connect()
    for p in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(map(tuple, found.fetchall()))
