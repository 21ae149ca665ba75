"""Every training-data query that has SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from courtside.llm import queries as llm

DATA = Path("/root/testdata/sf0.001")


def rows(names, values):
    plain = lambda v: ("nan" if math.isnan(v) else f"{v + 0.0:.6g}") if isinstance(v, float) else str(v)
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    got, cursor = llm.QUERIES[name](spark, str(DATA)), duck.execute(llm.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, cursor.fetchall())
