import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sifterra.plans import queries as engine

DATA = "/root/testdata/sf0.001"


def as_rows(frame: pd.DataFrame) -> list:
    tidy = lambda v: None if not isinstance(v, list) and pd.isna(v) else round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(map(tidy, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


def oracle(sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con.execute(sql).fetchdf()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", engine.QUERIES)
def test_query_against_sql(spark, name):
    got = engine.QUERIES[name](spark, DATA).toPandas()
    if name in engine.ORACLES:
        want = oracle(engine.ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert as_rows(got) == as_rows(want)
    else:
        assert len(got)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
