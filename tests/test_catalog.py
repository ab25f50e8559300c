"""Every query of the catalogue runs; those with SQL give the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from lumenspark.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return repr(round(float(x), 7)) if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)

    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    if name in ORACLES:
        result = db.execute(ORACLES[name])
        assert got == rows_of(result.fetchall(), [x[0] for x in result.description])
