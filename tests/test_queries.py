"""Each query over the fixed graphs against its SQL in DuckDB."""

import math
from pathlib import Path

import pytest

from strandgraph.plans.oracle import oracle_sql
from strandgraph.plans.queries import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v
    return [columns[k] for k in order], sorted((tuple(repr(clean(r[k])) for k in order) for r in rows))


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, str(DATA))
    found = df.collect()
    assert df.columns
    if name in oracle_sql():
        r = duck.sql(oracle_sql()[name])
        assert table(df.columns, found) == table(r.columns, r.fetchall())
    else:
        assert name == "section_bit_budget"
        assert found


def test_no_sql_without_query():
    assert not set(oracle_sql()) - set(queries())
