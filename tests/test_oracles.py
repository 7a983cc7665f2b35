"""Every query with SQL against DuckDB over the smallest tables, and the entry points."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def normal(rows):
    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return str(v) if v is not None and not isinstance(v, (int, bool)) else v

    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    names = sorted(found.columns)
    want = duck.execute(catalog.oracle_sql()[name])
    assert sorted(x[0] for x in want.description) == names
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert normal(tuple(r) for r in found.select(*names).collect()) == normal(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs_on_whole_tables(spark, name):
    found = catalog.queries()[name](spark, SF)
    assert found.columns and len(found.collect()) > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_and_sql_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.queries()) >= 80
