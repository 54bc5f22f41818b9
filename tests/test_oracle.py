"""Every registered query against its DuckDB statement, on the smallest test scale."""

import duckdb
import pytest

import __spark_entry__ as entry_module

from carepulse.plans.catalog import QUERIES

from .conftest import SMOKE_DIR

TABLES = ["lineitem", "orders", "supplier", "nation"]
_DUCK_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMOKE_DIR}/{t}.parquet'")
    yield con
    con.close()


def _canonical(pdf):
    cols = sorted(pdf.columns)
    out = pdf[cols].astype(str)
    return out.sort_values(cols).reset_index(drop=True)


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0
    assert df.columns[:4] == ["YEAR", "YEAR_DATE", "provider_state", "service_category"]


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry_module.queries()) and set(QUERIES) <= set(entry_module.oracle_sql())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = entry_module.queries()[name](spark, SMOKE_DIR)
    sql = entry_module.oracle_sql()[name]
    spark_types = {f.name: _DUCK_TYPE.get(f.dataType.simpleString()) for f in df.schema.fields}
    duck_types = {r[0]: r[1] for r in duck.sql(f"DESCRIBE {sql}").fetchall()}
    assert spark_types == duck_types
    got = df.toPandas()
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = _canonical(got), _canonical(want)
    for c in a.columns:
        assert (a[c] == b[c]).all(), (name, c)


def test_check_tool_reports_a_match(spark, capsys):
    from carepulse.plans.check import main

    assert main([SMOKE_DIR, "gold_state_summary"]) == 0
    out = capsys.readouterr().out
    assert "gold_state_summary" in out and "OK" in out and "mismatches: 0" in out
    # The tool joined the test session and left it running.
    assert spark.range(3).count() == 3
