"""Every registered query against its independent DuckDB oracle (the driver's check)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from harness import compare, duck
from mise.plans.registry import load_all

# the optional subpackage brings its own tests
QUERIES = {name: fn for name, (fn, _sql) in load_all().items()}
ORACLE = {name: sql for name, (_fn, sql) in load_all().items() if sql is not None}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    missing = sorted(set(QUERIES) - set(ORACLE))
    assert missing == [], missing


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "recipe_id" in df.columns


# Spark type -> the DuckDB type the oracle must produce for the same column
SAME_TYPE = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
             "date": "DATE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    problems = compare(df, con, ORACLE[name])
    assert not problems, "\n".join(problems)
    rel = con.sql(ORACLE[name])
    duck_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    for f in df.schema.fields:      # no decimals, timestamps or nested values in reports
        assert SAME_TYPE.get(f.dataType.simpleString()) == duck_types[f.name], (name, f.name)
