"""Every registered query against its DuckDB oracle at sf0.001 (the driver
repeats this at sf0.01): row count, column names, order-insensitive values."""

import json
import math

import duckdb
import pytest

import __spark_entry__ as E
from fieldreports.plans.oracle import ORACLE
from fieldreports.plans.queries import QUERIES
from fieldreports.sources.tables import TABLE_NAMES

from .conftest import SF_SMALL


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(json.dumps([_norm(r[i]) for i in order], default=str) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    """Registered form: the facts written once per session, then scanned."""
    _check(E.queries()[name](spark, SF_SMALL), duck, name)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_lazy_derivation_matches_oracle(spark, duck, name):
    """Same query over the lazily derived facts (fixture joins in the plan)."""
    from fieldreports.sources import FactSource

    _check(QUERIES[name](FactSource.shared(spark, SF_SMALL, written=False)), duck, name)


DUCK_TO_SPARK = {"BIGINT": "bigint", "VARCHAR": "string", "INTEGER": "int", "DOUBLE": "double", "DATE": "date"}


def _check(df, duck, name):
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(scols) == sorted(ocols)
    stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert stypes == {d[0]: DUCK_TO_SPARK.get(str(d[1]), str(d[1])) for d in cur.description}
    assert len(srows) == len(orows)
    assert _canon(srows, scols) == _canon(orows, ocols)
