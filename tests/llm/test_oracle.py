"""Queries that SQL can state, against their DuckDB SQL."""

import duckdb
import pytest

import __spark_entry__ as E
from fieldreports.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL

from .cases import ordered


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("table", ["given", "hard"])
def test_matches_sql(spark, hard_dir, name, table):
    base = SF_SMALL if table == "given" else hard_dir
    files = f"{base}/documents.parquet" if table == "given" else f"{base}/documents.parquet/*.parquet"
    con = duckdb.connect()
    # ids and texts are unique together in SQL; the repeated id of the hard cases is not
    where = "" if table == "given" else "WHERE doc_id IS NOT NULL AND doc_id <> 9"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{files}') {where}")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{files.replace('documents', 'benchmark')}')")
    if table == "hard":
        path = f"{base}/unique"
        spark.read.parquet(f"{base}/documents.parquet").where("doc_id IS NOT NULL AND doc_id <> 9").write.mode("overwrite").parquet(f"{path}/documents.parquet")
        spark.read.parquet(f"{base}/benchmark.parquet").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
        base = path
    got = QUERIES[name](spark, base)
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert ordered(got.select(*columns).collect()) == ordered(want.fetchall())
