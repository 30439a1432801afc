"""Every registered query of this package against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from dropletry.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    found = catalogue.QUERIES[name](spark, FOLDER)
    wanted = db.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(columns)
    key = lambda row: tuple(str(x) for x in row)
    rows = sorted((tuple(r) for r in found.select(*columns).collect()), key=key)
    assert rows == sorted(wanted.fetchall(), key=key)
    assert rows


def test_clustering_runs_to_calls(spark):
    rows = catalogue.QUERIES["em_full"](spark, FOLDER).collect()
    assert rows and {r["type"] for r in rows} <= {"SNG", "DBL", "AMB"}


@pytest.mark.parametrize("name", ["geno_error_mix", "pl_posterior"])
def test_rows_of_variants_are_not_broadcast(spark, name):
    assert "Broadcast" not in catalogue.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
