"""Every registered query runs; those with SQL agree with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from speechjobs.plans.queries import ORACLE, QUERIES  # the entry has registered those of the other modules

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else str(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert rows
    if name in ORACLE:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        found = con.execute("select {} from ({})".format(", ".join(f'"{c}"' for c in columns), ORACLE[name])).fetchall()
        assert plain(rows) == plain(found)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
