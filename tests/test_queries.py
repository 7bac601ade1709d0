"""Every registered query of the claims engine against its SQL in DuckDB, at the smallest scale."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__
from loamstone.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 8)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, oracle, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = oracle.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert found == expected


def test_served_facts_of_empty_texts(spark, tmp_path):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        at = tmp_path / os.path.basename(f)
        if at.name == "documents.parquet":
            con.execute(f"copy (select * replace (case doc_id % 10 when 4 then '' when 7 then null else text end as text) from '{f}') to '{at}'")
        else:
            at.symlink_to(f)
        con.execute(f"create view {at.stem} as select * from '{at}'")
    df = registry.QUERIES["served_facts"](spark, str(tmp_path))
    result = con.execute(f"select {', '.join(df.columns)} from ({registry.ORACLE_SQL['served_facts']}) order by id").fetchall()
    assert [tuple(r) for r in df.orderBy("id").collect()] == result
    assert not any("source_quote" in (r[1] or "") for r in result if r[0] % 13)


def test_queries_without_sql_run(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLE_SQL):
        assert registry.QUERIES[name](spark, DATA).columns


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
