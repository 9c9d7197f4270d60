"""Every plan of the core that has SQL gives the SQL's rows."""

import datetime
import os
from importlib import import_module

import duckdb
import pytest

MODULES = ["integrity", "relational", "aggregates", "texts", "rules", "retrieval", "documents", "forms"]
PLANS = {k: (f, r.sql.get(k)) for m in MODULES for r in [import_module(f"lectern.plans.{m}").R] for k, f in r.plans.items()}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW \"{f.split('.')[0]}\" AS SELECT * FROM read_parquet('{data}/{f}')")
    return con


def form(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(form(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", [k for k, (_, sql) in PLANS.items() if sql])
def test_plan_gives_the_rows_of_its_sql(spark, duck, data, name):
    plan, sql = PLANS[name]
    df = plan(spark, data)
    cur = duck.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


@pytest.mark.parametrize("name", [k for k, (_, sql) in PLANS.items() if not sql])
def test_plan_without_sql_runs(spark, data, name):
    assert PLANS[name][0](spark, data).columns


def test_entry_has_all(spark):
    import __spark_entry__ as e

    assert set(PLANS) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
