"""The driver contract of __spark_entry__.py."""

import importlib.util
import os

import oracle

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry_module():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_flagship(spark):
    df = _entry_module().entry(spark)
    assert df.columns == ["date", "new_jobs", "removed_jobs", "total_jobs", "new_delta", "removed_delta"]
    assert df.count() > 0


def test_queries_and_sql_align(spark, sf):
    mod = _entry_module()
    qs, sql = mod.queries(), mod.oracle_sql()
    own = mod.catalog.queries()
    assert own and set(own) <= set(qs) and set(own) == set(sql) & set(own) and set(sql) <= set(qs)
    con = oracle.duck(sf)
    for name, fn in own.items():
        cols = fn(spark, sf).columns
        assert len(cols) == len(set(cols)), name
        assert sorted(con.sql(sql[name]).columns) == sorted(cols), name
