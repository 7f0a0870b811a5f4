"""Every core query against its SQL on the smallest tables; those without SQL must run."""

import importlib

import pytest

import __spark_entry__ as entry

MODULES = [importlib.import_module(m) for m in entry.CORE]
SQL = [(m, n) for m in MODULES for n in m.ORACLE]
RUN = [(m, n) for m in MODULES for n in m.QUERIES if n not in m.ORACLE]


@pytest.mark.parametrize("module, name", SQL, ids=[n for _, n in SQL])
def test_sql(module, name, same):
    same(module.QUERIES[name], module.ORACLE[name])


@pytest.mark.parametrize("module, name", RUN, ids=[n for _, n in RUN])
def test_runs(module, name, spark, sf_dir):
    df = module.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
