"""Every registered query against its reference SQL, on the smallest tables."""

import glob
import os
import sys

import duckdb
import pytest

from lexmill.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_reference_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_module(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_training_part(monkeypatch):
    """With the subpackage of training-data operators gone, all other queries are there, pipeline or not."""
    import __spark_entry__

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("lexmill.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lexmill.llm", None)
    assert __spark_entry__.queries() == QUERIES
    assert __spark_entry__.oracle_sql() == ORACLES
