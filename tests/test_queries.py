"""Every registered query against its SQL, at the smallest size."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_sql()
SLOW = {"ctr_lr_grid", "ctr_fm_mlp", "pair_scorer_metric"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    link = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        link.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return link


def test_names_agree():
    assert set(SQL) <= set(queries())


@pytest.mark.parametrize("name", sorted(set(queries()) - SLOW))
def test_query(spark, db, name):
    found = queries()[name](spark, FOLDER).toPandas()
    if name in SQL:
        assert compare(found, db.execute(SQL[name]).df()) == "ok"
    else:
        assert len(found) > 0


def test_entry(spark):
    assert entry(spark).count() > 0
