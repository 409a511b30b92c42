"""Every registered query against its SQL at the smallest scale, and vectors against numpy."""

import glob
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from check import canonical

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, tables, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = tables.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_semantic_query_against_numpy(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    vectors = np.array([r.embedding for r in rows], dtype=np.float64)
    got = entry.queries()["semantic_topk"](spark, FOLDER).orderBy("vec_id", "match_rank").collect()
    score = vectors @ vectors.T * 100
    want = np.argsort(-score, axis=1, kind="stable")[:, :5]
    assert [r.match_id for r in got] == want.ravel().tolist()
