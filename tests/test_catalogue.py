import glob
import math
import os

import duckdb
import pytest

from glossmill.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(SQL.keys() & QUERIES.keys()))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    mine = sorted(repr([_value(r[c]) for c in cols]) for r in got.collect())
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted(repr([_value(r[i]) for i in at]) for r in rel.fetchall())
    assert mine == theirs


def test_every_query_without_sql_is_known():
    assert set(QUERIES) - set(SQL) == {"pair_align_dp", "story_pairs", "classifier_predictions", "classifier_scores"}
