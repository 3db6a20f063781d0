"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from isochron.plans import catalog, feed_queries, network_queries, relational, spatial_queries  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


def test_greedy_match_equals_a_plain_loop(spark):
    got = {(r["a"], r["b"]) for r in catalog.queries()["greedy_match"](spark, DIR).collect()}
    p = [(r["vec_id"], r["embedding"][0], r["embedding"][1]) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    cands = sorted((math.hypot(x - u, y - v), a, b) for a, x, y in p if a % 2 == 0 for b, u, v in p if b % 2 and math.hypot(x - u, y - v) <= 0.05)
    used, want = set(), set()
    for _, a, b in cands:
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert got == want
