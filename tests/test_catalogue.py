"""Every registered query against its SQL twin, on the smallest tables."""

import duckdb
import pytest

from sparkcohort.plans import more  # noqa: F401
from sparkcohort.plans.catalogue import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def order(row):
    return tuple((x is None, isinstance(x, str), 0 if x is None else x) for x in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=order)
    run = con.execute(SQL[name])
    names = [x[0] for x in run.description]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in run.fetchall()), key=order)
    assert sorted(names) == cols
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == tuple(pytest.approx(x, abs=2e-6) if isinstance(x, float) else x for x in b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
