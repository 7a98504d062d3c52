"""Each registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
PAIRS = [(k, f, m.ORACLE_SQL[k]) for m in entry.MODULES for k, f in m.QUERIES.items() if k in m.ORACLE_SQL]
ROWS_ONLY = [(k, f) for m in entry.MODULES for k, f in m.QUERIES.items() if k not in m.ORACLE_SQL]


def plain(v):
    """Values as the driver compares them: floats unrounded."""
    return v + 0.0 if isinstance(v, float) else v if v is None else str(v)


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return c


@pytest.mark.parametrize("name, query, sql", PAIRS, ids=[p[0] for p in PAIRS])
def test_equals_sql(spark, db, sf_dir, name, query, sql):
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name, query", ROWS_ONLY, ids=[p[0] for p in ROWS_ONLY])
def test_runs(spark, sf_dir, name, query):
    assert query(spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
