"""Every registered query beside its SQL, at a small size."""

import duckdb
import pytest

from shocklens import plans

plans.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or v != v:
        return ""
    return f"{v + 0:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = plans.QUERIES[name](spark, sf_dir)
    found = con.execute(plans.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = sorted(tuple(_plain(r[names.index(c)]) for c in order) for r in found.fetchall())
    have = sorted(tuple(_plain(v) for v in r) for r in got.select(*[f"`{c}`" for c in order]).collect())
    assert have == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).columns
    plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0
