"""Every registered query that has SQL gives the SQL's rows."""

import math

import duckdb
import pytest

from driftline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rel = con.sql(registry.SQL[name])
    assert sorted(rel.columns) == columns
    key = lambda r: tuple((x is None, round(x, 3) if isinstance(x, float) else x if x is not None else 0) for x in r)
    ours = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    theirs = sorted(rel.select(*columns).fetchall(), key=key)
    assert len(ours) == len(theirs) and ours
    assert all(close(x, y) for a, b in zip(ours, theirs) for x, y in zip(a, b))


@pytest.mark.parametrize("name", ["ukf_series", "ekf_iterated_smoother_series", "srukf_smoothed_series", "particle_smoothed_series"])
def test_series_queries_give_a_row_for_each_event(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert all(math.isfinite(v) for r in rows for v in r.x)


def test_turns_and_trajectories(spark):
    assert registry.QUERIES["rao_blackwell_turns"](spark, SF).count() == 5 * 60
    assert registry.QUERIES["simulated_trajectories"](spark, SF).count() == 5001 + 2000 + 300 + 300


def test_accuracy_suite_passes_its_gate(spark):
    rows = registry.QUERIES["accuracy_suite"](spark, SF).collect()
    assert len(rows) == 13 and all(r.passed for r in rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())
