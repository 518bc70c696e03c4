from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, canonical

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")
CHECKED = ["feature_build", "interpolate_time_limit", "baseline_leaderboard", "coverage_metrics", "iqr_outliers", "cleaning_log",
           "localize_tz", "solar_position", "night_spans", "power_describe", "scatter_sample", "site_bounds"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def test_every_sql_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    rel = con.sql(entry.oracle_sql()[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(rel.columns, rel.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
