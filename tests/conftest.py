from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pvlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


START = dt.datetime(2024, 1, 1)


def at(slot: float) -> dt.datetime:
    """Time of a 15-minute slot counted from the start of the fixtures."""
    return START + dt.timedelta(minutes=15 * slot)


@pytest.fixture(scope="session")
def series(spark):
    """Two sites with holes, nulls and rising values over nine days."""
    rows = []
    for site in (1, 2):
        for slot in range(9 * 96):
            if (slot * 7 + site) % 11 == 0:
                continue
            power = None if (slot + site) % 13 == 0 else float((slot * 37 + site * 11) % 101) / 7.0
            rows.append((site, (site + 1) // 2, at(slot), power))
    return spark.createDataFrame(rows, "site_id long, campus_id long, timestamp timestamp_ntz, power double").cache()
