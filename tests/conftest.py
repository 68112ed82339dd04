import os
import sys
from datetime import date, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aftershock.session import local_session  # noqa: E402

DAY0 = date(2019, 3, 1)


def day(i: int) -> date:
    return DAY0 + timedelta(days=i)


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, memory="4g", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel(spark):
    """Build a panel from {security: {column: values}}; days are consecutive."""

    def build(securities: dict, start: int = 0):
        rows = []
        for sid, columns in securities.items():
            close = columns["close"]
            n = len(close)
            full = {
                "open": columns.get("open", close),
                "high": columns.get("high", close),
                "low": columns.get("low", close),
                "close": close,
                "volume": columns.get("volume", [100.0] * n),
                "daily_return": columns.get("daily_return", [0.0] * n),
            }
            for i in range(n):
                rows.append((sid, day(start + i), *[full[c][i] for c in full]))
        schema = "security_id long, date date, open double, high double, low double, close double, volume double, daily_return double"
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def events(spark):
    """Build an event spine from (event_id, security_id, day number, return, close)."""

    def build(rows):
        full = [(e, s, day(d), float(r), None if c is None else float(c), True, True) for e, s, d, r, c in rows]
        return spark.createDataFrame(
            full,
            "event_id string, security_id long, crash_date date, crash_return double, crash_close double, "
            "in_universe_at_event boolean, passes_min_price boolean",
        )

    return build


def by_id(df):
    return {r["event_id"]: r.asDict() for r in df.collect()}
