"""Crash events: every day on which a security fell by the threshold or more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arith import number
from ..sources.schemas import CRASH_EVENT, conform
from .pit import interval_join
from .profile import distinct_ids

THRESHOLD = -0.10
CLEAN = "in_universe_at_event AND passes_min_price"


def event_id(security_id: str = "security_id", day: str = "crash_date") -> str:
    """``<security>_<yyyymmdd>``."""
    return f"concat_ws('_', cast({security_id} AS string), date_format({day}, 'yyyyMMdd'))"


def detect_crashes(prices: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Days with ``daily_return <= threshold``. There is no cooldown; a missing return is no event."""
    return prices.filter(f"daily_return <= {number(threshold)}").selectExpr(
        "cast(security_id AS bigint) AS security_id",
        "cast(date AS date) AS crash_date",
        "cast(daily_return AS double) AS crash_return",
        "cast(close AS double) AS crash_close",
        "cast(volume AS double) AS crash_volume",
    )


def attach_identifiers(crashes: DataFrame, master: DataFrame) -> DataFrame:
    """Company and ticker as of the event, from the name period that covers it.

    An uncovered event stays, with null identifiers and ``in_universe_at_event`` false. Of several
    covering periods the latest one wins.
    """
    joined = interval_join(
        crashes,
        master.select("security_id", "company_id", "ticker", "ticker_start", "ticker_end"),
        key="security_id",
        at="crash_date",
        start="ticker_start",
        end="ticker_end",
        prefer="r_ticker_start DESC NULLS LAST, r_ticker",
        take={"company_id": "company_id", "ticker": "ticker_as_of_event", "security_id": "__covered"},
    )
    return joined.selectExpr("*", "__covered IS NOT NULL AS in_universe_at_event").drop("__covered")


def build_crash_events(
    prices: DataFrame, master: DataFrame, *, threshold: float = THRESHOLD, min_price: float | None = None
) -> DataFrame:
    """The event table. ``passes_min_price`` is null on a day without a close."""
    liquid = "true" if min_price is None else f"crash_close >= {number(min_price)}"
    events = attach_identifiers(detect_crashes(prices, threshold), master)
    return conform(events.selectExpr("*", f"{event_id()} AS event_id", f"{liquid} AS passes_min_price"), CRASH_EVENT)


def clean_pool(events: DataFrame) -> DataFrame:
    """Events inside the universe and above the minimum price."""
    return events.filter(CLEAN)


def consecutive_events(events: DataFrame) -> DataFrame:
    """Events one calendar day after the previous event of the same security."""
    previous = "lag(crash_date) OVER (PARTITION BY security_id ORDER BY crash_date)"
    return events.selectExpr("*", f"datediff(crash_date, {previous}) AS gap").filter("gap = 1")


def event_summary(events: DataFrame) -> DataFrame:
    """One row of counts over an event table."""
    measured = events.selectExpr(
        "count(*) AS events",
        "min(crash_date) AS date_min",
        "max(crash_date) AS date_max",
        "count_if(in_universe_at_event) AS in_universe",
        "count_if(passes_min_price) AS pass_min_price",
        f"count_if({CLEAN}) AS clean",
        "count_if(crash_close IS NULL) AS null_crash_close",
    )
    return measured.crossJoin(F.broadcast(distinct_ids(events, {"securities": "security_id"})))  # one row each
