from datetime import date

import pytest
from conftest import by_id
from pyspark.sql import functions as F


from aftershock.operators import pit
from aftershock.operators.events import build_crash_events, clean_pool, consecutive_events, event_summary
from aftershock.sources.schemas import CRASH_EVENT

PRICES = "security_id long, date date, daily_return double, close double, volume double"
MASTER = "security_id long, company_id long, ticker string, ticker_start date, ticker_end date"


@pytest.fixture(scope="module")
def table(spark):
    prices = spark.createDataFrame(
        [
            (7, date(2015, 5, 4), -0.10, 40.0, 10.0),
            (7, date(2015, 5, 5), -0.25, 30.0, 10.0),
            (7, date(2015, 5, 6), -0.09999, 27.0, 10.0),
            (7, date(2015, 5, 7), None, 27.0, 10.0),
            (8, date(2015, 5, 4), -0.40, 1.5, 10.0),
            (8, date(2015, 5, 5), -0.11, None, 10.0),
            (9, date(2015, 5, 4), 0.01, 20.0, 10.0),  # price halved by a split, return says otherwise
            (9, date(2001, 5, 4), -0.5, 20.0, 10.0),  # before its first name period
        ],
        PRICES,
    )
    master = spark.createDataFrame(
        [
            (7, 70, "OLD", date(2010, 1, 1), date(2015, 5, 4)),
            (7, 71, "NEW", date(2015, 5, 4), date(2030, 1, 1)),
            (8, 80, "EEE", date(2010, 1, 1), date(2030, 1, 1)),
            (9, 90, "NNN", date(2010, 1, 1), date(2030, 1, 1)),
        ],
        MASTER,
    )
    return build_crash_events(prices, master, min_price=5.0)


def test_threshold_is_inclusive_and_every_day_is_its_own_event(table):
    assert set(by_id(table)) == {"7_20150504", "7_20150505", "8_20150504", "8_20150505", "9_20010504"}
    assert [(f.name, f.dataType) for f in table.schema] == [(f.name, f.dataType) for f in CRASH_EVENT]


def test_overlapping_periods_give_one_row_with_the_latest(table):
    rows = by_id(table)
    assert rows["7_20150504"]["ticker_as_of_event"] == "NEW"
    assert rows["7_20150504"]["company_id"] == 71


def test_uncovered_event_stays_with_null_identifiers(table):
    r = by_id(table)["9_20010504"]
    assert r["ticker_as_of_event"] is None and r["company_id"] is None
    assert r["in_universe_at_event"] is False


def test_price_flag_is_null_without_a_close(table):
    rows = by_id(table)
    assert rows["8_20150504"]["passes_min_price"] is False
    assert rows["8_20150505"]["passes_min_price"] is None
    assert set(by_id(clean_pool(table))) == {"7_20150504", "7_20150505"}


def test_consecutive_days_and_summary(table):
    assert {r["event_id"] for r in consecutive_events(table).collect()} == {"7_20150505", "8_20150505"}
    r = event_summary(table).first()
    assert (r["events"], r["securities"], r["in_universe"], r["pass_min_price"], r["clean"], r["null_crash_close"]) == (5, 3, 4, 3, 2, 1)


def test_threshold_parameter(spark):
    prices = spark.createDataFrame([(1, date(2015, 1, 5), -0.05, 10.0, 1.0)], PRICES)
    master = spark.createDataFrame([], MASTER)
    assert build_crash_events(prices, master, threshold=-0.05).count() == 1
    assert build_crash_events(prices, master, threshold=-0.06).count() == 0


def test_interval_join_deals_a_heavy_key_over_its_years(spark):
    """Seven of ten events belong to one security; with every side shuffled they still spread over tasks."""
    days = "date_add(DATE '1990-01-01', cast(id * 37 % 9000 AS int)) AS at"
    left = spark.range(10_000).selectExpr("if(id % 10 < 7, 1L, id % 50) AS key", days, "id AS n")
    spans = [(k, date(1985 + 3 * i, 1, 1), None if i == 9 else date(1987 + 3 * i, 6, 30), f"{k}-{i}") for k in range(50) for i in range(10)]
    right = spark.createDataFrame(spans, "key long, start date, end date, name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = pit.interval_join(
            left, right, key="key", at="at", start="start", end="end", prefer="r_start DESC", take={"name": "name"}, open_end=True
        )
        per_task = joined.groupBy(F.spark_partition_id().alias("t")).count().collect()
        rows = joined.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows) == 10_000 and max(r["count"] for r in per_task) < 3_500
    for r in rows[::7]:
        fits = [x for x in spans if x[0] == r["key"] and x[1] <= r["at"] and (x[2] is None or r["at"] <= x[2])]
        assert r["name"] == (max(fits, key=lambda x: x[1])[3] if fits else None)
