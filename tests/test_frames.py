import random

import pytest
from test_windows import LEVELS, ROLLS, expected, series  # noqa: F401

from aftershock.functions.frames import frames_at
from aftershock.functions.windows import Roll, rolling
from aftershock.operators import features, labels

SOME = "dayofmonth(date) % 3 = 1"


def same(a, b):
    return (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-6, abs=1e-7))


def test_frames_at_some_rows_equal_brute_force(panel, series):  # noqa: F811
    df = panel({sid: {"close": v} for sid, v in series.items()}).select("security_id", "date", "close")
    place = {(r["security_id"], r["date"]): r["i"] for r in df.selectExpr(
        "*", "row_number() OVER (PARTITION BY security_id ORDER BY date) - 1 AS i").collect()}
    got = frames_at(df, ROLLS, SOME).collect()
    assert {(r["security_id"], r["date"]) for r in got} == {k for k in place if k[1].day % 3 == 1} and len(got) > 30
    for r in got:
        for roll in ROLLS:
            want = expected(series[r["security_id"]], place[r["security_id"], r["date"]], roll)
            assert same(r[roll.name], want), (r["security_id"], r["date"], roll)


@pytest.mark.parametrize("name", LEVELS)
def test_moments_at_some_rows_equal_those_of_the_windows(panel, name):
    rng = random.Random(5)
    own = LEVELS[name]
    market = [None if i % 11 == 3 else 1e7 + rng.uniform(-1, 1) for i in range(len(own))]
    df = panel({1: {"close": own, "high": market}})
    rolls = [Roll("std", "close", n, f"s{n}", need=need, skip=skip) for n, need, skip in ((20, 2, 0), (7, 2, 1), (60, None, 0))]
    rolls.append(Roll("slope", "close", 25, "beta", skip=1, need=5, on="high"))
    want = {r["date"]: r for r in rolling(df, rolls).collect()}
    got = frames_at(df, rolls, "true").collect()
    assert len(got) == len(own)
    for r in got:
        for roll in rolls:
            assert same(r[roll.name], want[r["date"]][roll.name]), (r["date"], roll)


def test_events_take_few_windows_of_the_panel(panel, events):
    """Each window copies every row of the panel: those of frames did so for each step of a frame."""
    prices = panel({1: {"close": [10.0 + i for i in range(300)]}})
    spine = events([("a", 1, 280, -0.2, 10.0)])
    plan = features.build_price_features(spine, prices)._jdf.queryExecution().executedPlan().toString()
    assert sum("Window [" in x for x in plan.splitlines()) <= 3
    master = prices.selectExpr(
        "security_id", "date AS listing_date", "date AS ticker_start", "cast(null AS date) AS delisting_date", "0D AS delisting_return"
    ).limit(1)
    plan = labels.build_labels(spine, prices, master)._jdf.queryExecution().executedPlan().toString()
    assert sum("Window [" in x for x in plan.splitlines()) <= 5
