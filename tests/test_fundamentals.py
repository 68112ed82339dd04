from datetime import date

import pytest
from conftest import by_id

from aftershock.operators.fundamentals import build_fundamental_features, enrich_fundamentals, event_ebitda_margin
from aftershock.operators.pit import asof_join, link_companies
from aftershock.sources.normalize import normalize_unrestated

FIELDS = ("saleq cogsq oibdpq dpq niq epspxq xintq atq ltq cheq dlttq dlcq actq lctq seqq ceqq cshoq").split()


def _quarter(gvkey, end, rdq, sales, **other):
    values = dict.fromkeys(FIELDS, 10.0) | {"saleq": sales, "niq": sales / 10, "epspxq": sales / 100} | other
    return (gvkey, end, rdq, 1, end.year, *[values[f] for f in FIELDS])


RAW = "gvkey string, datadate date, rdq date, fqtr long, fyrq long, " + ", ".join(f"{f} double" for f in FIELDS)
ENDS = [date(2018, 3, 31), date(2018, 6, 30), date(2018, 9, 30), date(2018, 12, 31), date(2019, 3, 31)]
PUBLIC = [date(2018, 5, 1), date(2018, 8, 1), date(2018, 11, 1), date(2019, 2, 1), date(2019, 5, 1)]
SALES = [200.0, 210.0, 190.0, 250.0, 260.0]


def _raw(spark, extra=()):
    rows = [_quarter("004321", e, p, s) for e, p, s in zip(ENDS, PUBLIC, SALES)]
    return spark.createDataFrame([*rows, *extra], RAW)


@pytest.fixture(scope="module")
def link(spark):
    return spark.createDataFrame(
        [
            ("004321", 5, "LC", "P", date(2000, 1, 1), None),
            ("009999", 5, "LU", "C", date(2000, 1, 1), None),
            ("007777", 5, "NR", "P", date(2000, 1, 1), None),
            ("004321", 6, "LC", "P", date(2000, 1, 1), date(2018, 12, 31)),
        ],
        "gvkey string, lpermno long, linktype string, linkprim string, linkdt date, linkenddt date",
    )


@pytest.fixture(scope="module")
def spine(spark):
    def build(*rows):
        return spark.createDataFrame(
            [(e, s, d, 8.0) for e, s, d in rows], "event_id string, security_id long, crash_date date, crash_close double"
        )

    return build


def test_link_prefers_primary_and_respects_its_end(spine, link):
    got = by_id(
        link_companies(
            spine(("a", 5, date(2019, 1, 2)), ("b", 6, date(2018, 12, 31)), ("c", 6, date(2019, 1, 1)), ("d", 77, date(2019, 1, 1))),
            link,
        )
    )
    assert {e: r["company_id"] for e, r in got.items()} == {"a": 4321, "b": 4321, "c": None, "d": None}


def test_only_published_quarters_are_used(spark, spine, link):
    rows = by_id(
        build_fundamental_features(
            spine(("before", 5, date(2019, 4, 30)), ("same_day", 5, date(2019, 5, 1)), ("none", 5, date(2018, 4, 1))),
            normalize_unrestated(_raw(spark)),
            link,
        )
    )
    assert rows["before"]["fundamentals_period_end"] == date(2018, 12, 31)
    assert rows["same_day"]["fundamentals_period_end"] == date(2019, 3, 31)
    assert rows["same_day"]["days_since_fundamental"] == 31
    assert rows["none"]["fundamentals_available"] is False and rows["none"]["market_cap"] is None
    assert rows["none"]["fundamentals_stale"] is None and rows["none"]["fundamentals_rdq_available"] is False


def test_future_quarter_changes_nothing(spark, spine, link):
    ev = spine(("x", 5, date(2019, 5, 20)))
    later = [_quarter("004321", date(2019, 6, 30), date(2019, 5, 21), 9000.0)]
    base = by_id(build_fundamental_features(ev, normalize_unrestated(_raw(spark)), link))
    assert base == by_id(build_fundamental_features(ev, normalize_unrestated(_raw(spark, later)), link))


def test_ratios_by_hand(spark, spine, link):
    r = by_id(
        build_fundamental_features(spine(("x", 5, date(2019, 5, 20))), normalize_unrestated(_raw(spark)), link)
    )["x"]
    year = sum(SALES[1:])
    assert r["net_margin"] == pytest.approx(0.1) and r["gross_margin"] == pytest.approx((year - 40) / year)
    assert r["operating_margin"] == pytest.approx(0.0)
    assert r["revenue_growth_yoy"] == pytest.approx(260 / 200 - 1) and r["revenue_growth_qoq"] == pytest.approx(260 / 250 - 1)
    assert r["market_cap"] == pytest.approx(80.0) and r["pe"] == pytest.approx(80 / (year / 10))
    assert r["net_debt"] == pytest.approx(10.0) and r["ev_to_ebitda"] == pytest.approx(90 / 40)
    assert r["current_ratio"] == pytest.approx(1.0) and r["debt_to_assets"] == pytest.approx(2.0)
    assert r["fundamentals_stale"] is False


def test_stale_and_zero_denominator(spark, spine, link):
    rows = [_quarter("004321", e, p, s, xintq=0.0, lctq=0.0) for e, p, s in zip(ENDS, PUBLIC, SALES)]
    fund = normalize_unrestated(spark.createDataFrame(rows, RAW))
    r = by_id(build_fundamental_features(spine(("x", 5, date(2020, 6, 1))), fund, link))["x"]
    assert r["fundamentals_stale"] is True
    assert r["interest_coverage"] is None and r["current_ratio"] is None


def test_trailing_sums_need_four_quarters(spark):
    rows = enrich_fundamentals(normalize_unrestated(_raw(spark))).orderBy("period_end").collect()
    assert [r["revenue_ttm"] for r in rows] == [None, None, None, pytest.approx(850.0), pytest.approx(910.0)]


def test_availability_falls_back_to_sixty_days(spark):
    raw = _raw(spark, [_quarter("1", date(2019, 3, 31), None, 5.0, dlttq=None), _quarter("2", date(2019, 3, 31), None, 5.0, dlttq=None, dlcq=None)])
    got = {r["company_id"]: r for r in normalize_unrestated(raw).filter("period_end = DATE '2019-03-31'").collect()}
    assert got[1]["public_date"] == date(2019, 5, 30) and got[1]["rdq_available"] is False
    assert got[1]["total_debt"] == 10.0 and got[2]["total_debt"] is None and got[4321]["total_debt"] == 20.0


def test_margin_keeps_only_linked_events(spark, spine, link):
    rows = by_id(
        event_ebitda_margin(
            spine(("x", 5, date(2019, 5, 20)), ("y", 77, date(2019, 5, 20)), ("z", 5, date(2018, 4, 1))),
            normalize_unrestated(_raw(spark)),
            link,
        )
    )
    assert set(rows) == {"x", "z"}
    assert rows["x"]["ebitda_margin"] == pytest.approx(40 / 910) and rows["z"]["ebitda_margin"] is None


def test_asof_against_brute_force_with_ties_and_null_keys(spark):
    import random

    rng = random.Random(11)
    d0 = date(2020, 1, 1).toordinal()
    left = [(i, rng.choice([1, 2, 3, None]), date.fromordinal(d0 + rng.randrange(60))) for i in range(300)]
    right = [(rng.choice([1, 2]), date.fromordinal(d0 + rng.randrange(60)), n) for n in range(60)]
    got = asof_join(
        spark.createDataFrame(left, "id long, k long, t date"),
        spark.createDataFrame(right, "k long, known date, newest long").selectExpr("*", "newest AS payload"),
        key="k", at="t", known="known", newest="newest", take=["payload"],
    ).collect()
    assert len(got) == len(left)
    for r in got:
        fits = [(known, n) for k, known, n in right if k == r["k"] and known <= r["t"]]
        assert r["payload"] == (max(fits)[1] if fits else None)


@pytest.mark.parametrize("open_end", [False, True])
def test_interval_join_against_brute_force(spark, open_end):
    import random

    from aftershock.operators.pit import interval_join

    rng = random.Random(23)
    d0 = date(2020, 1, 1).toordinal()

    def some_day(top=50):
        return date.fromordinal(d0 + rng.randrange(top))

    intervals = []
    for n in range(60):
        a = some_day()
        b = None if rng.random() < 0.1 else date.fromordinal(a.toordinal() + rng.randrange(-2, 25))
        intervals.append((rng.choice([1, 2, 3]), a, b, n))
    left = [(i, rng.choice([1, 2, 3, 4, None]), some_day(90)) for i in range(400)]
    got = interval_join(
        spark.createDataFrame(left, "id long, k long, t date"),
        spark.createDataFrame(intervals, "k long, a date, b date, n long"),
        key="k", at="t", start="a", end="b", prefer="r_a DESC, r_n", take={"n": "best"}, open_end=open_end,
    ).collect()
    assert len(got) == len(left)
    for r in got:
        fits = [
            (a, -n)
            for k, a, b, n in intervals
            if k == r["k"] and a <= r["t"] and ((open_end and b is None) or (b is not None and r["t"] <= b))
        ]
        assert r["best"] == (-max(fits)[1] if fits else None)
