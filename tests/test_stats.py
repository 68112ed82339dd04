import random
import statistics
from datetime import date

import pytest
from conftest import by_id, day
from pyspark.sql import functions as F

from aftershock.operators import buckets, dataset, outcomes, profile, quantiles, stats, universe
from aftershock.operators.quantiles import distribution


def quantile(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


def test_distribution_is_exact_with_a_dominant_key_and_ties(spark):
    rng = random.Random(5)
    rows = [("hot", rng.choice([0.0, 0.0, 0.25, rng.gauss(0, 1)])) for _ in range(4000)]
    rows += [("rare", v) for v in (3.0, -1e6, 1e9, 2.5)] + [("one", -0.5), ("hot", None), ("hot", float("nan")), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    probs = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {r["k"]: r for r in distribution(df, ["k"], "x", probs).collect()}
    assert set(got) == {"hot", "rare", "one"}
    for k, r in got.items():
        values = [x for key, x in rows if key == k and x is not None and x == x]
        assert r["n"] == len(values) and r["n_positive"] == sum(v > 0 for v in values)
        assert r["mean"] == pytest.approx(statistics.fmean(values))
        for i, p in enumerate(probs):
            assert r[f"q{i}"] == pytest.approx(quantile(values, p), abs=1e-12), (k, p)


def test_distribution_without_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert distribution(df, [], "x").count() == 0


def test_wilson_interval(spark):
    r = stats.with_wilson(spark.createDataFrame([(30, 40)], "hits long, n long")).first()
    # closed form of the score interval at z = 1.96
    z, n, p = 1.96, 40, 0.75
    mid, half = p + z * z / (2 * n), z * ((p * (1 - p) + z * z / (4 * n)) / n) ** 0.5
    assert r["rate"] == 0.75
    assert r["ci_low"] == pytest.approx((mid - half) / (1 + z * z / n)) and r["ci_high"] == pytest.approx((mid + half) / (1 + z * z / n))
    small, large = [
        stats.with_wilson(spark.createDataFrame([(n // 2, n)], "hits long, n long")).first() for n in (20, 2000)
    ]
    assert large["ci_high"] - large["ci_low"] < small["ci_high"] - small["ci_low"]


def test_rates_leave_out_undetermined_events(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", None), ("b", None), ("c", 1)], "g string, hit int")
    got = {r["g"]: (r["hits"], r["n"]) for r in stats.grouped_rate(df, "g", "hit").collect()}
    assert got == {"a": (1, 2), "c": (1, 1)}
    assert stats.overall_rate(df, "hit").first()["rate"] == pytest.approx(2 / 3)
    none = stats.overall_rate(df.filter("g = 'b'"), "hit").first()
    assert (none["hits"], none["n"], none["rate"], none["ci_low"]) == (0, 0, None, None)


def test_slices_follow_their_null_rules(spark):
    df = spark.createDataFrame(
        [(None, None, 1), (-0.15, 299.9, 0), (-0.1499, 300.0, 1), (-0.30, 10000.0, 1)],
        "crash_return double, market_cap double, hit int",
    )
    size = {r["code"]: r["n"] for r in stats.slice_rates(df, "size", "hit").collect()}
    assert size == {0: 1, 1: 1, 3: 1}
    magnitude = {r["code"]: (r["n"], r["label"]) for r in stats.slice_rates(df, "magnitude", "hit").collect()}
    assert magnitude == {0: (1, "-10% to -15%"), 1: (1, "-15% to -20%"), 3: (2, "≤ -30%")}


def test_quantile_buckets_keep_ties_together(spark):
    values = [1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")
    got = {r["i"]: r["bucket"] for r in stats.quantile_buckets(df, "x", 4, "q").collect()}
    breaks = [quantile(values[:-1], p) for p in (0.25, 0.5, 0.75)]
    for i, v in enumerate(values):
        assert got[i] == (None if v is None else f"q{1 + sum(v > b for b in breaks)}")
    empty = df.selectExpr("i", "cast(null AS double) AS x")
    assert {r["bucket"] for r in stats.quantile_buckets(empty, "x", 4, "q").collect()} == {None}


def test_histogram_folds_the_tails_into_the_end_bins(spark):
    import numpy as np

    values = [-2.0, -1.0, -0.95, -0.9, 0.0, 0.05, 0.1, 1.99, 2.0, 7.0, 0.3, -0.3]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "ret double")
    spec = stats.ONE_YEAR
    got = {r["bin"]: (r["n"], r["percent"]) for r in stats.return_histogram(df, spec).collect()}
    edges = np.arange(spec.low, spec.high + 1e-9, spec.width)
    edges[-1] = spec.high  # the accumulated step may end just short of it, which would lose the overflow
    want, _ = np.histogram(np.clip(values, spec.low, spec.high), bins=edges)
    assert {b: n for b, (n, _) in got.items()} == {i: int(c) for i, c in enumerate(want) if c}
    assert sum(p for _, p in got.values()) == pytest.approx(100.0)


BUCKET_INPUT = "id long, market_cap double, crash_return double, prior_crash_count_20d long, pe double, return_252d_pre double, beta double, ebitda_margin double, revenue_growth_yoy double, market_return_20d double, rel_sector double, ret double"


def _members(spark, tests, row):
    from aftershock.operators.stats import explode_keys

    df = spark.createDataFrame([row], BUCKET_INPUT)
    return {r["k"] for r in explode_keys(df, tests, "k", ["id"]).collect()}


def test_bucket_sets_differ_at_their_edges(spark):
    edge = (1, 100.0, -0.15, None, 0.0, -0.5, 0.8, 0.0, 0.0, -0.10, -0.03, 0.1)
    full, recent = (_members(spark, t, edge) for t in (buckets.full_buckets(), buckets.recent_buckets()))
    assert full == {"mcap_small", "sev_15_20", "prior_0", "premom_dn", "beta_lo", "ebm_neg", "revg_dn", "mkt_crash", "relsec_mid"}
    assert recent == {"mcap_small", "sev_15_20", "premom_dn", "beta_mkt", "ebm_lo", "revg_lo", "mkt_dn", "relsec_with"}


def test_bucket_statistics_and_small_samples(spark):
    rows = [(i, 50.0, -0.12, 0, -1.0, 0.1, 1.0, 0.2, 0.05, 0.01, 0.0, r) for i, r in enumerate([0.5, -0.5, 0.1, None])]
    df = spark.createDataFrame(rows, BUCKET_INPUT)
    got = {r["bucket"]: r for r in buckets.bucket_outcomes(df, {"ret": buckets.recent_buckets()}).collect()}
    r = got["sev_10_15"]
    assert (r["n"], r["median"], r["small_n"]) == (3, 0.1, True)
    assert r["p_positive"] == pytest.approx(2 / 3) and r["mean"] == pytest.approx(0.1 / 3)


def test_forward_returns_and_censoring(panel, events):
    p = panel(
        {
            1: {"close": [1.0] * 40, "daily_return": [0.0] * 10 + [-0.2, 0.1, None, 0.1] + [0.0] * 26},
            2: {"close": [1.0] * 12, "daily_return": [0.0] * 8 + [-0.3, 0.5, 0.0, -1.0]},  # total loss at its end
            3: {"close": [1.0] * 40, "daily_return": [0.0] * 38 + [-0.2, 0.1]},
            4: {"close": [1.0] * 12, "daily_return": [0.0] * 8 + [-1.0, 0.0, 0.0, 0.0]},
        }
    )
    ev = events([("a", 1, 10, -0.2, 9), ("b", 2, 8, -0.3, 9), ("c", 3, 38, -0.2, 9), ("d", 4, 8, -1.0, 9), ("e", 1, 99, -0.2, 9)])
    got = {k: r["ret"] for k, r in by_id(outcomes.forward_returns(ev, p, 3)).items()}
    assert got["a"] == pytest.approx(1.1 * 1.0 * 1.1 - 1)
    assert got["b"] == pytest.approx(-1.0)  # stopped trading: observed, the loss is kept
    assert set(got) == {"a", "b"}  # c is censored, d has no return after a total loss, e is off the panel
    tails = stats.tail_stats(outcomes.outcome_table(ev, p, [3]), 3).first()
    assert (tails["events"], tails["censored"], tails["observed"], tails["p_down_50"]) == (4, 1, 2, 0.5)


def _family(spark, ids, columns, value=0.0):
    return spark.createDataFrame([(i, *[value] * len(columns)) for i in ids], "event_id string, " + ", ".join(f"{c} double" for c in columns))


@pytest.fixture(scope="module")
def assembled(spark):
    ids = ["p", "q"]
    spine = spark.createDataFrame(
        [(i, n, n, "T", day(0), True, True, 5.0) for n, i in enumerate([*ids, "lonely"])],
        "event_id string, security_id long, company_id long, ticker_as_of_event string, crash_date date, in_universe_at_event boolean, passes_min_price boolean, crash_close double",
    )
    labels = _family(spark, ids, dataset.columns_of(table="labels"), 1.0)
    price = _family(spark, ids, dataset.PRICE_FEATURES, -0.2)
    recent = _family(spark, ids, dataset.RECENT_FEATURES)
    market = _family(spark, ids, dataset.MARKET_FEATURES)
    fund = _family(spark, ids, dataset.FUNDAMENTAL_RATIOS + dataset.FUNDAMENTAL_META)
    return dataset.assemble_events(spine, labels, price, recent, market, fund)


def test_dataset_columns_and_rows(assembled):
    assert len(assembled.columns) == len(set(assembled.columns)) == 101
    assert not set(dataset.FEATURE_COLUMNS) & set(dataset.OUTCOME_COLUMNS)
    assert dataset.PRIMARY_TARGET in dataset.OUTCOME_COLUMNS and len(dataset.FEATURE_COLUMNS) == 52
    assert sorted(r["event_id"] for r in assembled.collect()) == ["lonely", "p", "q"]
    assert dataset.validate_events(assembled)["rows"] == 3


def test_validation_names_every_problem(assembled):
    bad = assembled.unionByName(assembled.limit(1)).selectExpr(
        "* EXCEPT (crash_return, hit_5pct_5d, pe)", "0.5D AS crash_return", "2D AS hit_5pct_5d"
    )
    with pytest.raises(dataset.DatasetError) as e:
        dataset.validate_events(bad)
    for part in ("duplicate", "pe", "threshold", "other than 0 and 1"):
        assert part in str(e.value)


def test_profiles(spark, panel):
    p = panel({1: {"close": [1.0, None]}, 2: {"close": [3.0]}})
    r = profile.table_profile(p, date_column="date", id_column="security_id", counted_column="close").first()
    assert (r["n_rows"], r["n_distinct_ids"], r["n_present"], r["min_date"], r["max_date"]) == (3, 2, 2, day(0), day(1))
    assert profile.duplicate_keys(p).count() == 0 and profile.duplicate_keys(p.unionByName(p)).count() == 3
    codes = spark.createDataFrame([(c,) for c in [5, 5, 7, 9, 9]], "code_x long")
    assert [(r["code"], r["n"], r["total"]) for r in profile.code_frequency(codes, "code_x", top=2).collect()] == [(5, 2, 5), (9, 2, 5)]


def test_master_summaries(spark):
    rows = [
        (1, 10, "A", date(2000, 1, 1), date(2001, 1, 1), "NYSE", 11, None, None),
        (1, 10, "B", date(2001, 1, 2), date(2009, 1, 1), "Nasdaq", 12, None, None),
        (2, 20, "C", date(2003, 1, 1), date(2004, 1, 1), None, None, date(2004, 1, 1), 233),
        (3, 20, "D", date(2003, 1, 1), date(2004, 1, 1), "NYSE", None, date(2004, 1, 1), 574),
    ]
    m = spark.createDataFrame(rows, "security_id long, company_id long, ticker string, ticker_start date, ticker_end date, exchange string, sic_code long, delisting_date date, delisting_code long")
    r = universe.master_summary(m).first()
    assert (r["rows"], r["securities"], r["companies"], r["with_delisting"], r["active"], r["exchanges"]) == (4, 3, 2, 2, 1, "NYSE,Nasdaq")
    assert {r["delisting_class"]: r["securities"] for r in universe.delisting_classes(m).collect()} == {"active": 1, "acquired": 1, "dropped": 1}
    assert [tuple(r) for r in universe.renamed_securities(m, top=1).collect()] == [(1, 2)]
    first = m.groupBy("security_id").agg(F.expr(f"{universe.earliest(m, 'sic_code')} AS sic"))
    assert {tuple(r) for r in first.collect()} == {(1, 11), (2, None), (3, None)}


# --- order statistics of crowded values


def _quantile(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low, high = values[int(at)], values[-int(-at // 1)]
    return low if low == high else low + (high - low) * (at - int(at))


def test_crowded_bins_are_cut_until_they_are_small(spark, monkeypatch):
    """A million different values that share one of the coarse bins."""
    monkeypatch.setattr(quantiles, "MOST_VALUES", 2_000)
    monkeypatch.setattr(quantiles, "PARTS", 64)
    df = spark.range(1_000_000).selectExpr("id % 2 AS k", "1D + id * 1e-10D AS v")
    ranked, real = [], quantiles.opened_bins
    monkeypatch.setattr(quantiles, "opened_bins", lambda c, k, w: ranked.append((c, real(c, k, w))) or ranked[-1][1])
    got = {r["k"]: r for r in quantiles.distribution(df, ["k"], "v", (0.1, 0.5, 0.999)).collect()}
    for k in (0, 1):
        values = [1.0 + i * 1e-10 for i in range(k, 1_000_000, 2)]
        for i, p in enumerate((0.1, 0.5, 0.999)):
            assert got[k][f"q{i}"] == pytest.approx(_quantile(values, p), abs=1e-15)
        assert got[k]["n"] == 500_000
    counts, bins = ranked[0]
    sizes = quantiles._inside(counts, bins, ["k"]).groupBy("k", "lo").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert sizes[0] <= 2_000 and sizes[1] <= 12


def test_cut_bins_keep_ties_and_extremes(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MOST_VALUES", 3)
    monkeypatch.setattr(quantiles, "PARTS", 2)
    rng = random.Random(5)
    values = [rng.choice([0.0, -0.0, 1e-9, -1e-9, 5e-7, 2.0, 2.0000001, 1e300, -1e300, float("inf"), float("-inf")]) for _ in range(400)]
    values += [rng.uniform(1.999, 2.001) for _ in range(100)] + [None, float("nan")]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.5)], "k string, v double")
    probabilities = (0.0, 0.05, 0.3, 0.5, 0.71, 0.95, 1.0)
    got = {r["k"]: r for r in quantiles.distribution(df, ["k"], "v", probabilities).collect()}
    kept = [v for v in values if v is not None and v == v]
    for i, p in enumerate(probabilities):
        want, have = _quantile(kept, p), got["a"][f"q{i}"]
        assert have == want or have == pytest.approx(want, rel=1e-12), p
        assert got["b"][f"q{i}"] == 7.5
    whole = quantiles.distribution(df.filter("k = 'a'"), [], "v", (0.5,)).first()
    assert whole["q0"] == pytest.approx(_quantile(kept, 0.5), rel=1e-12)


def test_distinct_ids_are_exact(spark):
    ids = [None, 0, 1, 1, -5, -5, 32768, 32769, 65536, 10**9, 10**9, 7] + list(range(40_000))
    df = spark.createDataFrame([(i, i if i and i % 2 else None) for i in ids], "a long, b long")
    got = profile.distinct_ids(df, {"all_ids": "a", "odd": "b", "none": "CASE WHEN a < -10 THEN a END"}).first()
    assert (got["all_ids"], got["odd"], got["none"]) == (len({i for i in ids if i is not None}), len({i for i in ids if i and i % 2}), 0)
    assert "Expand" not in profile.distinct_ids(df, {"a": "a", "b": "b"})._jdf.queryExecution().executedPlan().toString()
    assert profile.distinct_ids(df.limit(0), {"a": "a"}).first()["a"] == 0
