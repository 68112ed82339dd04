"""Named bucket sets over event features and the outcome distribution in each bucket.

Two conventions are in use and differ at the edges, so both are kept: the full-history set and the
recent set (used from a start date on, and for one-week returns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.arith import number
from .stats import HistogramSpec, return_histogram, return_stats

# The bounds of 1e9, -1.01 and 1e12 below belong to the fixed values of the full set; they leave no event out that has
# a value at all, as returns and margins stay far within them.
INF = float("inf")

# Fixed values: (key, low, high); low excluded, high included.
FULL_OPEN_LOW = {
    "crash_return": [
        ("sev_10_15", -0.15, -0.10),
        ("sev_15_20", -0.20, -0.15),
        ("sev_20_30", -0.30, -0.20),
        ("sev_30plus", -1.01, -0.30),
    ],
    "return_252d_pre": [
        ("premom_dn", -1e9, -0.5),
        ("premom_mild", -0.5, 0.0),
        ("premom_up", 0.0, 0.5),
        ("premom_hot", 0.5, 1e9),
    ],
    "beta": [
        ("beta_lo", -1e9, 0.8),
        ("beta_mkt", 0.8, 1.2),
        ("beta_hi", 1.2, 1.8),
        ("beta_vhi", 1.8, 1e9),
    ],
    "ebitda_margin": [
        ("ebm_neg", -1e9, 0.0),
        ("ebm_lo", 0.0, 0.10),
        ("ebm_mid", 0.10, 0.25),
        ("ebm_hi", 0.25, 1e9),
    ],
    "revenue_growth_yoy": [
        ("revg_dn", -1e9, 0.0),
        ("revg_lo", 0.0, 0.10),
        ("revg_mid", 0.10, 0.30),
        ("revg_hi", 0.30, 1e9),
    ],
    "market_return_20d": [
        ("mkt_crash", -1e9, -0.10),
        ("mkt_dn", -0.10, -0.03),
        ("mkt_flat", -0.03, 0.0),
        ("mkt_up", 0.0, 1e9),
    ],
    "rel_sector": [
        ("relsec_worse", -1e9, -0.10),
        ("relsec_mid", -0.10, -0.03),
        ("relsec_with", -0.03, 1e9),
    ],
}

# Fixed values: (key, low, high, low included, high included).
RECENT_RANGES = {
    "crash_return": [
        ("sev_10_15", -0.15, -0.10, False, True),
        ("sev_15_20", -0.20, -0.15, False, True),
        ("sev_20_30", -0.30, -0.20, False, True),
        ("sev_30plus", -INF, -0.30, True, True),
    ],
    "return_252d_pre": [
        ("premom_dn", -INF, -0.5, True, True),
        ("premom_mild", -0.5, 0.0, False, True),
        ("premom_up", 0.0, 0.5, False, True),
        ("premom_hot", 0.5, INF, False, True),
    ],
    "beta": [
        ("beta_lo", -INF, 0.8, True, False),
        ("beta_mkt", 0.8, 1.2, True, True),
        ("beta_hi", 1.2, 1.8, False, True),
        ("beta_vhi", 1.8, INF, False, True),
    ],
    "ebitda_margin": [
        ("ebm_neg", -INF, 0.0, True, False),
        ("ebm_lo", 0.0, 0.10, True, True),
        ("ebm_mid", 0.10, 0.25, False, True),
        ("ebm_hi", 0.25, INF, False, True),
    ],
    "revenue_growth_yoy": [
        ("revg_dn", -INF, 0.0, True, False),
        ("revg_lo", 0.0, 0.10, True, True),
        ("revg_mid", 0.10, 0.30, False, True),
        ("revg_hi", 0.30, INF, False, True),
    ],
    "market_return_20d": [
        ("mkt_crash", -INF, -0.10, True, False),
        ("mkt_dn", -0.10, -0.03, True, False),
        ("mkt_flat", -0.03, 0.0, True, False),
        ("mkt_up", 0.0, INF, True, True),
    ],
    "rel_sector": [
        ("relsec_worse", -INF, -0.10, True, False),
        ("relsec_mid", -0.10, -0.03, True, False),
        ("relsec_with", -0.03, INF, True, True),
    ],
}

# Price-earnings buckets, the same in both sets: (key, low, high], below zero apart.
PE_RANGES = [("pe_cheap", 0.0, 15.0), ("pe_fair", 15.0, 30.0), ("pe_expensive", 30.0, INF)]

# Market capitalisation in millions: (key, low, high), low included, high excluded.
MARKET_CAP_RANGES = [
    ("mcap_micro", 0.0, 100.0),
    ("mcap_small", 100.0, 1_000.0),
    ("mcap_midlarge", 1_000.0, 10_000.0),
    ("mcap_mega", 10_000.0, 1e12),
]


def _within(column: str, low: float, high: float, low_in: bool, high_in: bool) -> str:
    above = f"{column} {'>=' if low_in else '>'} {number(low)}"
    return f"{above} AND {column} {'<=' if high_in else '<'} {number(high)}"


def _shared() -> dict[str, str]:
    out = {
        key: f"market_cap > 0 AND {_within('market_cap', low, high, True, False)}"
        for key, low, high in MARKET_CAP_RANGES
    }
    out["pe_unprofitable"] = "pe < 0"
    out.update({key: _within("pe", low, high, False, True) for key, low, high in PE_RANGES})
    return out


def _prior(n: str) -> dict[str, str]:
    return {"prior_0": f"{n} = 0", "prior_1": f"{n} = 1", "prior_2plus": f"{n} >= 2"}


def full_buckets() -> dict[str, str]:
    """The full-history set; a missing prior-crash count counts as none."""
    out = {
        key: _within(column, low, high, False, True)
        for column, ranges in FULL_OPEN_LOW.items()
        for key, low, high in ranges
    }
    out.update(_prior("coalesce(prior_crash_count_20d, 0)"))
    out.update(_shared())
    return out


def recent_buckets() -> dict[str, str]:
    """The recent set; mega caps are unbounded and missing values belong to no bucket."""
    out = {
        key: _within(column, low, high, low_in, high_in)
        for column, ranges in RECENT_RANGES.items()
        for key, low, high, low_in, high_in in ranges
    }
    out.update(_prior("prior_crash_count_20d"))
    out.update(_shared())
    out["mcap_mega"] = "market_cap >= 10000"
    return out


def severity_buckets(buckets: dict[str, str], suffix: str) -> dict[str, str]:
    """Only the crash-size buckets of a set, under suffixed keys."""
    return {key + suffix: test for key, test in buckets.items() if key.startswith("sev_")}


def bucketed(df: DataFrame, buckets: dict[str, dict[str, str]]) -> DataFrame:
    """``bucket`` and ``ret``: a row for each bucket an event belongs to, from one scan of the events.

    ``buckets`` has the bucket sets by the return column they apply to.
    """
    rows = ", ".join(
        f"CASE WHEN {value} IS NOT NULL AND {test} THEN struct('{key}' AS bucket, {value} AS ret) END"
        for value, tests in buckets.items()
        for key, test in tests.items()
    )
    return df.selectExpr(f"inline(array_compact(array({rows})))")


def bucket_outcomes(df: DataFrame, buckets: dict[str, dict[str, str]]) -> DataFrame:
    """Return statistics per bucket."""
    return return_stats(bucketed(df, buckets), ["bucket"])


def bucket_histograms(df: DataFrame, tests: dict[str, str], value: str, spec: HistogramSpec) -> DataFrame:
    """Histogram of the returns of each bucket."""
    return return_histogram(bucketed(df, {value: tests}), spec, keys=["bucket"])
