"""Recovery rates, return distributions, buckets and coverage over the event dataset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arith import named, number, wilson
from .quantiles import distribution

SMALL_SAMPLE = 50


def with_wilson(df: DataFrame, hits: str = "hits", n: str = "n") -> DataFrame:
    """Add rate, ci_low and ci_high."""
    return df.selectExpr("*", *named(wilson(hits, n)))


def _hits_and_n(target: str) -> list[Column]:
    return [F.expr(f"coalesce(sum(cast({target} AS bigint)), 0) AS hits"), F.expr(f"count({target}) AS n")]


def overall_rate(df: DataFrame, target: str) -> DataFrame:
    """One row with the recovery rate over determined events; nulls when there are none."""
    return with_wilson(df.agg(*_hits_and_n(target)))


def grouped_rate(df: DataFrame, by: str, target: str) -> DataFrame:
    """Recovery rate per group over determined events."""
    return with_wilson(df.filter(f"{target} IS NOT NULL").groupBy(by).agg(*_hits_and_n(target)))


def top_groups(rates: DataFrame, by: str, top: int) -> DataFrame:
    """The ``top`` largest groups of a rate table, for a printed report."""
    return rates.orderBy(F.desc("n"), by).limit(top)


def recovery_grid(
    df: DataFrame, percents: Sequence[int] = (5, 10, 20), horizons: Sequence[int] = (5, 20, 60)
) -> DataFrame:
    """Recovery rate per threshold and horizon, in one pass over the events."""
    cells = [
        f"struct({p} AS threshold_pct, {h} AS horizon, hit_{p}pct_{h}d AS hit)" for p in percents for h in horizons
    ]
    long = df.selectExpr(f"inline(array({', '.join(cells)}))")
    return with_wilson(long.groupBy("threshold_pct", "horizon").agg(*_hits_and_n("hit")))


# Code of each descriptive slice. A null feature gets no code, except in the slices by
# crash size, prior crashes and market day, where it falls into the last group.
SLICE_CODES = {
    "magnitude": """CASE WHEN crash_return > -0.15D THEN 0 WHEN crash_return > -0.20D THEN 1
        WHEN crash_return > -0.30D THEN 2 ELSE 3 END""",
    "prior_count": """CASE WHEN prior_crash_count_20d = 0 THEN 0 WHEN prior_crash_count_20d = 1 THEN 1
        WHEN prior_crash_count_20d = 2 THEN 2 ELSE 3 END""",
    "size": """CASE WHEN market_cap IS NULL THEN NULL WHEN market_cap < 300 THEN 0 WHEN market_cap < 2000 THEN 1
        WHEN market_cap < 10000 THEN 2 ELSE 3 END""",
    "profitability": "CASE WHEN net_margin IS NULL THEN NULL WHEN net_margin < 0 THEN 0 ELSE 1 END",
    "leverage": """CASE WHEN debt_to_assets IS NULL THEN NULL WHEN debt_to_assets < 0.1D THEN 0
        WHEN debt_to_assets < 0.3D THEN 1 WHEN debt_to_assets < 0.5D THEN 2 ELSE 3 END""",
    "market_day": """CASE WHEN market_return_1d <= -0.05D THEN 0 WHEN market_return_1d <= -0.02D THEN 1
        WHEN market_return_1d < 0 THEN 2 ELSE 3 END""",
}

# Labels of the slice codes.
SLICE_LABELS = {
    "magnitude": ("-10% to -15%", "-15% to -20%", "-20% to -30%", "≤ -30%"),
    "prior_count": ("fresh (0 prior/20d)", "1 prior", "2 prior", "3+ prior"),
    "size": ("micro (<$300M)", "small ($0.3–2B)", "mid ($2–10B)", "large (≥$10B)"),
    "profitability": ("unprofitable (margin<0)", "profitable (margin≥0)"),
    "leverage": ("<0.1", "0.1–0.3", "0.3–0.5", "≥0.5"),
    "market_day": ("market ≤ -5% (broad crash)", "-5% to -2%", "-2% to 0%", "market ≥ 0%"),
}


# Conditions of the headline rates.
HEADLINES = {
    "fresh": "prior_crash_count_20d = 0",
    "three_or_more_prior": "prior_crash_count_20d >= 3",
    "market_crash": "market_return_1d <= -0.05D",
    "market_up": "market_return_1d >= 0",
    "micro_cap": "market_cap < 300",
    "large_cap": "market_cap >= 10000",
    "unprofitable": "net_margin < 0",
    "profitable": "net_margin >= 0",
}


def slice_rates(df: DataFrame, name: str, target: str) -> DataFrame:
    """Recovery rate per code of a slice, with its label."""
    coded = df.selectExpr(f"{SLICE_CODES[name]} AS code", target).filter("code IS NOT NULL")
    labels = ", ".join(f"'{x}'" for x in SLICE_LABELS[name])
    return grouped_rate(coded, "code", target).selectExpr("*", f"element_at(array({labels}), code + 1) AS label")


def headline_rates(df: DataFrame, target: str) -> DataFrame:
    """Recovery rate of eight named conditions, in one pass; an event may meet several."""
    return grouped_rate(explode_keys(df, HEADLINES, "headline", [target]), "headline", target)


def explode_keys(df: DataFrame, conditions: dict[str, str], name: str, keep: Sequence[str]) -> DataFrame:
    """One row per event and condition it meets: a single scan serves all conditions."""
    met = ", ".join(f"CASE WHEN {test} THEN '{key}' END" for key, test in conditions.items())
    return df.selectExpr(f"explode(array_compact(array({met}))) AS {name}", *keep)


def quantile_buckets(df: DataFrame, column: str, q: int, prefix: str, name: str = "bucket") -> DataFrame:
    """``df`` with a label prefix1..prefix<q> by quantile; intervals are closed on the right.

    Ties share a bucket; where breaks coincide the labels between them stay unused. Null stays null.
    """
    inner = [i / q for i in range(1, q)]
    # one row with q - 1 breaks, so broadcasting it is bounded; without values there is no row
    breaks = distribution(df, [], column, inner).selectExpr(*[f"q{i} AS __q{i}" for i in range(len(inner))])
    above = " + ".join(["1", *[f"cast({column} > __q{i} AS int)" for i in range(len(inner))]])
    label = f"CASE WHEN {column} IS NOT NULL THEN concat('{prefix}', {above}) END AS {name}"
    return df.join(F.broadcast(breaks), F.lit(True), "left").selectExpr(*df.columns, label)


def return_stats(df: DataFrame, keys: Sequence[str], value: str = "ret") -> DataFrame:
    """n, median, mean and share of positive returns per key, flagged when the sample is small."""
    return distribution(df, keys, value).selectExpr(
        *keys, "n", "q0 AS median", "mean", "n_positive / n AS p_positive", f"n < {SMALL_SAMPLE} AS small_n"
    )


def tail_stats(outcomes: DataFrame, horizon: int) -> DataFrame:
    """One row over an outcome table: pool, censored, observed and the tails of the return."""
    r = f"ret_{horizon}"
    middle = distribution(outcomes, [], r).selectExpr("q0 AS median")
    return outcomes.selectExpr(
        "count(*) AS events",
        f"count_if(censored_{horizon}) AS censored",
        f"count({r}) AS observed",
        f"avg(cast({r} > 0 AS int)) AS p_positive",
        f"avg(cast({r} >= 0.10D AS int)) AS p_up_10",
        f"avg(cast({r} <= -0.50D AS int)) AS p_down_50",
        f"avg({r}) AS mean",
    ).join(F.broadcast(middle), F.lit(True), "left")  # one row each


@dataclass(frozen=True)
class HistogramSpec:
    """Fixed-width bins between ``low`` and ``high``; values beyond them fall into the end bins."""

    low: float
    high: float
    width: float

    @property
    def edges(self) -> list[float]:
        """Bin edges, spaced by the width as it is after rounding at the lower end."""
        step = (self.low + self.width) - self.low
        return [self.low + i * step for i in range(round((self.high - self.low) / self.width) + 1)]


# Display ranges of the one-year, sixty-day and one-week returns.
ONE_YEAR = HistogramSpec(-1.0, 2.0, 0.10)
SIXTY_DAY = HistogramSpec(-1.0, 1.0, 0.05)
ONE_WEEK = HistogramSpec(-0.5, 0.5, 0.025)


def return_histogram(df: DataFrame, spec: HistogramSpec, value: str = "ret", keys: Sequence[str] = ()) -> DataFrame:
    """Occupied bins with count and share in percent, per key. Bins are closed on the left, the last on both sides."""
    edges = [number(e) for e in spec.edges]
    clipped = f"least(greatest({value}, {number(spec.low)}), {number(spec.high)})"
    # comparing with the edges themselves, not dividing, settles values that lie on an edge
    index = " + ".join(["0", *[f"cast(clipped >= {e} AS int)" for e in edges[1:-1]]])
    counted = (
        df.filter(f"{value} IS NOT NULL AND NOT isnan({value})")
        .selectExpr(*keys, f"{clipped} AS clipped")
        .selectExpr(*keys, f"{index} AS bin")
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # one row per key and bin remains
    whole = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return counted.selectExpr(
        *keys,
        "bin",
        f"element_at(array({', '.join(edges)}), bin + 1) AS bin_low",
        "n",
        f"100D * n / sum(n) OVER ({whole}) AS percent",
    )


def missing_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of nulls per column, one pass."""
    measured = df.selectExpr(*[f"avg(cast({c} IS NULL AS int)) AS {c}" for c in columns])
    return measured.unpivot([], list(columns), "feature", "missing")


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows per value; with ``top``, the smallest values only."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted if top is None else counted.orderBy(F.col(column).asc_nulls_first()).limit(top)


def recent_summary(recent: DataFrame) -> DataFrame:
    """One row: events and how many had no crash in the 60 rows before."""
    return recent.selectExpr(
        "count(*) AS events",
        "count_if(prior_crash_count_60d = 0) AS fresh",
        "avg(cast(prior_crash_count_60d = 0 AS int)) AS fresh_share",
    )


def regime_stats(outcomes: DataFrame, regimes: Sequence[tuple[str, int, date | str | None]]) -> DataFrame:
    """Unconditional return statistics per regime (name, horizon, first event date)."""
    rows = []
    for name, h, since in regimes:
        ret = f"ret_{h}" if since is None else f"CASE WHEN crash_date >= DATE '{since}' THEN ret_{h} END"
        rows.append(f"struct('{name}' AS regime, {ret} AS ret)")
    return return_stats(outcomes.selectExpr(f"inline(array({', '.join(rows)}))"), ["regime"])
