"""Fundamentals as they were public on the event date."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.arith import change, finite, named, ratio
from .events import CLEAN
from .pit import asof_join, link_companies

STALE_DAYS = 200

# Names and order of the ratios, and of what is known about the statement they come from.
FUNDAMENTAL_RATIOS = (
    "revenue_growth_yoy",
    "revenue_growth_qoq",
    "eps_growth_yoy",
    "gross_margin",
    "operating_margin",
    "net_margin",
    "roa",
    "roe",
    "net_debt",
    "current_ratio",
    "debt_to_assets",
    "net_debt_to_ebitda",
    "interest_coverage",
    "market_cap",
    "pe",
    "price_to_sales",
    "ev_to_sales",
    "ev_to_ebitda",
)

FUNDAMENTAL_META = (
    "fundamentals_available",
    "fundamentals_period_end",
    "fundamentals_public_date",
    "days_since_fundamental",
    "fundamentals_stale",
    "fundamentals_rdq_available",
)

# Trailing-year sum -> quarterly column.
_TRAILING = {
    "revenue_ttm": "revenue",
    "ni_ttm": "net_income",
    "gross_profit_ttm": "gross_profit",
    "operating_income_ttm": "operating_income",
    "ebitda_ttm": "ebitda",
    "interest_ttm": "interest_expense",
}


def enrich_fundamentals(fundamentals: DataFrame) -> DataFrame:
    """Quarters with trailing four-quarter sums (all four needed) and growth rates.

    A window holds one company's quarters, at most a few hundred rows.
    """
    spec = "PARTITION BY company_id ORDER BY period_end"
    year = f"OVER ({spec} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
    columns = {
        name: f"CASE WHEN count({c}) {year} = 4 THEN sum({c}) {year} END" for name, c in _TRAILING.items()
    }
    columns["revenue_growth_yoy"] = change("revenue", f"lag(revenue, 4) OVER ({spec})")
    columns["revenue_growth_qoq"] = change("revenue", f"lag(revenue, 1) OVER ({spec})")
    columns["eps_growth_yoy"] = change("eps", f"lag(eps, 4) OVER ({spec})")
    return fundamentals.selectExpr("*", *named(columns))


#: A further ratio for ``build_fundamental_features``, which is not among the features of the dataset.
EBITDA_MARGIN = {"ebitda_margin": ratio("ebitda_ttm", "revenue_ttm")}


def build_fundamental_features(
    events: DataFrame, fundamentals: DataFrame, link: DataFrame, more: dict[str, str] | None = None
) -> DataFrame:
    """Growth, profitability, balance-sheet and valuation ratios per event, with their provenance.

    ``more`` names further ratios over the columns of the statement, so that they need no search of their own.
    """
    known = asof_join(
        link_companies(events, link),
        enrich_fundamentals(fundamentals),
        key="company_id",
        at="crash_date",
        known="public_date",
        newest="period_end",
        take=(
            "period_end",
            "public_date",
            "rdq_available",
            *_TRAILING,
            "revenue_growth_yoy",
            "revenue_growth_qoq",
            "eps_growth_yoy",
            "total_assets",
            "cash",
            "total_debt",
            "current_assets",
            "current_liabilities",
            "stockholders_equity",
            "shares_outstanding",
        ),
    ).selectExpr(
        "*",
        "crash_close * shares_outstanding AS cap",
        "total_debt - cash AS debt",
        "cast(datediff(crash_date, period_end) AS bigint) AS age",
    )
    ratios = {
        "gross_margin": ratio("gross_profit_ttm", "revenue_ttm"),
        "operating_margin": ratio("operating_income_ttm", "revenue_ttm"),
        "net_margin": ratio("ni_ttm", "revenue_ttm"),
        "roa": ratio("ni_ttm", "total_assets"),
        "roe": ratio("ni_ttm", "stockholders_equity"),
        "net_debt": "debt",
        "current_ratio": ratio("current_assets", "current_liabilities"),
        "debt_to_assets": ratio("total_debt", "total_assets"),
        "net_debt_to_ebitda": ratio("debt", "ebitda_ttm"),
        "interest_coverage": ratio("operating_income_ttm", "interest_ttm"),
        "market_cap": "cap",
        "pe": ratio("cap", "ni_ttm"),
        "price_to_sales": ratio("cap", "revenue_ttm"),
        "ev_to_sales": ratio("cap + debt", "revenue_ttm"),
        "ev_to_ebitda": ratio("cap + debt", "ebitda_ttm"),
    }
    provenance = {
        "fundamentals_available": "period_end IS NOT NULL",
        "fundamentals_period_end": "period_end",
        "fundamentals_public_date": "public_date",
        "days_since_fundamental": "age",
        "fundamentals_stale": f"age > {STALE_DAYS}",
        "fundamentals_rdq_available": "coalesce(rdq_available, false)",
    }
    return known.selectExpr(
        "event_id",
        "revenue_growth_yoy",
        "revenue_growth_qoq",
        "eps_growth_yoy",
        *named({name: finite(r) for name, r in (ratios | (more or {})).items()}),
        *named(provenance),
    )


def event_ebitda_margin(events: DataFrame, fundamentals: DataFrame, link: DataFrame) -> DataFrame:
    """Trailing EBITDA margin of each event that has a linked company."""
    known = asof_join(
        link_companies(events, link).filter("company_id IS NOT NULL"),
        enrich_fundamentals(fundamentals),
        key="company_id",
        at="crash_date",
        known="public_date",
        newest="period_end",
        take=("ebitda_ttm", "revenue_ttm"),
    )
    return known.selectExpr("event_id", *named({name: finite(r) for name, r in EBITDA_MARGIN.items()}))


def _present(column: str) -> str:
    return f"cast({column} IS NOT NULL AS int)"


def fundamentals_coverage(fundamentals: DataFrame) -> DataFrame:
    """One row: size, period range, share with a report date and share present of the key fields."""
    fields = ("revenue", "net_income", "total_assets", "total_debt", "eps", "stockholders_equity", "ebitda")
    return fundamentals.selectExpr(
        "count(*) AS rows",
        "count(DISTINCT company_id) AS companies",
        "min(period_end) AS period_min",
        "max(period_end) AS period_max",
        "avg(cast(rdq_available AS int)) AS rdq_available",
        *[f"avg({_present(c)}) AS {c}_present" for c in fields],
    )


def fundamental_summary(features: DataFrame, events: DataFrame) -> DataFrame:
    """One row: availability (all and clean), staleness, and clean coverage of the key ratios."""
    flags = events.selectExpr("event_id", f"{CLEAN} AS __clean")
    fields = ("net_margin", "roe", "debt_to_assets", "revenue_growth_yoy", "pe", "ev_to_ebitda")
    return features.join(flags, "event_id").selectExpr(
        "count(*) AS rows",
        "avg(cast(fundamentals_available AS int)) AS available",
        "avg(CASE WHEN __clean THEN cast(fundamentals_available AS int) END) AS available_clean",
        "avg(CASE WHEN fundamentals_available THEN cast(fundamentals_stale AS int) END) AS stale",
        *[f"avg(CASE WHEN __clean THEN {_present(c)} END) AS {c}_present" for c in fields],
    )
