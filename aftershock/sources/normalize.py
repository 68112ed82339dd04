"""Raw vendor tables to canonical tables. Vendor column names occur only here and in the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arith import sum_nulls_as_zero
from .schemas import (
    CORPORATE_ACTION,
    DAILY_PRICE,
    FUNDAMENTALS,
    SECTOR_METADATA,
    SECURITY_MASTER,
    UNRESTATED_FUNDAMENTALS,
    conform,
)

# Exchange codes; other codes stay as they are.
EXCHANGES = {"N": "NYSE", "A": "NYSE American", "Q": "Nasdaq"}

# SIC major divisions, both ends included.
SIC_DIVISIONS = [
    (100, 999, "Agriculture, Forestry & Fishing"),
    (1000, 1499, "Mining"),
    (1500, 1799, "Construction"),
    (2000, 3999, "Manufacturing"),
    (4000, 4999, "Transportation & Public Utilities"),
    (5000, 5199, "Wholesale Trade"),
    (5200, 5999, "Retail Trade"),
    (6000, 6799, "Finance, Insurance & Real Estate"),
    (7000, 8999, "Services"),
    (9100, 9729, "Public Administration"),
]

# Raw daily-bar columns.
DAILY_BAR_COLUMNS = {
    "date": "dlycaldt",
    "security_id": "permno",
    "open": "dlyopen",
    "high": "dlyhigh",
    "low": "dlylow",
    "close": "dlyclose",
    "volume": "dlyvol",
    "daily_return": "dlyret",
    "daily_return_ex_div": "dlyretx",
    "cum_factor_price": "dlycumfacpr",
    "cum_factor_shares": "dlycumfacshr",
    "shares_outstanding": "shrout",
}

# Raw name-period columns.
NAME_COLUMNS = {
    "security_id": "permno",
    "company_id": "permco",
    "ticker": "ticker",
    "ticker_start": "namedt",
    "ticker_end": "nameenddt",
    "security_type": "securitytype",
    "sic_code": "siccd",
    "listing_date": "securitybegdt",
}

# Raw fundamentals columns by reporting frequency.
FUNDAMENTAL_COLUMNS = {
    "Q": {
        "period_end": "datadate",
        "public_date": "rdq",
        "fiscal_year": "fyearq",
        "fiscal_quarter": "fqtr",
        "revenue": "revtq",
        "net_income": "niq",
        "total_assets": "atq",
        "total_liabilities": "ltq",
        "cash": "cheq",
        "long_debt": "dlttq",
        "short_debt": "dlcq",
        "shares_outstanding": "cshoq",
    },
    "A": {
        "period_end": "datadate",
        "public_date": "pdate",
        "fiscal_year": "fyear",
        "fiscal_quarter": None,
        "revenue": "revt",
        "net_income": "ni",
        "total_assets": "at",
        "total_liabilities": "lt",
        "cash": "che",
        "long_debt": "dltt",
        "short_debt": "dlc",
        "shares_outstanding": "csho",
    },
}

# Raw columns of the unrestated quarterly table that map one to one.
UNRESTATED_COLUMNS = {
    "company_id": "gvkey",
    "fiscal_year": "fyrq",
    "fiscal_quarter": "fqtr",
    "revenue": "saleq",
    "cogs": "cogsq",
    "ebitda": "oibdpq",
    "depreciation": "dpq",
    "net_income": "niq",
    "eps": "epspxq",
    "interest_expense": "xintq",
    "total_assets": "atq",
    "total_liabilities": "ltq",
    "cash": "cheq",
    "debt_long_term": "dlttq",
    "debt_current": "dlcq",
    "current_assets": "actq",
    "current_liabilities": "lctq",
    "stockholders_equity": "seqq",
    "common_equity": "ceqq",
    "shares_outstanding": "cshoq",
}

REPORT_LAG_DAYS = 60  # assumed publication lag where the report date is missing
FIRST_DELISTING_CODE = 200  # lower codes mean "still trading"


def _renamed(columns: dict[str, str | None]) -> list[str]:
    return [f"{'NULL' if raw is None else raw} AS {name}" for name, raw in columns.items()]


def exchange_label(code: str) -> str:
    """Readable exchange name; unknown codes pass through."""
    known = " ".join(f"WHEN '{c}' THEN '{label}'" for c, label in EXCHANGES.items())
    return f"CASE cast({code} AS string) {known} ELSE cast({code} AS string) END"


def sic_division(sic: str) -> str:
    """Major division of a SIC code; Unknown without a code, Nonclassifiable between the ranges."""
    ranges = " ".join(f"WHEN {sic} BETWEEN {low} AND {high} THEN '{name}'" for low, high, name in SIC_DIVISIONS)
    return f"CASE WHEN {sic} IS NULL THEN 'Unknown' {ranges} ELSE 'Nonclassifiable' END"


def normalize_prices(bars: DataFrame) -> DataFrame:
    """Raw daily bars to daily_price. The return column is kept as delivered (split and dividend adjusted)."""
    factor, close = "cast(cum_factor_price AS double)", "cast(close AS double)"
    adjusted = f"CASE WHEN {factor} <> 0 THEN {close} / {factor} ELSE {close} END AS adjusted_close"
    return conform(bars.selectExpr(*_renamed(DAILY_BAR_COLUMNS)).selectExpr("*", adjusted), DAILY_PRICE)


def normalize_security_master(names: DataFrame, delistings: DataFrame | None = None) -> DataFrame:
    """Name periods, with the delisting (if it is a real one) of their security on every period."""
    out = names.selectExpr(*_renamed(NAME_COLUMNS), f"{exchange_label('primaryexch')} AS exchange")
    if delistings is None:
        out = out.selectExpr("*", "NULL AS delisting_date", "NULL AS delisting_code", "NULL AS delisting_return")
    else:
        real = f"CASE WHEN cast(dlstcd AS bigint) >= {FIRST_DELISTING_CODE} THEN"
        gone = delistings.selectExpr(
            "permno AS security_id",
            f"{real} dlstdt END AS delisting_date",
            f"{real} dlstcd END AS delisting_code",
            f"{real} dlret END AS delisting_return",
        )
        out = out.join(gone, "security_id", "left")
    return conform(out, SECURITY_MASTER)


def normalize_delistings(delistings: DataFrame) -> DataFrame:
    """Delisting records as corporate actions."""
    df = delistings.selectExpr(
        "permno AS security_id",
        "dlstdt AS effective_date",
        "'DELISTING' AS action_type",
        "dlret AS value",
        "dlstcd AS code",
        "concat('dlstcd=', cast(dlstcd AS bigint)) AS details",
    )
    return conform(df, CORPORATE_ACTION)


def normalize_sector(names: DataFrame) -> DataFrame:
    """SIC code and division, one row per security and code."""
    codes = names.selectExpr("cast(permno AS bigint) AS security_id", "cast(siccd AS bigint) AS sic_code").distinct()
    return conform(codes.selectExpr("*", f"{sic_division('sic_code')} AS sic_division"), SECTOR_METADATA)


def normalize_fundamentals(raw: DataFrame, freq: str = "Q", links: DataFrame | None = None) -> DataFrame:
    """Quarterly or annual statements to the 14-column table; debt counts a missing part as zero.

    With ``links`` (gvkey, lpermno) each company gets its lowest linked security.
    """
    if freq not in FUNDAMENTAL_COLUMNS:
        raise ValueError(f"freq must be one of {sorted(FUNDAMENTAL_COLUMNS)}, not {freq!r}")
    debt = sum_nulls_as_zero("cast(long_debt AS double)", "cast(short_debt AS double)")
    out = raw.selectExpr(
        "cast(gvkey AS bigint) AS company_id", f"'{freq}' AS freq", *_renamed(FUNDAMENTAL_COLUMNS[freq])
    ).selectExpr("*", f"{debt} AS total_debt")
    if links is None:
        out = out.selectExpr("*", "NULL AS security_id")
    else:
        one = links.selectExpr("cast(gvkey AS bigint) AS company_id", "cast(lpermno AS bigint) AS security_id")
        out = out.join(one.groupBy("company_id").agg(F.min("security_id").alias("security_id")), "company_id", "left")
    return conform(out, FUNDAMENTALS)


def normalize_unrestated(raw: DataFrame) -> DataFrame:
    """As-first-reported quarters with the date they became public.

    A missing report date falls back to period end + 60 days and is flagged; total debt is missing
    only when both of its parts are.
    """
    long_debt, short_debt = "cast(debt_long_term AS double)", "cast(debt_current AS double)"
    debt = sum_nulls_as_zero(long_debt, short_debt)
    df = raw.selectExpr(
        *_renamed(UNRESTATED_COLUMNS), "cast(datadate AS date) AS period_end", "cast(rdq AS date) AS reported"
    ).selectExpr(
        "*",
        f"coalesce(reported, date_add(period_end, {REPORT_LAG_DAYS})) AS public_date",
        "reported IS NOT NULL AS rdq_available",
        "'Q' AS freq",
        "cast(revenue AS double) - cast(cogs AS double) AS gross_profit",
        "cast(ebitda AS double) - cast(depreciation AS double) AS operating_income",
        f"CASE WHEN {long_debt} IS NOT NULL OR {short_debt} IS NOT NULL THEN {debt} END AS total_debt",
    )
    return conform(df, UNRESTATED_FUNDAMENTALS)
