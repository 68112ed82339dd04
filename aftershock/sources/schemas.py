"""Canonical table schemas and the contract check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TYPES = {
    "date": T.DateType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
}


class SchemaError(ValueError):
    """A table does not have the columns or types it must have."""


def _schema(text: str) -> T.StructType:
    fields = [line.split() for line in text.strip().splitlines()]
    return T.StructType([T.StructField(name, _TYPES[kind], True) for name, kind in fields])


# Column names, order and types of the canonical tables.
DAILY_PRICE = _schema("""
date date
security_id long
open double
high double
low double
close double
adjusted_close double
volume double
daily_return double
daily_return_ex_div double
cum_factor_price double
cum_factor_shares double
shares_outstanding double
""")

SECURITY_MASTER = _schema("""
security_id long
company_id long
ticker string
ticker_start date
ticker_end date
exchange string
security_type string
sic_code long
listing_date date
delisting_date date
delisting_code long
delisting_return double
""")

FUNDAMENTALS = _schema("""
company_id long
security_id long
period_end date
public_date date
freq string
fiscal_year long
fiscal_quarter long
revenue double
net_income double
total_assets double
total_liabilities double
cash double
total_debt double
shares_outstanding double
""")

UNRESTATED_FUNDAMENTALS = _schema("""
company_id long
period_end date
public_date date
rdq_available boolean
freq string
fiscal_year long
fiscal_quarter long
revenue double
cogs double
gross_profit double
ebitda double
depreciation double
operating_income double
net_income double
eps double
interest_expense double
total_assets double
total_liabilities double
cash double
debt_long_term double
debt_current double
total_debt double
current_assets double
current_liabilities double
stockholders_equity double
common_equity double
shares_outstanding double
""")

CORPORATE_ACTION = _schema("""
security_id long
effective_date date
action_type string
value double
code long
details string
""")

SECTOR_METADATA = _schema("""
security_id long
sic_code long
sic_division string
""")

CRASH_EVENT = _schema("""
event_id string
security_id long
company_id long
ticker_as_of_event string
crash_date date
crash_return double
crash_close double
crash_volume double
in_universe_at_event boolean
passes_min_price boolean
""")

SCHEMAS = {
    "daily_price": DAILY_PRICE,
    "security_master": SECURITY_MASTER,
    "fundamentals": FUNDAMENTALS,
    "corporate_action": CORPORATE_ACTION,
    "sector_metadata": SECTOR_METADATA,
}
ACTION_TYPES = ("DELISTING", "SPLIT", "DIVIDEND")


def conform(df: DataFrame, schema: T.StructType, strict: bool = False) -> DataFrame:
    """The columns of ``schema`` in order, cast to its types; extra columns are dropped.

    A missing column is an error at once. With ``strict`` the types must already match; otherwise a
    value that cannot be cast fails the job that reads it (ANSI mode).
    """
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise SchemaError(f"missing required columns: {missing}")
    if strict:
        found = {f.name: f.dataType for f in df.schema}
        wrong = {
            f.name: (found[f.name].simpleString(), f.dataType.simpleString())
            for f in schema
            if found[f.name] != f.dataType
        }
        if wrong:
            raise SchemaError(f"column types (found, required): {wrong}")
        return df.select(*schema.names)
    return df.selectExpr(*[f"cast({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema])


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table of this schema without rows."""
    return spark.createDataFrame([], schema)
