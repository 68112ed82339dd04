"""Security-master summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import distinct_ids


def earliest(df: DataFrame, column: str) -> str:
    """Aggregate text: the non-null ``column`` of the earliest name period (ties: the smallest value)."""
    if "ticker_start" not in df.columns:
        return f"min({column})"
    return f"min(CASE WHEN {column} IS NOT NULL THEN struct(ticker_start AS t, {column} AS v) END).v"


def master_summary(master: DataFrame) -> DataFrame:
    """One row: sizes, active and delisted securities, covered dates and exchanges."""
    counted = master.selectExpr(
        "count(*) AS rows",
        "min(ticker_start) AS date_min",
        "max(ticker_end) AS date_max",
    )
    # the labels are a short code list, so the distinct ones fit in one row
    exchanges = master.select("exchange").distinct().selectExpr(
        "array_join(array_sort(collect_list(exchange)), ',') AS exchanges"
    )
    ids = distinct_ids(
        master,
        {
            "securities": "security_id",
            "companies": "company_id",
            "with_delisting": "CASE WHEN delisting_date IS NOT NULL THEN security_id END",
        },
    )
    return counted.crossJoin(F.broadcast(ids)).crossJoin(F.broadcast(exchanges)).selectExpr(
        "*", "securities - with_delisting AS active"
    )  # one row each


def delisting_class(code: str) -> str:
    """active, acquired (200-399) or dropped (400 and up)."""
    return (
        f"CASE WHEN {code} IS NULL THEN 'active' WHEN {code} BETWEEN 200 AND 399 THEN 'acquired' "
        f"WHEN {code} >= 400 THEN 'dropped' END"
    )


def delisting_classes(master: DataFrame) -> DataFrame:
    """Securities per delisting class."""
    per_security = master.groupBy("security_id").agg(F.max("delisting_code").alias("code"))
    classed = per_security.selectExpr(f"{delisting_class('code')} AS delisting_class")
    return classed.groupBy("delisting_class").agg(F.count(F.lit(1)).alias("securities"))


def renamed_securities(master: DataFrame, top: int | None = None) -> DataFrame:
    """Securities that had more than one ticker; with ``top``, those with the most."""
    found = (
        master.groupBy("security_id").agg(F.count_distinct("ticker").alias("n_tickers")).filter("n_tickers > 1")
    )
    return found if top is None else found.orderBy(F.desc("n_tickers"), "security_id").limit(top)
