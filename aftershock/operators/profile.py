"""Coverage checks of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(prices: DataFrame, sample: int | None = 5) -> DataFrame:
    """(security_id, date) pairs that occur more than once; ``sample`` limits an error report to a few."""
    found = prices.groupBy("security_id", "date").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
    return found if sample is None else found.limit(sample)


def distinct_ids(df: DataFrame, counted: dict[str, str]) -> DataFrame:
    """One row: for each name, how many different ids its expression has; exact, nulls left out.

    Ids are whole numbers. They are marked in bitmaps of 32,768 ids each, which are merged where they are read, so
    that what moves are bitmaps and not ids. Ids should be dense, as securities and companies are: one that is far from
    all others takes a bitmap of its own.
    """
    marks = ", ".join(f"struct('{name}' AS what, cast({e} AS bigint) AS id)" for name, e in counted.items())
    maps = (
        df.selectExpr(f"inline(array({marks}))")
        .filter("id IS NOT NULL")
        .groupBy("what", F.expr("bitmap_bucket_number(id)").alias("bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(id))").alias("map"))
    )
    return maps.agg(
        *[F.expr(f"coalesce(sum(CASE WHEN what = '{name}' THEN bitmap_count(map) END), 0L) AS {name}") for name in counted]
    )


def table_profile(
    df: DataFrame,
    *,
    date_column: str | None = None,
    id_column: str | None = None,
    counted_column: str | None = None,
) -> DataFrame:
    """One row: columns, rows, date range, distinct whole-number ids and non-null values of one column."""
    measures = [
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"),
        F.count(F.lit(1)).alias("n_rows"),
    ]
    if date_column:
        measures += [F.min(date_column).alias("min_date"), F.max(date_column).alias("max_date")]
    if counted_column:
        measures.append(F.count(counted_column).alias("n_present"))
    profile = df.agg(*measures)
    if id_column:
        profile = profile.crossJoin(F.broadcast(distinct_ids(df, {"n_distinct_ids": id_column})))  # one row each
    return profile


def code_frequency(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Records per code, each next to the number of all records; with ``top``, the most frequent codes only."""
    counts = df.groupBy(F.col(column).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    if top is not None:
        counts = counts.orderBy(F.desc("n"), F.col("code").asc_nulls_last()).limit(top)
    return counts.crossJoin(F.broadcast(total))  # one row
