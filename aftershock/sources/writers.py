"""Writing the panel and versioned tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..operators.profile import duplicate_keys
from ..session import staged
from .schemas import DAILY_PRICE, conform


class DuplicateKeyError(ValueError):
    """The panel holds several rows for one security and date."""


def assert_unique_days(prices: DataFrame) -> None:
    """Raise, with up to five examples, when a security has two rows for one date."""
    found = duplicate_keys(prices).collect()
    if found:
        raise DuplicateKeyError(f"duplicate (security_id, date) rows, for example {[r.asDict() for r in found]}")


def security_years(prices: DataFrame) -> DataFrame:
    """Rows and different days of each security in each year: what the manifest and the check for duplicates need."""
    days = prices.groupBy("year", "security_id", "date").agg(F.count(F.lit(1)).alias("n"))
    return days.groupBy("year", "security_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("days"))


def price_manifest(per_security: DataFrame) -> DataFrame:
    """Rows and securities per year."""
    return per_security.groupBy(F.col("year").cast("int").alias("year")).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("securities")
    )


def write_prices(
    prices: DataFrame,
    path: str,
    start_year: int | None = None,
    end_year: int | None = None,
    *,
    version: str = "v1",
    universe=None,
    revision: str | None = None,
) -> DataFrame:
    """Store the panel under ``path/year=YYYY`` with a manifest in ``path/_manifest``; returns the manifest.

    The rows are computed once, into the shared folder, and read twice from there: once for the check of duplicate days, which
    are rejected before anything is published, and the manifest, and once to be published. What is published is
    counted by the job that writes it. Years without rows leave no folder, no rows at all give an empty manifest, and only the years present
    are replaced. ``rebalance`` lets Spark split a heavy year over many
    tasks and files and join small ones, and the sort gives each file narrow security ranges.
    """
    spark = prices.sparkSession
    df = conform(prices, DAILY_PRICE).withColumn("year", F.year("date"))
    if start_year is not None:
        df = df.filter(F.col("year") >= start_year)
    if end_year is not None:
        df = df.filter(F.col("year") <= end_year)
    df = staged(df, "ingest")
    years = staged(security_years(df), "security_years")
    if not years.filter("n > days").isEmpty():
        assert_unique_days(df)
    published = Observation("published")
    (
        df.observe(published, F.count(F.lit(1)).alias("rows"))
        .hint("rebalance", "year")
        .sortWithinPartitions("year", "security_id", "date")
        .write.partitionBy("year")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )
    total = Window.partitionBy()  # one row per year
    manifest = price_manifest(years).select(
        F.lit("daily_prices").alias("name"),
        F.lit(version).alias("version"),
        "year",
        "rows",
        "securities",
        F.lit(",".join(DAILY_PRICE.names)).alias("columns"),
        F.lit(None if universe is None else str(universe)).cast("string").alias("universe_filter"),
        F.coalesce(F.lit(start_year), F.min("year").over(total)).cast("int").alias("start_year"),
        F.coalesce(F.lit(end_year), F.max("year").over(total)).cast("int").alias("end_year"),
        F.sum("rows").over(total).alias("total_rows"),
        F.lit(revision).cast("string").alias("revision"),
    )
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")
    stored = spark.read.schema(manifest.schema).json(f"{path}/_manifest")
    expected = stored.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()["rows"]
    # a job without rows may observe nothing
    if expected and published.get["rows"] != expected:
        raise RuntimeError(f"{published.get['rows']} rows published, {expected} in the manifest")
    return stored


def _digest(df: DataFrame) -> list[Column]:
    # the hash passes over nulls, so their places are hashed too
    names = sorted(df.columns)
    digest = F.xxhash64(*[F.col(c) for c in names], *[F.col(c).isNull() for c in names]).cast("decimal(20,0)")
    return [F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("content")]


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (row_count, content): a digest of the rows that does not depend on their order."""
    return df.agg(*_digest(df))


def write_versioned(
    df: DataFrame,
    folder: str,
    name: str,
    version: str,
    *,
    meta: dict | None = None,
    revision: str | None = None,
) -> DataFrame:
    """Store ``folder/name_version`` and a one-row description next to it; returns the description.

    Rows and content are taken by the job that writes, so that nothing is read again for them.
    """
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{name}_{version}"
    written = Observation("written")
    df.observe(written, *_digest(df)).write.mode("overwrite").parquet(path)
    size = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        .agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))
    )
    described = size.select(
        F.lit(name).alias("name"),
        F.lit(version).alias("version"),
        F.lit(path).alias("path"),
        F.lit(written.get["row_count"]).cast("long").alias("row_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.lit(written.get["content"]).alias("content"),
        "size_bytes",
        F.lit(revision).cast("string").alias("revision"),
        F.lit(datetime.now(timezone.utc).isoformat()).alias("generated_at"),
        F.create_map(*[F.lit(str(x)) for kv in (meta or {}).items() for x in kv]).cast("map<string,string>").alias("meta"),
    )
    described.coalesce(1).write.mode("overwrite").json(f"{path}.meta")
    return spark.read.schema(described.schema).json(f"{path}.meta")
