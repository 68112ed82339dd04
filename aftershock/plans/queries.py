"""Registered queries: each takes a session and the folder of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import buckets, dataset, events, features, fundamentals, labels, outcomes, pit, profile, stats, universe
from ..operators.features import MARKET_FEATURES
from ..session import stage_path
from ..sources import normalize, schemas, tables, writers
from . import demo
from .params import RECENT_START, REGIMES, SAMPLE_END, SAMPLE_START, SAMPLE_TICKER
from .study import Study

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def shown(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, so that results compare across engines.

    The cut lies a millionth below one half: a mean that falls exactly between two results is then rounded up
    whatever the last bit of its sum. The rounding stays in doubles, so that NaN, infinities and values of any size
    pass through.
    """
    return df.selectExpr(
        *[
            f"rint({f.name} * 1e6D + 0.000001D) / 1e6D AS {f.name}" if f.dataType == T.DoubleType() else f.name
            for f in df.schema
        ]
    )


BOTH = ("daily_prices", "crash_events")
#: All that the bucket reports and the events they start from read of the panel.
BUCKET_PANEL = ("date", "security_id", "close", "volume", "daily_return")


def _query(stage: tuple[str, ...] = (), name: str | None = None, panel: tuple[str, ...] | None = None):
    def register(build: Callable[[Study], DataFrame]):
        key = name or build.__name__
        _QUERIES[key] = lambda spark, folder: shown(build(Study(spark, folder, stage, panel)))
        return build

    return register


def queries() -> dict[str, Query]:
    """All registered queries by name."""
    return dict(_QUERIES)


# --- sources and sinks


@_query()
def scan_panel_range(s: Study) -> DataFrame:
    return tables.daily_prices(
        s.bars, s.names, universe=tables.US_COMMON_STOCK, start="1997-01-01", end="1999-06-30"
    )


@_query()
def panel_write_manifest(s: Study) -> DataFrame:
    manifest = writers.write_prices(s.prices, stage_path(s.spark, "panel"))
    return manifest.select("year", "rows", "securities")


@_query()
def scan_stored_panel(s: Study) -> DataFrame:
    path = stage_path(s.spark, "panel")
    writers.write_prices(s.prices, path)
    return tables.scan_prices(s.spark, path).filter("year BETWEEN 1997 AND 1998").drop("year")


@_query()
def stored_panel_ranges(s: Study) -> DataFrame:
    path = stage_path(s.spark, "panel")
    writers.write_prices(s.prices, path)
    return tables.stored_ranges(s.spark, path)


@_query(("crash_events",))
def panel_around_severe_events(s: Study) -> DataFrame:
    path = stage_path(s.spark, "panel")
    writers.write_prices(s.prices, path)
    severe = events.clean_pool(s.events).filter("crash_return <= -0.33D AND crash_date < DATE '1997-01-01'")
    panel = tables.prices_of_years(s.spark, path, severe, back=1).select("security_id", "date", "close")
    near = F.expr("security_id = __sid AND date BETWEEN date_sub(crash_date, 60) AND crash_date")
    rows = severe.selectExpr("event_id", "security_id AS __sid", "crash_date").join(panel, near)
    return rows.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("days"), F.min("close").alias("lowest"), F.max("close").alias("highest")
    )


@_query()
def versioned_write_fingerprint(s: Study) -> DataFrame:
    described = writers.write_versioned(s.events, stage_path(s.spark, "artifacts"), "crash_events", "v1")
    stored = s.spark.read.parquet(described.first()["path"])
    # what was to be written against what is there
    again = writers.fingerprint(s.events).select(F.col("content").alias("again"))
    described = described.drop("content").crossJoin(F.broadcast(writers.fingerprint(stored).select("content")))
    return described.crossJoin(F.broadcast(again)).select(
        "name",
        "version",
        "row_count",
        F.array_join("columns", ",").alias("columns"),
        (F.col("content") == F.col("again")).alias("same_content"),
        (F.col("size_bytes") > 0).alias("has_bytes"),
    )


@_query()
def sql_over_parquet(s: Study) -> DataFrame:
    path = stage_path(s.spark, "panel")
    writers.write_prices(s.prices, path)
    return tables.sql_over(
        s.spark,
        path,
        """SELECT year, count(*) AS crashes, max(daily_return) AS mildest
           FROM prices WHERE daily_return <= -0.10D GROUP BY year""",
    )


@_query()
def security_master(s: Study) -> DataFrame:
    return s.master


@_query()
def master_summary(s: Study) -> DataFrame:
    return universe.master_summary(s.master)


@_query()
def delisting_classes(s: Study) -> DataFrame:
    return universe.delisting_classes(s.master)


@_query()
def renamed_securities(s: Study) -> DataFrame:
    return universe.renamed_securities(s.master)


@_query()
def corporate_actions(s: Study) -> DataFrame:
    return tables.corporate_actions(s.delistings)


@_query()
def sector_metadata(s: Study) -> DataFrame:
    return tables.sector_metadata(s.names)


@_query()
def normalize_prices(s: Study) -> DataFrame:
    return s.prices


@_query()
def normalize_fund_q(s: Study) -> DataFrame:
    return tables.fundamentals(s.quarters, s.link, freq="Q")


@_query()
def normalize_fund_a(s: Study) -> DataFrame:
    return tables.fundamentals(s.years, s.link, freq="A")


@_query()
def fund_of_universe(s: Study) -> DataFrame:
    members = s.names.filter(tables.in_universe(tables.US_COMMON_STOCK)).select("permno")
    return tables.fundamentals(s.quarters, s.link, security_ids=members)


@_query()
def prices_by_id_list(s: Study) -> DataFrame:
    chosen = tables.daily_prices(s.bars, security_ids=[1, 3, 5])
    # an empty list keeps nothing, and an empty table adds nothing but its schema
    nothing = tables.daily_prices(s.bars, security_ids=[]).unionByName(schemas.empty(s.spark, schemas.DAILY_PRICE))
    return chosen.unionByName(nothing)


@_query()
def fund_by_company_ids(s: Study) -> DataFrame:
    return tables.fundamentals(s.quarters, s.link, company_ids=[1002, 1004, 1010])


@_query()
def fund_by_company_table(s: Study) -> DataFrame:
    companies = s.names.filter("permno % 4 = 2").selectExpr("permco AS company_id").distinct()
    return tables.fundamentals(s.quarters, s.link, company_ids=companies)


@_query()
def normalize_fund_unrestated(s: Study) -> DataFrame:
    return normalize.normalize_unrestated(s.quarters)


@_query()
def fundamentals_coverage(s: Study) -> DataFrame:
    return fundamentals.fundamentals_coverage(s.fundamentals)


@_query()
def duplicate_keys(s: Study) -> DataFrame:
    items = demo.table(s.spark, s.folder, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("security_id"), F.to_date("l_shipdate").alias("date")
    )
    return profile.duplicate_keys(items, sample=None)


@_query()
def table_profile(s: Study) -> DataFrame:
    return profile.table_profile(s.prices, date_column="date", id_column="security_id", counted_column="close")


@_query()
def code_frequency(s: Study) -> DataFrame:
    return profile.code_frequency(s.delistings, "dlstcd")


@_query()
def sample_extract(s: Study) -> DataFrame:
    chosen = tables.resolve_security(s.names, SAMPLE_TICKER, "supplier")
    delisted = s.delistings.filter(F.col("dlstcd") >= normalize.FIRST_DELISTING_CODE).select("permno")
    one = tables.daily_prices(s.bars, security_ids=chosen, start=SAMPLE_START, end=SAMPLE_END)
    others = tables.daily_prices(s.bars, security_ids=delisted, start=SAMPLE_START, end=SAMPLE_END)
    return one.unionByName(others)


@_query()
def latest_quarters(s: Study) -> DataFrame:
    return tables.latest_quarters(s.quarters).select("gvkey", "datadate", "rdq", "fyearq", "fqtr", "saleq", "niq")


# --- events


@_query()
def crash_events(s: Study) -> DataFrame:
    return s.events


@_query()
def clean_pool(s: Study) -> DataFrame:
    return events.clean_pool(s.events)


@_query()
def event_summary(s: Study) -> DataFrame:
    return events.event_summary(s.events)


@_query()
def consecutive_events(s: Study) -> DataFrame:
    return events.consecutive_events(s.events).select("event_id", "security_id", "crash_date", "gap")


# --- features and labels


@_query(BOTH)
def price_features(s: Study) -> DataFrame:
    return s.price


@_query(BOTH)
def recent_features(s: Study) -> DataFrame:
    return s.recent


@_query(BOTH)
def prior_count_hist(s: Study) -> DataFrame:
    return stats.value_counts(s.recent, "prior_crash_count_20d")


@_query(BOTH)
def recent_summary(s: Study) -> DataFrame:
    return stats.recent_summary(s.recent)


@_query()
def market_features(s: Study) -> DataFrame:
    return features.market_series(s.prices)


@_query(BOTH)
def sector_features(s: Study) -> DataFrame:
    return s.market_sector.select("event_id", *MARKET_FEATURES)


@_query(BOTH)
def labels_grid(s: Study) -> DataFrame:
    return s.labels


@_query(BOTH)
def labels_base_rate(s: Study) -> DataFrame:
    return labels.label_summary(s.labels, s.events)


@_query()
def fund_enriched(s: Study) -> DataFrame:
    return fundamentals.enrich_fundamentals(s.fundamentals)


@_query()
def company_link(s: Study) -> DataFrame:
    return pit.link_companies(s.events, s.link)


@_query()
def fundamental_features(s: Study) -> DataFrame:
    return s.fundamental


@_query()
def fundamental_summary(s: Study) -> DataFrame:
    return fundamentals.fundamental_summary(s.fundamental, s.events)


@_query()
def ebitda_margin(s: Study) -> DataFrame:
    return fundamentals.event_ebitda_margin(events.clean_pool(s.events), s.fundamentals, s.link)


@_query(BOTH)
def event_beta(s: Study) -> DataFrame:
    return features.event_beta(events.clean_pool(s.events), s.prices)


# --- outcomes


@_query(BOTH)
def forward_return_5(s: Study) -> DataFrame:
    return outcomes.forward_returns(s.events, s.prices, 5)


@_query(BOTH)
def forward_return_60(s: Study) -> DataFrame:
    return outcomes.forward_returns(s.events, s.prices, 60)


@_query(BOTH)
def forward_return_252(s: Study) -> DataFrame:
    return outcomes.forward_returns(s.events, s.prices, 252)


@_query(BOTH)
def base_rate_regimes(s: Study) -> DataFrame:
    return stats.regime_stats(s.outcomes(5, 60, 252), REGIMES)


@_query(BOTH)
def base_rate_tails(s: Study) -> DataFrame:
    return stats.tail_stats(s.outcomes(252), 252)


@_query(BOTH)
def severity_returns_60d(s: Study) -> DataFrame:
    returns = outcomes.forward_returns(s.events, s.prices, 60).select("event_id", "ret")
    sizes = s.events.select("event_id", "crash_return")
    return buckets.bucket_outcomes(
        returns.join(sizes, "event_id"), {"ret": buckets.severity_buckets(buckets.full_buckets(), "")}
    )


def _histogram(horizon: int, spec: stats.HistogramSpec):
    return lambda s: stats.return_histogram(outcomes.forward_returns(s.events, s.prices, horizon), spec)


_query(BOTH, "return_histogram_one_year")(_histogram(252, stats.ONE_YEAR))
_query(BOTH, "return_histogram_sixty_day")(_histogram(60, stats.SIXTY_DAY))
_query(BOTH, "return_histogram_one_week")(_histogram(5, stats.ONE_WEEK))


# --- dataset and reports


@_query(BOTH)
def event_dataset(s: Study) -> DataFrame:
    return s.dataset


@_query(BOTH)
def dataset_validation(s: Study) -> DataFrame:
    return dataset.dataset_checks(s.dataset)


@_query(BOTH)
def feature_missingness(s: Study) -> DataFrame:
    clean = s.clean_with(s.price, s.recent, s.market_sector, s.fundamental)
    return stats.missing_shares(clean, dataset.FEATURE_COLUMNS)


@_query(BOTH)
def overall_rate(s: Study) -> DataFrame:
    return stats.overall_rate(s.clean_with(s.labels), dataset.PRIMARY_TARGET)


@_query(BOTH)
def recovery_grid(s: Study) -> DataFrame:
    return stats.recovery_grid(s.clean_with(s.labels))


@_query(BOTH)
def grouped_rate_magnitude(s: Study) -> DataFrame:
    return stats.slice_rates(s.clean_with(s.labels), "magnitude", dataset.PRIMARY_TARGET)


@_query(BOTH)
def grouped_rate_prior_count(s: Study) -> DataFrame:
    return stats.slice_rates(s.clean_with(s.labels, s.recent), "prior_count", dataset.PRIMARY_TARGET)


@_query(BOTH)
def grouped_rate_size(s: Study) -> DataFrame:
    return stats.slice_rates(s.clean_with(s.labels, s.fundamental), "size", dataset.PRIMARY_TARGET)


@_query(BOTH)
def grouped_rate_profitability(s: Study) -> DataFrame:
    return stats.slice_rates(s.clean_with(s.labels, s.fundamental), "profitability", dataset.PRIMARY_TARGET)


@_query(BOTH)
def grouped_rate_leverage(s: Study) -> DataFrame:
    return stats.slice_rates(s.clean_with(s.labels, s.fundamental), "leverage", dataset.PRIMARY_TARGET)


@_query(BOTH)
def grouped_rate_market_day(s: Study) -> DataFrame:
    return stats.slice_rates(s.clean_with(s.labels, s.market_sector), "market_day", dataset.PRIMARY_TARGET)


@_query(BOTH)
def grouped_rate_sector(s: Study) -> DataFrame:
    sic = s.master.groupBy("security_id").agg(F.expr(f"{universe.earliest(s.master, 'sic_code')} AS sic"))
    named = s.clean_with(s.labels).join(
        sic.selectExpr("security_id", f"{normalize.sic_division('sic')} AS sector"), "security_id"
    )
    return stats.grouped_rate(named, "sector", dataset.PRIMARY_TARGET)


@_query(BOTH)
def headline_rates(s: Study) -> DataFrame:
    clean = s.clean_with(s.labels, s.recent, s.market_sector, s.fundamental)
    return stats.headline_rates(clean, dataset.PRIMARY_TARGET)


@_query(BOTH)
def quantile_buckets(s: Study) -> DataFrame:
    labelled = stats.quantile_buckets(s.price.select("event_id", "volatility_20d"), "volatility_20d", 5, "vol")
    return stats.value_counts(labelled, "bucket")


def _report(s: Study, named: dict[str, str], since: str | None) -> DataFrame:
    """Buckets on one-year returns and, for the crash sizes, on sixty-day returns too."""
    return buckets.bucket_outcomes(
        s.bucket_table(since, 60, 252), {"ret_252": named, "ret_60": buckets.severity_buckets(named, "_60d")}
    )


@_query(BOTH, panel=BUCKET_PANEL)
def bucket_outcomes_full(s: Study) -> DataFrame:
    return _report(s, buckets.full_buckets(), None)


@_query(BOTH, panel=BUCKET_PANEL)
def bucket_outcomes_recent(s: Study) -> DataFrame:
    return _report(s, buckets.recent_buckets(), RECENT_START)


@_query(BOTH, panel=BUCKET_PANEL)
def bucket_outcomes_5d(s: Study) -> DataFrame:
    return buckets.bucket_outcomes(s.bucket_table(None, 5), {"ret_5": buckets.recent_buckets()})


@_query(BOTH, panel=BUCKET_PANEL)
def bucket_histograms_full(s: Study) -> DataFrame:
    return buckets.bucket_histograms(s.bucket_table(None, 252), buckets.full_buckets(), "ret_252", stats.ONE_YEAR)


@_query(BOTH, panel=BUCKET_PANEL)
def bucket_histograms_recent(s: Study) -> DataFrame:
    table, named = s.bucket_table(RECENT_START, 60, 252), buckets.recent_buckets()
    sizes = buckets.severity_buckets(named, "_60d")
    return buckets.bucket_histograms(table, named, "ret_252", stats.ONE_YEAR).unionByName(
        buckets.bucket_histograms(table, sizes, "ret_60", stats.SIXTY_DAY)
    )


@_query(BOTH, panel=BUCKET_PANEL)
def bucket_histograms_5d(s: Study) -> DataFrame:
    return buckets.bucket_histograms(s.bucket_table(None, 5), buckets.recent_buckets(), "ret_5", stats.ONE_WEEK)
