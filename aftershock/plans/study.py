"""The stages of a study in their order, each defined once and evaluated only when used."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import dataset, events, features, fundamentals, labels, outcomes, passes
from ..session import configure, staged
from ..sources import tables
from ..sources.normalize import normalize_prices, normalize_unrestated
from . import demo
from .params import HORIZONS, MIN_PRICE


class Study:
    """Example study over the tables in ``folder``.

    Tables named in ``stage`` are written once to the shared folder and read back, as in a stored
    study. That pays when a query reads a table more than once: the panel for events and features,
    the events for several feature families. ``panel`` names the columns of the panel that a query reads,
    if not all of them, so that the others are neither made nor written.
    """

    def __init__(self, spark: SparkSession, folder: str, stage: tuple[str, ...] = (), panel: tuple[str, ...] | None = None):
        self.spark, self.folder, self.stage, self.panel = configure(spark), folder, stage, panel

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return staged(df, name) if name in self.stage else df

    @cached_property
    def bars(self) -> DataFrame:
        return demo.raw_bars(self.spark, self.folder)

    @cached_property
    def names(self) -> DataFrame:
        return demo.raw_names(self.spark, self.folder)

    @cached_property
    def delistings(self) -> DataFrame:
        return demo.raw_delistings(self.spark, self.folder)

    @cached_property
    def quarters(self) -> DataFrame:
        return demo.raw_quarters(self.spark, self.folder)

    @cached_property
    def years(self) -> DataFrame:
        return demo.raw_years(self.spark, self.folder)

    @cached_property
    def link(self) -> DataFrame:
        return demo.link(self.spark, self.folder)

    @cached_property
    def prices(self) -> DataFrame:
        prices = normalize_prices(self.bars)
        return self._kept(prices if self.panel is None else prices.select(*self.panel), "daily_prices")

    @cached_property
    def master(self) -> DataFrame:
        return tables.security_master(self.names, self.delistings, universe=tables.US_COMMON_STOCK)

    @cached_property
    def fundamentals(self) -> DataFrame:
        return normalize_unrestated(self.quarters)

    @cached_property
    def events(self) -> DataFrame:
        return self._kept(
            events.build_crash_events(self.prices, self.master, min_price=MIN_PRICE), "crash_events"
        )

    @cached_property
    def labels(self) -> DataFrame:
        return labels.build_labels(self.events, self.prices, self.master)

    @cached_property
    def price(self) -> DataFrame:
        return features.build_price_features(self.events, self.prices)

    @cached_property
    def recent(self) -> DataFrame:
        return features.build_recent_crash_features(self.events, self.prices)

    @cached_property
    def market_sector(self) -> DataFrame:
        return features.build_market_sector_features(self.events, self.prices, self.master)

    @cached_property
    def fundamental(self) -> DataFrame:
        return fundamentals.build_fundamental_features(self.events, self.fundamentals, self.link)

    def rows(self, *families: str, pool: DataFrame | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """Events, or those of a pool, with the columns of some families, all or some, from one pass over the panel."""
        made = {
            "price": features.price_family,
            "recent": lambda: features.recent_family(self.events),
            "labels": lambda: labels.label_family(self.master),
            "beta": lambda: features.beta_family(self.prices),
            "outcomes": lambda: outcomes.outcome_family(HORIZONS),
        }
        events_ = self.events if pool is None else pool
        found = [made[f]() for f in families]
        if columns is not None:
            found = [f.only(columns) for f in found]
        return passes.pass_at_events(events_, self.prices, found)

    @cached_property
    def dataset(self) -> DataFrame:
        kept = [*features.PRICE_FEATURES, *features.RECENT_FEATURES]
        wide = labels.labels_of(self.rows("price", "recent", "labels"), self.master, keep=kept)
        return dataset.assemble_events(self.events, wide, wide, wide, self.market_sector, self.fundamental)

    def clean_with(self, *families: DataFrame) -> DataFrame:
        """Clean events with only the families a report needs; columns they share are taken once."""
        out = events.clean_pool(self.events)
        for family in families:
            new = [c for c in family.columns if c not in out.columns]
            out = out.join(family.select("event_id", *new), "event_id", "left")
        return out

    def outcomes(self, *horizons: int) -> DataFrame:
        return outcomes.outcome_table(self.events, self.prices, horizons)

    def bucket_table(self, since: str | None, *horizons: int) -> DataFrame:
        """Returns of the clean events with the features that buckets are made of, written once.

        Crash history, earlier return, beta and outcomes come from one pass over the panel.
        """
        pool = events.clean_pool(self.events)
        kept = ["event_id", "crash_date", "crash_return", "prior_crash_count_20d", "return_252d_pre", "beta"]
        columns = [*kept[3:], "__log", "__log_end", "__last_date", *[f"__log_{h}" for h in horizons]]
        rows = self.rows("price", "recent", "beta", "outcomes", pool=pool, columns=columns)
        out = outcomes.outcomes_of(rows, self.prices, horizons, kept)
        if since is not None:
            out = out.filter(f"crash_date >= DATE '{since}'")
        for family in (
            fundamentals.build_fundamental_features(pool, self.fundamentals, self.link, fundamentals.EBITDA_MARGIN).select(
                "event_id", "market_cap", "pe", "revenue_growth_yoy", "ebitda_margin"
            ),
            features.build_market_sector_features(pool, self.prices, self.master).select(
                "event_id", "market_return_20d", "sector_return_1d"
            ),
        ):
            out = out.join(family, "event_id", "left")
        return staged(out.selectExpr("*", "crash_return - sector_return_1d AS rel_sector"), "buckets")
