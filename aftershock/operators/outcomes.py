"""Compounded total return after each clean event, for any number of horizons in one pass.

Delisting losses are expected inside the daily returns here, unlike in the hit labels. A security that
stopped trading before the end of the data is observed at its last row; one that still trades is
censored when fewer than ``horizon`` rows follow the event.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arith import compounded, log_growth
from ..functions.windows import Roll, running, whole
from .events import CLEAN, clean_pool
from .passes import Family, at_events, of_securities, panel_pass

EDGE_DAYS = 17  # a last row this close to the end of the data counts as still trading


def outcome_family(horizons: Sequence[int]) -> Family:
    """Log growth up to each row, to the rows ahead and to the last row of the security."""
    return Family(
        "outcomes",
        ("daily_return",),
        levels=(
            (f"sum({log_growth('coalesce(daily_return, 0D)')}) {running()} AS __grown", f"max(date) {whole()} AS __ends"),
            (f"last(__grown) {whole()} AS __grown_end",),
        ),
        rolls=tuple(Roll.at("__grown", h, f"__grown_{h}", ahead=True) for h in horizons),
        out={"__log": "__grown", "__log_end": "__grown_end", "__last_date": "__ends", **{f"__log_{h}": f"__grown_{h}" for h in horizons}},
    )


def data_edge(panel: DataFrame) -> DataFrame:
    """One row: the last date of the panel, minus the tolerance."""
    return panel.selectExpr(f"date_sub(max(date), {EDGE_DAYS}) AS __edge")


def outcome_columns(horizons: Sequence[int]) -> list[str]:
    """Expressions of ``ret_<h>`` (null where not observed) and ``censored_<h>`` over the family's columns and the edge."""
    out = []
    for h in horizons:
        censored = f"__log_{h} IS NULL AND __last_date >= __edge"
        value = compounded(f"coalesce(__log_{h}, __log_end) - __log")
        # a day of total loss leaves -inf minus -inf, which is no return
        out += [
            f"CASE WHEN NOT ({censored}) AND NOT isnan({value}) THEN {value} END AS ret_{h}",
            f"{censored} AS censored_{h}",
        ]
    return out


def outcomes_of(rows: DataFrame, prices: DataFrame, horizons: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """``keep``, ``ret_<h>`` and ``censored_<h>`` of the clean events that are in the panel.

    ``rows`` are events with the columns of ``outcome_family``. The data end where those securities end that have a
    clean event, which takes two columns of the panel and no move.
    """
    clean = rows.filter(CLEAN)
    edge = data_edge(of_securities(prices.select("security_id", "date"), clean))
    # the edge is a single row
    found = clean.filter("__log IS NOT NULL").crossJoin(F.broadcast(edge))
    return found.selectExpr(*keep, *outcome_columns(horizons))


def outcome_table(events: DataFrame, prices: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Per clean event that is in the panel: ``ret_<h>`` (null where not observed) and ``censored_<h>``."""
    events = clean_pool(events).select("event_id", "security_id", "crash_date")
    panel = of_securities(prices, events)
    family = outcome_family(horizons)
    # the edge is a single row
    found = at_events(events, panel_pass(panel, [family], events), list(family.out), how="inner").crossJoin(
        F.broadcast(data_edge(panel))
    )
    return found.selectExpr("event_id", "security_id", "crash_date", *outcome_columns(horizons))


def forward_returns(events: DataFrame, prices: DataFrame, horizon: int = 252) -> DataFrame:
    """Observed clean events with their return over ``horizon`` rows."""
    table = outcome_table(events, prices, [horizon]).filter(f"ret_{horizon} IS NOT NULL")
    return table.selectExpr("event_id", "security_id", "crash_date", f"ret_{horizon} AS ret")
