"""What happened after each event, with censoring kept apart from delisting.

An active security whose window runs past the end of the data is censored. A delisted one has a
known outcome: its path goes on for one more row, worth the last close times (1 + delisting return).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arith import change, number
from ..functions.windows import Roll, over, running, whole
from .events import CLEAN
from .passes import Family, pass_at_events
from .universe import earliest

HORIZONS = (5, 20, 60)
THRESHOLDS = ((5, 0.05), (10, 0.10), (20, 0.20))  # (percent in the column name, fraction)


def hit_column(percent: int, horizon: int, intraday: bool = False) -> str:
    return f"hit_{percent}pct_{horizon}d" + ("_hi" if intraday else "")


def outcome_columns(horizon: int) -> tuple[str, str, str]:
    return f"return_{horizon}d", f"max_rebound_{horizon}d", f"max_drawdown_{horizon}d"


def delisting_flags(master: DataFrame) -> DataFrame:
    """One row per security: delisted or not, its delisting return, and whether that is missing."""
    per_security = master.groupBy("security_id").agg(
        F.expr("max(delisting_date) IS NOT NULL AS is_delisted"),
        F.expr(f"{earliest(master, 'delisting_return')} AS delisting_return"),
    )
    return per_security.selectExpr("*", "is_delisted AND delisting_return IS NULL AS delisting_return_missing")


def with_terminal_rows(prices: DataFrame, master: DataFrame) -> DataFrame:
    """The panel (security_id, date, close, high, is_terminal) with a final row for delisted securities.

    The final row follows the last valid close by one calendar day and sorts behind a real row of
    that date. It is made in place by splitting the row of the last valid close, so the panel is
    read and moved once. For paths as such; ``build_labels`` has the final row as a value instead.
    """
    gone = delisting_flags(master).filter("is_delisted").selectExpr(
        "security_id AS __sid", "1D + coalesce(delisting_return, 0D) AS __kept"
    )
    panel = prices.select("security_id", "date", "close", "high").join(gone, F.expr("security_id = __sid"), "left")
    panel = panel.selectExpr("*", f"max(CASE WHEN close IS NOT NULL THEN date END) {whole()} AS __last")
    own = "struct(date, close, high, false AS is_terminal)"
    final = "struct(date_add(date, 1) AS date, close * __kept AS close, close * __kept AS high, true AS is_terminal)"
    ends_here = "__kept IS NOT NULL AND close IS NOT NULL AND date = __last"
    return panel.selectExpr(
        "security_id", f"inline(CASE WHEN {ends_here} THEN array({own}, {final}) ELSE array({own}) END)"
    )


def label_family(master: DataFrame, horizons: Sequence[int] = HORIZONS) -> Family:
    """What follows each panel row, up to each horizon.

    A delisted security's path goes on for one more row, one calendar day after the last valid close and behind a
    real row of that date. The row is not made: its place is a number, the count of rows up to that day, and where it
    lies within a horizon its value is merged into the aggregates of the real rows. It then takes the place of the
    horizon's last row, which lies behind it and has no close; only its high must be left out.
    """
    kept = delisting_flags(master).filter("is_delisted").selectExpr(
        "security_id AS __gone_id", "1D + coalesce(delisting_return, 0D) AS __kept"
    )

    def with_kept(panel: DataFrame) -> DataFrame:
        # built from the delisted securities of one task; the panel keeps its place and order
        return panel.join(kept.hint("shuffle_hash"), F.expr("security_id = __gone_id"), "left").drop("__gone_id")

    rolls = []
    for h in horizons:
        rolls += [
            Roll("max", "close", h, f"__max_close_{h}", skip=1, ahead=True, need=0),
            Roll("min", "close", h, f"__min_close_{h}", skip=1, ahead=True, need=0),
            Roll("max", "high", h, f"__max_high_{h}", skip=1, ahead=True, need=0),
        ]
        if h > 1:
            rolls.append(Roll("max", "high", h - 1, f"__max_high_before_{h}", skip=1, ahead=True, need=0))
    # rows from here to the final one, if there is one ahead
    to_final = "CASE WHEN __kept IS NOT NULL AND __to_day >= __row THEN __to_day - __row + 1 END"
    out = {}
    for h in horizons:
        rolls += [Roll.at(c, h, f"{c}_{h}", ahead=True) for c in ("__valid", "__filled")]
        ends_in, n_ahead = f"coalesce(__to_final <= {h}, false)", f"(coalesce(__valid_{h}, __all_valid) - __valid)"
        final = f"CASE WHEN {ends_in} THEN __final * __kept END"
        high = f"CASE WHEN {ends_in} THEN {f'__max_high_before_{h}' if h > 1 else 'NULL'} ELSE __max_high_{h} END"
        out |= {
            f"__best_close_{h}": f"greatest(__max_close_{h}, {final})",
            f"__worst_close_{h}": f"least(__min_close_{h}, {final})",
            f"__best_high_{h}": f"greatest({high}, {final})",
            f"__full_{h}": f"__valid_{h} IS NOT NULL",
            f"__n_{h}": f"{n_ahead} + cast({ends_in} AS bigint)",
            f"__end_{h}": f"CASE WHEN {ends_in} THEN __final * __kept WHEN {n_ahead} > 0 THEN coalesce(__filled_{h}, __final) END",
        }
    return Family(
        "labels",
        ("close", "high"),
        joined=with_kept,
        levels=(
            (
                f"row_number() {over()} AS __row",
                f"count(close) {running()} AS __valid",
                f"count(close) {whole()} AS __all_valid",
                f"last(close, true) {running()} AS __filled",
                f"last(close, true) {whole()} AS __final",
                f"max(CASE WHEN close IS NOT NULL THEN date END) {whole()} AS __last_close",
            ),
            (f"sum(CASE WHEN date <= date_add(__last_close, 1) THEN 1 END) {whole()} AS __to_day",),
            (f"{to_final} AS __to_final",),
        ),
        rolls=tuple(rolls),
        out=out,
    )


def labels_of(
    rows: DataFrame,
    master: DataFrame,
    *,
    horizons: Sequence[int] = HORIZONS,
    thresholds: Sequence[tuple[int, float]] = THRESHOLDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Labels of events that carry the columns of ``label_family``, and the columns ``keep``."""
    flags = delisting_flags(master).select("security_id", "is_delisted", "delisting_return_missing")
    spine = rows.join(flags, "security_id", "left").selectExpr("*", "coalesce(is_delisted, false) AS __gone")
    out = ["event_id", "security_id", "crash_date", "crash_close"]
    out += [c for c in keep if c not in out]
    out += ["crash_close IS NULL AS no_close_data", "delisting_return_missing"]
    for h in horizons:
        full = f"coalesce(__full_{h}, false)"
        known = f"crash_close IS NOT NULL AND (__gone OR {full})"
        out += [
            f"coalesce(__n_{h}, 0) AS n_forward_{h}d",
            f"crash_close IS NOT NULL AND NOT __gone AND NOT {full} AS censored_{h}d",
        ]
        for name, m in zip(outcome_columns(h), ("end", "best_close", "worst_close")):
            out.append(f"CASE WHEN {known} THEN {change(f'__{m}_{h}', 'crash_close')} END AS {name}")
        for percent, fraction in thresholds:
            target = f"crash_close * {number(1.0 + fraction)}"
            for best, intraday in (("best_close", False), ("best_high", True)):
                hit = f"cast(__{best}_{h} >= {target} AS tinyint)"
                out.append(f"CASE WHEN {known} THEN {hit} END AS {hit_column(percent, h, intraday)}")
    return spine.selectExpr(*out)


def build_labels(
    events: DataFrame,
    prices: DataFrame,
    master: DataFrame,
    *,
    horizons: Sequence[int] = HORIZONS,
    thresholds: Sequence[tuple[int, float]] = THRESHOLDS,
) -> DataFrame:
    """Hit grid (close-based and intraday), forward returns and censoring flags per event."""
    spine = events.select("event_id", "security_id", "crash_date", "crash_close")
    rows = pass_at_events(spine, prices, [label_family(master, horizons)])
    return labels_of(rows, master, horizons=horizons, thresholds=thresholds)


def label_summary(labels: DataFrame, events: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """One row: size of the pools, censored events per horizon and the primary base rate, all and clean."""
    flags = events.selectExpr("event_id", f"coalesce({CLEAN}, false) AS __clean")
    hit = "CASE WHEN NOT censored_20d THEN hit_10pct_20d END"
    return labels.join(flags, "event_id", "left").selectExpr(
        "count(*) AS events",
        "count_if(__clean) AS clean_events",
        *[f"count_if(censored_{h}d) AS censored_{h}d" for h in horizons],
        f"count({hit}) AS determined",
        f"avg({hit}) AS base_rate",
        f"count(CASE WHEN __clean THEN {hit} END) AS clean_determined",
        f"avg(CASE WHEN __clean THEN {hit} END) AS clean_base_rate",
    )
