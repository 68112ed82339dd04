"""Point-in-time joins: what was known, or valid, on the day of an event.

All of them are equi-joins with a date range as residual condition, so Spark picks the strategy from the sizes it
sees. Interval joins are on key and year, so that a key that holds many events is dealt over as many tasks as it has
years; in the as-of join adaptive execution splits such a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arith import spread_null_key
from ..sources.tables import good_links


def disjoint_spans(
    intervals: DataFrame, *, key: str, start: str, end: str, prefer: str, open_end: bool = False
) -> DataFrame:
    """``intervals`` cut at each other's ends, so that every day of a key has at most one row: the best.

    Columns are prefixed with ``r_``; ``r_from`` and ``r_until`` (first day after it, null = open) bound
    a span. ``prefer`` is the ORDER BY text among competing intervals, over the prefixed columns. The
    work is on the dimension, whose keys hold a handful of intervals each, not on the events.
    """
    usable = f"{key} IS NOT NULL AND {start} IS NOT NULL" + ("" if open_end else f" AND {end} IS NOT NULL")
    r = intervals.filter(usable).selectExpr(*[f"{c} AS r_{c}" for c in intervals.columns])
    cuts = r.selectExpr(f"r_{key} AS k", f"explode(array(r_{start}, date_add(r_{end}, 1))) AS r_from")
    cuts = cuts.filter("r_from IS NOT NULL").distinct()
    cuts = cuts.selectExpr("*", "lead(r_from) OVER (PARTITION BY k ORDER BY r_from) AS r_until")
    covering = cuts.join(
        r, F.expr(f"k = r_{key} AND r_from >= r_{start} AND (r_{end} IS NULL OR r_from <= r_{end})")
    )
    rank = f"row_number() OVER (PARTITION BY k, r_from ORDER BY {prefer}) AS r_rank"
    return covering.selectExpr("*", rank).filter("r_rank = 1").drop("k", "r_rank")


def interval_join(
    left: DataFrame,
    right: DataFrame,
    *,
    key: str,
    at: str,
    start: str,
    end: str,
    prefer: str,
    take: dict[str, str],
    open_end: bool = False,
) -> DataFrame:
    """``left`` with the best ``right`` row whose closed interval contains ``at``.

    Every left row appears once, as spans do not overlap. ``take`` maps right columns to output
    names; they are null where no interval fits. Spans are repeated for each year of ``left`` that they touch.
    """
    spans = disjoint_spans(right, key=key, start=start, end=end, prefer=prefer, open_end=open_end)
    # one row: the years in use, which bound an open span
    years = left.selectExpr(f"year(min({at})) AS r_least", f"year(max({at})) AS r_most")
    first, last = "greatest(year(r_from), r_least)", "least(coalesce(year(date_sub(r_until, 1)), r_most), r_most)"
    spans = spans.crossJoin(F.broadcast(years)).filter(f"{first} <= {last}")
    # the windows left the spans placed by key alone, and the other side would follow them
    spans = spans.selectExpr("*", f"explode(sequence({first}, {last})) AS r_year").repartition(f"r_{key}", "r_year")
    fits = f"{key} = r_{key} AND year({at}) = r_year AND {at} >= r_from AND (r_until IS NULL OR {at} < r_until)"
    return left.join(spans, F.expr(fits), "left").selectExpr(
        *left.columns, *[f"r_{c} AS {name}" for c, name in take.items()]
    )


def asof_join(
    left: DataFrame, right: DataFrame, *, key: str, at: str, known: str, newest: str, take: Sequence[str]
) -> DataFrame:
    """``left`` with the latest ``right`` row of the same ``key`` whose ``known`` date is not after ``at``.

    Each right row holds from its ``known`` date until the next one of its key, which turns the
    search into an interval lookup with at most one match. Rows that became known on the same day
    rank by ``newest``. Left rows without a match, or without a key, keep nulls.
    """
    spans = right.filter(f"{known} IS NOT NULL AND {key} IS NOT NULL").selectExpr(
        f"{key} AS __key",
        f"{known} AS __from",
        f"lead({known}) OVER (PARTITION BY {key} ORDER BY {known}, {newest}) AS __until",
        *[f"{c} AS __r_{c}" for c in take],
    )
    spread = left.selectExpr("*", f"{spread_null_key(key, at)} AS __left_key")
    fits = F.expr(
        f"__left_key = __key AND {key} IS NOT NULL AND {at} >= __from AND (__until IS NULL OR {at} < __until)"
    )
    return spread.join(spans, fits, "left").selectExpr(*left.columns, *[f"__r_{c} AS {c}" for c in take])


def link_companies(events: DataFrame, link: DataFrame) -> DataFrame:
    """Events with the company whose link was valid on the event date, primary links first."""
    links = good_links(link).selectExpr(
        "cast(lpermno AS bigint) AS security_id",
        "cast(gvkey AS bigint) AS company_id",
        "linkprim",
        "cast(linkdt AS date) AS linkdt",
        "cast(linkenddt AS date) AS linkenddt",
    )
    return interval_join(
        events.select("event_id", "security_id", "crash_date", "crash_close"),
        links,
        key="security_id",
        at="crash_date",
        start="linkdt",
        end="linkenddt",
        open_end=True,
        prefer="CASE WHEN r_linkprim = 'P' THEN 0 ELSE 1 END, r_linkdt DESC NULLS LAST, r_company_id",
        take={"company_id": "company_id"},
    )
