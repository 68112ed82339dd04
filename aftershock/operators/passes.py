"""One pass over the panel for any number of feature and label families.

A family declares what it reads, what it joins to the panel, and its expressions level by level; all its windows are by
security and date. Families that are wanted together are put side by side: the panel is cut to the securities that have
events, moved once, sorted once, and every window of every family runs over that order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arith import named
from ..functions.frames import frames_at
from ..functions.windows import Roll, rolling
from ..session import broadcast_small

#: Securities in one broadcast; beyond that the panel is cut after it is moved.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Family:
    """Columns that one pass over the panel gives.

    ``rolls`` are over columns that are read or joined. ``levels`` hold expressions, each of which may use the levels before
    it; all windows of a level are one operator. ``out`` names the result: expressions without windows, as they are made
    for wanted rows only. Names of helper columns start with two underscores and belong to one family.
    ``joined`` adds columns to the placed panel and keeps its rows, their place and, unless ``sorts``, their order.
    """

    name: str
    reads: tuple[str, ...]
    out: dict[str, str]
    levels: tuple[tuple[str, ...], ...] = ()
    rolls: tuple[Roll, ...] = ()
    joined: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)

    def only(self, columns: Sequence[str]) -> Family:
        """The family with some of its results, which reads nothing that only the others need."""
        out = {c: e for c, e in self.out.items() if c in columns}
        named_ = _words([*out.values(), *[e for level in self.levels for e in level]])
        rolls = tuple(r for r in self.rolls if r.name in named_)
        used = named_ | {c for r in rolls for c in (r.column, r.on)}
        return replace(self, out=out, rolls=rolls, reads=tuple(c for c in self.reads if c in used or self.joined is not None))


def _words(texts: Iterable[str]) -> set[str]:
    """Every name in expression texts."""
    return set(re.findall(r"\w+", " ".join(texts)))


def of_securities(prices: DataFrame, events: DataFrame) -> DataFrame:
    """The panel of those securities that have events, cut before it is moved.

    Their ids are counted first; up to ``BROADCAST_ROWS`` they are sent to the tasks that read the panel, beyond that the
    cut is made where the panel is placed by security anyway.
    """
    ids = broadcast_small(events.select("security_id").distinct(), "securities", BROADCAST_ROWS, "shuffle_hash")
    return prices.join(ids, "security_id", "left_semi")


def panel_pass(prices: DataFrame, families: Sequence[Family], at: DataFrame | None = None) -> DataFrame:
    """security_id, date and the columns of all families for every row of ``prices``, or only for the days of events."""
    reads = dict.fromkeys(c for f in families for c in f.reads)
    # placed by security before any join, which all later windows keep, whichever columns are asked for
    panel = prices.select("security_id", "date", *reads).repartition("security_id")
    for f in families:
        if f.joined is not None:
            panel = f.joined(panel)
    for level in range(max((len(f.levels) for f in families), default=0)):
        panel = panel.selectExpr("*", *[e for f in families if len(f.levels) > level for e in f.levels[level]])
    # only what the results name is held for the wanted rows, so that the rest is never made
    words = _words(e for f in families for e in f.out.values())
    rolls = [r for r in {r.name: r for f in families for r in f.rolls}.values() if r.name in words]
    if at is not None:
        days = at.selectExpr("security_id AS __sid", "crash_date AS __date", "true AS __wanted").repartition("__sid")
        days = days.dropDuplicates(["__sid", "__date"]).hint("merge")
        panel = panel.join(days, F.expr("security_id = __sid AND date = __date"), "left").drop("__sid", "__date")
        used = [c for c in panel.columns if c in words or any(c in (r.column, r.on) for r in rolls)]
        panel = panel.select(*dict.fromkeys(["security_id", "date", "__wanted", *used]))
        named_ = [c for c in panel.columns if c in words]
        panel = frames_at(panel, rolls, "__wanted", named_) if rolls else panel.filter("__wanted")
    elif rolls:
        panel = rolling(panel, rolls)
    return panel.selectExpr("security_id", "date", *[e for f in families for e in named(f.out)])


def at_events(events: DataFrame, panel: DataFrame, columns: Sequence[str], how: str = "left") -> DataFrame:
    """Panel columns on the event's own security and date.

    The panel comes placed and sorted by security from its windows. Placing the events alike lets a
    merge join leave the panel where it is; the hint keeps a size estimate from broadcasting it.
    """
    days = panel.selectExpr("security_id AS __sid", "date AS __date", *columns).hint("merge")
    placed = events.repartition("security_id")
    return placed.join(days, F.expr("security_id = __sid AND crash_date = __date"), how).drop("__sid", "__date")


def pass_at_events(events: DataFrame, prices: DataFrame, families: Sequence[Family]) -> DataFrame:
    """``events`` with the columns that the families have on the event's day, in place of columns of that name.

    No event is lost.
    """
    columns = [c for f in families for c in f.out]
    events = events.drop(*columns)
    return at_events(events, panel_pass(of_securities(prices, events), families, events), columns)
