"""The frames of ``windows.Roll`` at some rows only, cut from a security's values held as arrays.

A window gives a value for every row and copies every row for it; events are a few rows of a hundred. Here the values
of a security lie in one array per column, in the order of days, and each wanted row cuts its frames out of them. The work
is one array entry per row of the panel and, per event, as many values as its widest frame holds. An array has at most 36,525
entries per century.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import Roll, over, running

_LARGEST = {"max": "array_max", "min": "array_min"}
_MOMENTS = ("sum", "mean", "std", "slope")
DAY, PLACE, STEP = "__day_of", "__place", "__step"

#: Values of a frame that are summed in one row, so that a frame of a year is some forty rows and not 252.
CHUNK = 6


def _value(r: Roll, column: str) -> str:
    """Values of a column for ``r``: with two columns, only where both are present."""
    return column if r.on is None else f"CASE WHEN {r.column} IS NOT NULL AND {r.on} IS NOT NULL THEN {column} END"


def _kept(rolls: Sequence[Roll]) -> dict[str, str]:
    """Arrays by the expression whose values they hold."""
    texts = dict.fromkeys(_value(r, c) for r in rolls for c in (r.column, r.on) if c is not None and r.op != "count")
    return {text: f"__values_{i}" for i, text in enumerate(texts)}


def _counts(rolls: Sequence[Roll]) -> dict[str, str]:
    """Arrays of running counts by what they count: of every column whose values must be present."""
    texts = [r.column for r in rolls if r.op == "count" or r.need != 0]
    return {text: f"__count_{i}" for i, text in enumerate(dict.fromkeys(texts))}


def _steps(r: Roll) -> tuple[int, int]:
    """First and last row of a frame, counted from the wanted row."""
    return (r.skip, r.skip + r.size - 1) if r.ahead else (1 - r.skip - r.size, -r.skip)


def _sums(i: int, r: Roll, values: Sequence[str], least: int, most: int) -> list[Column]:
    """What is summed over the rows of ``CHUNK`` values for roll ``i``; frames of all rolls lie between two steps."""
    low, high = _steps(r)
    all_inside = (low, high) == (least, most) and (most - least + 1) % CHUNK == 0
    x, y = f"{values[0]}_{{j}}", f"{values[-1]}_{{j}}"
    sums = {"n": f"if({x} IS NULL, 0D, 1D)"}
    if r.op in ("sum", "mean"):
        sums["x"] = x
    else:
        x, y = f"({x} - __pivot_{i}_0)", f"({y} - __pivot_{i}_{len(values) - 1})"
        sums |= {"x": x, "xx": f"{x} * {x}"} if r.op == "std" else {"x": x, "y": y, "xy": f"{x} * {y}", "yy": f"{y} * {y}"}
    out = []
    for name, text in sums.items():
        terms = [f"coalesce({text}, 0D)".format(j=j) for j in range(CHUNK)]
        if not all_inside:
            terms = [f"if({STEP} + {j} BETWEEN {low} AND {high}, {t}, 0D)" for j, t in enumerate(terms)]
        out.append(F.expr(f"sum({' + '.join(terms)}) AS __{name}_{i}"))
    return out


def _moments(i: int) -> dict[str, str]:
    """The moments of roll ``i`` from its sums."""

    def about_mean(a: str, b: str) -> str:
        return f"(__{a}{b}_{i} - try_divide(__{a}_{i} * __{b}_{i}, __n_{i}))"

    return {
        "sum": f"__x_{i}",
        "mean": f"try_divide(__x_{i}, __n_{i})",
        "std": f"sqrt(try_divide({about_mean('x', 'x')}, __n_{i} - 1D))",
        "slope": f"try_divide({about_mean('x', 'y')}, {about_mean('y', 'y')})",
    }


def frames_at(panel: DataFrame, rolls: Sequence[Roll], wanted: str, keep: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``panel`` where ``wanted`` holds, with all columns or those to ``keep``, plus one column per roll.

    The panel is placed by security and has unique days. Moments are sums of deviations from the largest value of their own
    frame. The squared range of a frame is at most twice its squared deviations from the mean, so neither a large level nor a
    drift of the values uses up their digits. The values of a frame are laid out as rows of ``CHUNK`` values and summed by an
    aggregate, which is compiled; functions of each value of an array never are.
    """
    kept, counts = _kept(rolls), _counts(rolls)
    columns = list(dict.fromkeys(["security_id", "date", *(panel.columns if keep is None else keep)]))
    numbered = panel.selectExpr(
        "*",
        f"row_number() {over()} - 1 AS {PLACE}",
        *[f"count({text}) {running()} AS {name}" for text, name in counts.items()],
    )
    day = f"struct(date AS {DAY}, {', '.join(f'{text} AS {name}' for text, name in (kept | {n: n for n in counts.values()}).items())})"
    own = ", ".join(c for c in [*columns, PLACE] if c != "security_id")
    held = numbered.groupBy("security_id").agg(
        F.expr(f"sort_array(collect_list({day})) AS __path"),
        F.expr(f"collect_list(CASE WHEN {wanted} THEN struct({own}) END) AS __wanted"),
    )
    arrays = [*kept.values(), *counts.values()]
    held = held.selectExpr("security_id", "__wanted", *[f"__path.{a} AS {a}" for a in arrays])
    rows = held.selectExpr("security_id", *arrays, "inline(__wanted)")

    def cut(r: Roll, text: str) -> str:
        if r.ahead:
            return f"slice({kept[text]}, {PLACE} + {r.skip + 1}, {r.size})"
        end, first = f"({PLACE} - {r.skip - 1})", f"greatest({PLACE} - {r.skip + r.size - 2}, 1)"
        return f"slice({kept[text]}, {first}, greatest({end} - {first} + 1, 0))"

    def present(r: Roll, text: str) -> str:
        """Values in the frame, which ends with the timeline at the latest."""
        at = f"get({counts[text]}, {{}})"
        if r.ahead:
            before, last = f"{PLACE} + {r.skip - 1}", f"least({PLACE} + {r.skip + r.size - 1}, size({counts[text]}) - 1)"
            return f"greatest(coalesce({at.format(last)}, 0) - coalesce({at.format(before)}, CASE WHEN {before} < 0 THEN 0 ELSE {at.format(last)} END, 0), 0)"
        return f"(coalesce({at.format(f'{PLACE} - {r.skip}')}, 0) - coalesce({at.format(f'{PLACE} - {r.skip + r.size}')}, 0))"

    # what one look or one cut gives; then the moments of the frames, whose values are laid out as rows
    moments = [r for r in rolls if r.op in _MOMENTS]
    span = [step for r in moments for step in _steps(r)]
    first, pivots, found, second = {}, {}, [], []
    for i, r in enumerate(rolls):
        if r.op == "count" or r.need != 0:
            first[f"__present_{i}"] = present(r, r.column)
        if r.op in _LARGEST:
            one = f"get({kept[r.column]}, {PLACE} {'+' if r.ahead else '-'} {r.skip})"
            first[f"__found_{i}"] = one if r.size == 1 else f"{_LARGEST[r.op]}({cut(r, r.column)})"
        elif r.op in _MOMENTS:
            texts = [_value(r, c) for c in (r.column, r.on) if c is not None]
            if r.op in ("std", "slope"):
                pivots |= {f"__pivot_{i}_{k}": f"array_max({cut(r, text)})" for k, text in enumerate(texts)}
            found += _sums(i, r, [kept[text] for text in texts], min(span), max(span))
        value = {"count": f"__present_{i}", **_moments(i)}.get(r.op, f"__found_{i}")
        if r.op != "count" and r.need != 0:
            value = f"CASE WHEN __present_{i} >= {r.size if r.need is None else r.need} THEN {value} END"
        second.append(f"{value} AS {r.name}")
    # before the values are laid out, as it is made once for each wanted row
    rows = rows.selectExpr(*columns, PLACE, *arrays, *[f"{e} AS {name}" for name, e in (first | pivots).items()])
    if found:
        # days beyond the timeline are rows too, without values, so that no wanted row is lost
        held = dict.fromkeys(kept[_value(r, c)] for r in moments for c in (r.column, r.on) if c is not None)
        laid = f"explode(sequence({min(span)}, {max(span)}, {CHUNK})) AS {STEP}"
        rows = rows.selectExpr(*columns, *first, *pivots, PLACE, *held, laid)
        values = [f"get({v}, {PLACE} + {STEP} + {j}) AS {v}_{j}" for v in held for j in range(CHUNK)]
        rows = rows.selectExpr(*columns, *first, *pivots, STEP, *values)
        rows = rows.groupBy(*columns, *first).agg(*found)
    return rows.selectExpr(*columns, *second)
