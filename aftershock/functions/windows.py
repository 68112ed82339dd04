"""Row-count windows over a security's own timeline, as SQL expression text.

Spark re-evaluates a moving frame from scratch for every row, so ``max(x) over 252 rows`` costs 252
updates per row. ``rolling`` reaches the same numbers in a logarithmic number of steps: from the
aggregate over k rows, three ``lag`` give the aggregate over 4k rows. All steps share one window
specification, hence one exchange and one sort. Counts come from one running count. Deviations and
slopes are put together from blocks of (number, means, moments about the means), merged pairwise, so
that neither a large level nor a drift of the values uses up their digits.

A window partition holds one security. Its size has a fixed bound: (security_id, date) is unique, so
a century of days is at most 36,525 rows, whatever share of all securities or events it belongs to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

BY_SECURITY = "PARTITION BY security_id ORDER BY date"

#: How much wider each step makes a block. A step is a window of its own, which copies every row; a wider step has more
#: ``lag`` in it instead.
STEP = 4

_COMBINE = {"max": "greatest", "min": "least"}


def over(spec: str = BY_SECURITY) -> str:
    """The plain window."""
    return f"OVER ({spec})"


def running(spec: str = BY_SECURITY) -> str:
    """From the first row up to the current one."""
    return f"OVER ({spec} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def before(spec: str = BY_SECURITY) -> str:
    """From the first row up to the one before the current one."""
    return f"OVER ({spec} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def whole(spec: str = BY_SECURITY) -> str:
    """The whole partition."""
    return f"OVER ({spec} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@dataclass(frozen=True)
class Roll:
    """``name`` = ``op`` of ``column`` over ``size`` rows.

    ``op`` is max, min, sum, count, mean, std (sample) or slope (of ``column`` on ``on``, from the rows
    that have both). The frame ends at the current row, or ``skip`` rows before it; with ``ahead`` it
    starts at the current row, or ``skip`` rows after it. The result is null unless at least ``need``
    values of ``column`` are present (default: all of them; 0 = any).
    """

    op: str
    column: str
    size: int
    name: str
    skip: int = 0
    ahead: bool = False
    need: int | None = None
    on: str | None = None

    @classmethod
    def at(cls, column: str, rows: int, name: str, ahead: bool = False) -> Roll:
        """The value ``rows`` before, or ``ahead`` of, the current row, null beyond the timeline."""
        return cls("max", column, 1, name, skip=rows, ahead=ahead, need=0)

    @property
    def part(self) -> str | None:
        """What has to be aggregated for it."""
        return {"mean": "sum", "std": "moments", "slope": "comoments", "count": None}.get(self.op, self.op)

    @property
    def values(self) -> str:
        """The column it is made of, or both."""
        return self.column if self.on is None else f"{self.column}__{self.on}"


class _Steps:
    """Expression text of the doubling steps under one window."""

    def __init__(self, spec: str):
        self.spec = spec

    def shift(self, c: str, rows: int, ahead: bool, missing: str = "NULL") -> str:
        return c if rows == 0 else f"{'lead' if ahead else 'lag'}({c}, {rows}, {missing}) {over(self.spec)}"

    @staticmethod
    def key(part: str, column: str, ahead: bool, width: int) -> str:
        return f"__{part}_{column.strip('_')}_{'f' if ahead else 'b'}{width}"

    def span(self, part: str, r: Roll) -> str:
        """One part over the frame of ``r``, put together from blocks whose width is a power of ``STEP``."""
        blocks = [self.shift(block, rows, r.ahead) for block, rows in self.blocks(part, r)]
        if part in _COMBINE:
            return blocks[0] if len(blocks) == 1 else f"{_COMBINE[part]}({', '.join(blocks)})"
        return "(0D" + "".join(f" + coalesce({b}, 0D)" for b in blocks) + ")"

    def blocks(self, part: str, r: Roll) -> list[tuple[str, int]]:
        """Blocks that together are the frame of ``r``, and how far away each is; maxima and minima may overlap."""
        top = _top(r.size)
        if part in _COMBINE:
            starts = [min(at, r.size - top) for at in range(0, r.size, top)]
            return [(self.key(part, r.values, r.ahead, top), r.skip + at) for at in starts]
        found, at, left = [], r.skip, r.size
        while left:
            top = _top(left)
            found.append((self.key(part, r.values, r.ahead, top), at))
            at, left = at + top, left - top
        return found

    def present(self, r: Roll) -> str:
        """How many values the frame of ``r`` holds; a frame ends with the timeline at the latest."""
        n, everything = _count(r.column), _total(r.column)
        if not r.ahead:
            return (
                f"(coalesce({self.shift(n, r.skip, False)}, 0) - coalesce({self.shift(n, r.skip + r.size, False)}, 0))"
            )
        end = f"coalesce({self.shift(n, r.skip + r.size - 1, True)}, {everything})"
        if r.skip:
            return f"({end} - coalesce({self.shift(n, r.skip - 1, True)}, {everything}))"
        return f"({end} - coalesce({self.shift(n, 1, False)}, 0))"

    def result(self, r: Roll) -> str:
        if r.op == "count":
            return self.present(r)
        if r.op == "mean":
            n = f"{r.size}D" if r.need is None else f"double({self.present(r)})"
            value = f"try_divide({self.span('sum', r)}, {n})"
        elif r.op == "std":
            value = f"sqrt(try_divide({_merged(r)}_m2, {_merged(r)}_n - 1D))"
        elif r.op == "slope":
            value = f"try_divide({_merged(r)}_c, {_merged(r)}_m2)"
        else:
            value = self.span(r.op, r)
        if r.need == 0:
            return value
        return f"CASE WHEN {self.present(r)} >= {r.size if r.need is None else r.need} THEN {value} END"


def _top(size: int) -> int:
    """The largest power of ``STEP`` that fits."""
    top = 1
    while top * STEP <= size:
        top *= STEP
    return top


def _count(column: str) -> str:
    return f"__count_{column.strip('_')}"


def _merged(r: Roll) -> str:
    return f"__merged_{r.name.strip('_')}"


def _total(column: str) -> str:
    return f"__total_{column.strip('_')}"


# Blocks of moments have a column for each of: number, mean and summed squared deviations (of the second column, for two of
# them), and for two columns also the mean of the first and the summed products of both deviations. No rows are a
# block of zeros.
_BLOCK = {
    "moments": {"n": "CASE WHEN {0} IS NULL THEN 0D ELSE 1D END", "mean": "coalesce(double({0}), 0D)", "m2": "0D"},
    "comoments": {
        "n": "CASE WHEN {0} IS NULL OR {1} IS NULL THEN 0D ELSE 1D END",
        "mean": "coalesce(double({1}), 0D)",
        "m2": "0D",
        "own": "coalesce(double({0}), 0D)",
        "c": "0D",
    },
}


def _merge(a: str, b: str) -> dict[str, str]:
    """Two blocks as one: field by field, of the blocks whose columns start with ``a`` and ``b``."""
    n = f"({a}_n + {b}_n)"
    share = f"{b}_n / greatest({n}, 1D)"
    apart, own = f"({b}_mean - {a}_mean)", f"({b}_own - {a}_own)"
    return {
        "n": n,
        "mean": f"{a}_mean + {apart} * ({share})",
        "m2": f"{a}_m2 + {b}_m2 + {apart} * {apart} * ({a}_n * ({share}))",
        "own": f"{a}_own + {own} * ({share})",
        "c": f"{a}_c + {b}_c + {own} * {apart} * ({a}_n * ({share}))",
    }


def rolling(df: DataFrame, rolls: list[Roll], spec: str = BY_SECURITY) -> DataFrame:
    """``df`` plus one column per roll."""
    steps = _Steps(spec)
    tops: dict[tuple[str, str, bool], int] = {}
    columns: dict[str, tuple[str, ...]] = {}
    for r in rolls:
        if r.part is not None:
            k = (r.part, r.values, r.ahead)
            tops[k] = max(tops.get(k, 0), _top(r.size))
            columns[r.values] = (r.column,) if r.on is None else (r.column, r.on)

    base = {"sum": "coalesce({0}, 0D)"}
    first = []
    for part, c, ahead in tops:
        name = steps.key(part, c, ahead, 1)
        for field, text in _BLOCK[part].items() if part in _BLOCK else [(None, base.get(part, "{0}"))]:
            first.append(f"{text.format(*columns[c])} AS {name}{f'_{field}' if field else ''}")
    for column in sorted({r.column for r in rolls if r.op == "count" or r.need != 0}):
        first.append(f"count({column}) {running(spec)} AS {_count(column)}")
        if any(r.ahead and r.column == column for r in rolls):
            first.append(f"count({column}) {whole(spec)} AS {_total(column)}")
    out = df.selectExpr("*", *first)

    width = 1
    while any(top > width for top in tops.values()):
        grown, shifted, merges = [], [], []
        for (part, column, ahead), top in tops.items():
            if top > width:
                c, wider = (steps.key(part, column, ahead, w) for w in (width, STEP * width))
                if part in _BLOCK:  # a block is named many times in a merge, its shift only once
                    for i in range(1, STEP):
                        for field in _BLOCK[part]:
                            shifted.append(f"{steps.shift(f'{c}_{field}', i * width, ahead, '0D')} AS {c}_{i}_{field}")
                    merges.append((part, c, wider))
                else:
                    others = [steps.shift(c, i * width, ahead) for i in range(1, STEP)]
                    if part in _COMBINE:
                        grown.append(f"{_COMBINE[part]}({', '.join([c, *others])}) AS {wider}")
                    else:
                        grown.append(f"{' + '.join([c, *(f'coalesce({o}, 0D)' for o in others)])} AS {wider}")
        out = out.selectExpr("*", *grown, *shifted)
        for i in range(1, STEP):
            merged = {
                f"{wider}_{f}": _merge(c if i == 1 else wider, f"{c}_{i}")[f] for part, c, wider in merges for f in _BLOCK[part]
            }
            if merged:
                out = out.selectExpr(*[x for x in out.columns if x not in merged], *[f"{e} AS {x}" for x, e in merged.items()])
        width *= STEP

    # frames of moments from their adjacent blocks, one merge for each further block
    frames = {r: steps.blocks(r.part, r) for r in rolls if r.part in _BLOCK}
    near = [
        f"{steps.shift(f'{block}_{field}', rows, r.ahead, '0D')} AS {_merged(r)}{f'_{i}' if i else ''}_{field}"
        for r, blocks in frames.items()
        for i, (block, rows) in enumerate(blocks)
        for field in _BLOCK[r.part]
    ]
    out = out.selectExpr("*", *near) if near else out
    for i in range(1, max((len(blocks) for blocks in frames.values()), default=1)):
        more = [r for r, blocks in frames.items() if len(blocks) > i]
        merged = {f"{_merged(r)}_{f}": _merge(_merged(r), f"{_merged(r)}_{i}")[f] for r in more for f in _BLOCK[r.part]}
        out = out.selectExpr(*[c for c in out.columns if c not in merged], *[f"{e} AS {c}" for c, e in merged.items()])
    return out.selectExpr(*df.columns, *[f"{steps.result(r)} AS {r.name}" for r in rolls])
