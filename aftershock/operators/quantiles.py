"""Exact order statistics without bringing a group together.

``percentile`` keeps every distinct value of a group in the memory of one task. Here values are first counted (partial
aggregation, placed by key and value), and the counts are summed into coarse ordered bins. Bins that hold a wanted rank are
opened: one with many different values is cut again between its own limits, until it holds few enough to be ranked. Only
counts of bins move for that; the values stay where they were written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

# A coarse bin number that never decreases with the value: fine near zero, logarithmic far out.
_BIN = "coalesce(floor(signum(v) * log1p(abs(v) * 1000D) * 200D), 0)"
_UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

#: Different values that are ranked together, at most, and parts into which a bin with more of them is cut.
MOST_VALUES = 50_000
PARTS = 4_096
#: Rows in one broadcast; beyond that the join is left to Spark.
BROADCAST_ROWS = 100_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _inside(counts: DataFrame, bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counted values that lie in one of the bins, which do not overlap, with the bin's columns."""
    named = bins.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [*[f"{k} = __{k}" for k in keys], "v BETWEEN lo AND hi"]
    return counts.join(_few(named), F.expr(" AND ".join(same))).drop(*[f"__{k}" for k in keys])


def opened_bins(counts: DataFrame, keys: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """Bins with few different values that hold the ``wanted`` ranks, expressions over ``n``.

    ``counts`` has the keys, ``v`` and ``c``. Per bin: its limits ``lo`` and ``hi``, how many values lie below it (``low``),
    and of its key ``n``, ``total`` and ``n_positive``.
    """
    keys = list(keys)
    about = ["n", "total", "n_positive"]
    group = f"PARTITION BY {', '.join(keys)}" if keys else ""
    measures = ["sum(c) AS size", "count(*) AS different", "min(v) AS lo", "max(v) AS hi"]
    holds = " OR ".join(f"({r} >= low AND {r} < high)" for r in dict.fromkeys(wanted))

    first = counts.selectExpr("*", f"{_BIN} AS bin").groupBy(*keys, "bin").agg(
        *map(F.expr, measures),
        F.expr("sum(v * c) AS total"),
        F.expr("sum(CASE WHEN v > 0 THEN c ELSE 0 END) AS n_positive"),
    )
    # at most a few ten thousand bins per key, however many rows it has
    bins = first.selectExpr(
        *keys,
        "different",
        "lo",
        "hi",
        f"sum(size) OVER ({group} ORDER BY bin {_UPTO}) - size AS low",
        f"sum(size) OVER ({group} ORDER BY bin {_UPTO}) AS high",
        f"sum(size) OVER ({group}) AS n",
        f"sum(total) OVER ({group}) AS total",
        f"sum(n_positive) OVER ({group}) AS n_positive",
    )
    done = None
    while True:
        bins = staged(bins.filter(holds), "bins")
        small = bins.filter(f"different <= {MOST_VALUES}")
        done = small if done is None else done.unionByName(small)
        large = bins.filter(f"different > {MOST_VALUES}")
        if large.isEmpty():
            return done.select(*keys, "lo", "hi", "low", *about)
        # parts of equal width between the smallest and the largest value; each next round is that much narrower
        members = _inside(counts, large.drop("high", "different"), keys)
        part = f"least(floor((v - lo) / (hi - lo) * {PARTS}D), {PARTS - 1})"
        parts = members.selectExpr("*", "lo AS parent", f"{part} AS bin").groupBy(*keys, "parent", "low", "bin", *about)
        inner = f"PARTITION BY {', '.join([*keys, 'parent'])} ORDER BY bin {_UPTO}"
        bins = parts.agg(*map(F.expr, measures)).selectExpr(
            *keys,
            "different",
            "lo",
            "hi",
            f"low + sum(size) OVER ({inner}) - size AS low",
            f"low + sum(size) OVER ({inner}) AS high",
            *about,
        )


def distribution(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float] = (0.5,)
) -> DataFrame:
    """Per key: n, mean, n_positive and ``q<i>``, the exact interpolated quantiles, of the values.

    Null and NaN values and null keys are left out. Without ``keys`` the result is one row for the
    whole table, absent when it has no values.
    """
    keys = list(keys)
    usable = " AND ".join([f"{value} IS NOT NULL", f"NOT isnan({value})", *[f"{k} IS NOT NULL" for k in keys]])
    counts = df.filter(usable).selectExpr(*keys, f"cast({value} AS double) AS v")
    counts = staged(counts.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")), "values")

    def rank(p: float, side: str) -> str:
        return f"{side}((n - 1) * {float(p)!r}D)"

    sides = {f"{name}{i}": rank(p, f) for i, p in enumerate(probabilities) for name, f in (("a", "floor"), ("b", "ceil"))}
    members = _inside(counts, opened_bins(counts, keys, list(sides.values())), keys).selectExpr(
        "*", f"low + sum(c) OVER (PARTITION BY {', '.join([*keys, 'lo'])} ORDER BY v {_UPTO}) AS high"
    )
    picked = [
        F.expr(f"max(CASE WHEN {r} >= high - c AND {r} < high THEN v END) AS {name}") for name, r in sides.items()
    ]
    found = members.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("n", "total", "n_positive")], *picked)
    if not keys:
        found = found.filter("n IS NOT NULL")
    quantiles = [
        # equal ends stay exact, also when they are infinite
        f"CASE WHEN a{i} = b{i} THEN a{i} ELSE a{i} + (b{i} - a{i}) * ((n - 1) * {float(p)!r}D - {rank(p, 'floor')}) END AS q{i}"
        for i, p in enumerate(probabilities)
    ]
    return found.selectExpr(*keys, "n", "total / n AS mean", "n_positive", *quantiles)
