"""Arithmetic with the null rules every operator shares: missing stays missing, x/0 is missing.

The helpers return SQL expression text for ``selectExpr`` and ``expr``: one parse on the JVM replaces
a Python-to-JVM call per operand, which for the wide feature tables is most of the planning time.
"""

from __future__ import annotations

Z95 = 1.96


def number(x: float) -> str:
    """A double literal."""
    if x in (float("inf"), float("-inf")):
        return "double('Infinity')" if x > 0 else "double('-Infinity')"
    return f"{float(x)!r}D"


def ratio(a: str, b: str) -> str:
    """a / b, null when b is zero."""
    return f"try_divide({a}, {b})"


def change(a: str, b: str) -> str:
    """Relative change a / b - 1."""
    return f"(try_divide({a}, {b}) - 1D)"


def log_growth(r: str) -> str:
    """ln(1 + r); a total loss is -inf rather than null, so that summing it keeps the loss."""
    return f"CASE WHEN {r} <= -1D THEN double('-Infinity') ELSE ln(1D + {r}) END"


def compounded(log_sum: str) -> str:
    """Return that corresponds to a sum of log growth."""
    return f"(exp({log_sum}) - 1D)"


def finite(c: str) -> str:
    """c, or null when it is NaN or infinite."""
    return f"CASE WHEN NOT isnan({c}) AND abs({c}) < double('Infinity') THEN {c} END"


def sum_nulls_as_zero(*cols: str) -> str:
    """Row-wise sum that treats nulls as zero."""
    return "(" + " + ".join(f"coalesce({c}, 0D)" for c in cols) + ")"


def spread_null_key(key: str, by: str) -> str:
    """A long join key whose null rows are scattered instead of meeting in one shuffle partition.

    The replacement values are arbitrary, so the join condition must still require ``key`` not null.
    """
    return f"coalesce({key}, -1 - pmod(xxhash64({by}), 1048576))"


def wilson(hits: str, n: str) -> dict[str, str]:
    """rate, ci_low, ci_high: hit rate with its Wilson score interval at about 95 %; null when n is 0."""
    p, m, z2 = f"try_divide({hits}, {n})", f"nullif(double({n}), 0D)", number(Z95 * Z95)
    spread = f"(1D + {z2} / {m})"
    middle = f"({p} + {z2} / (2D * {m})) / {spread}"
    reach = f"{number(Z95)} / {spread} * sqrt({p} * (1D - {p}) / {m} + {z2} / (4D * {m} * {m}))"
    return {"rate": p, "ci_low": f"{middle} - {reach}", "ci_high": f"{middle} + {reach}"}


def named(expressions: dict[str, str]) -> list[str]:
    """``expression AS name`` for ``selectExpr``."""
    return [f"{e} AS {n}" for n, e in expressions.items()]
