import random
import statistics

import pytest

from aftershock.functions.windows import Roll, rolling


@pytest.fixture(scope="module")
def series():
    rng = random.Random(3)
    return {
        sid: [None if rng.random() < 0.1 else round(rng.uniform(-1, 1), 3) for _ in range(n)]
        for sid, n in ((1, 90), (2, 37), (3, 1))
    }


def expected(values, i, roll):
    if roll.ahead:
        frame = values[i + roll.skip : i + roll.skip + roll.size]
    else:
        end = i - roll.skip + 1
        frame = values[max(0, end - roll.size) : max(0, end)]
    present = [v for v in frame if v is not None]
    if roll.op == "count":
        return len(present)
    need = roll.size if roll.need is None else roll.need
    if len(present) < need:
        return None
    if roll.op == "sum":
        return sum(present)
    if not present:
        return None
    if roll.op == "std":
        return statistics.stdev(present) if len(present) > 1 else None
    return {"max": max, "min": min, "mean": statistics.fmean}[roll.op](present)


ROLLS = [
    Roll(op, "close", size, f"{op}_{size}_{skip}_{int(ahead)}_{need}", skip=skip, ahead=ahead, need=need)
    for op, need in (("max", None), ("max", 0), ("min", 0), ("sum", 3), ("sum", 0), ("mean", None), ("std", None), ("count", None))
    for size in (1, 5, 8, 20)
    for skip in (0, 1, 3)
    for ahead in (False, True)
    if not (op == "std" and size == 1)
]


def test_rolling_equals_brute_force(panel, series):
    df = panel({sid: {"close": v} for sid, v in series.items()}).select("security_id", "date", "close")
    got = {}
    for r in rolling(df, ROLLS).orderBy("security_id", "date").collect():
        got.setdefault(r["security_id"], []).append(r)
    for sid, values in series.items():
        assert len(got[sid]) == len(values)
        for i, row in enumerate(got[sid]):
            for roll in ROLLS:
                want = expected(values, i, roll)
                if want is None:
                    assert row[roll.name] is None, (sid, i, roll)
                else:
                    assert row[roll.name] == pytest.approx(want, abs=1e-7), (sid, i, roll)


LEVELS = {
    "large": [1e8 + (i * 7 % 3) for i in range(30)],
    "jump after the first row": [0.0] + [1e8 + (i * 7 % 3) for i in range(40)],
    "drift": [1e6 * i + (i * 5 % 7) for i in range(80)],
    "jumps": [(1e9 if i // 25 % 2 else -1e9) + (i * 11 % 13) for i in range(100)],
    "constant": [0.1] * 40,
    "gaps": [None if i % 4 == 1 else 1e7 + (i * i % 5) for i in range(60)],
}


@pytest.mark.parametrize("name", LEVELS)
def test_deviation_is_stable(panel, name):
    values = LEVELS[name]
    rolls = [Roll("std", "close", n, f"s{n}", need=need, skip=skip) for n, need, skip in ((20, 2, 0), (7, 2, 1), (60, None, 0))]
    got = rolling(panel({1: {"close": values}}), rolls).orderBy("date").collect()
    for i, row in enumerate(got):
        for roll in rolls:
            want = expected(values, i, roll)
            assert (row[roll.name] is None) == (want is None), (i, roll)
            if want is not None:
                assert row[roll.name] == pytest.approx(want, rel=1e-6, abs=1e-12), (i, roll)


@pytest.mark.parametrize("level", [0.0, 1e7])
def test_slope_is_stable(panel, level):
    rng = random.Random(8)
    market = [level + rng.uniform(-1, 1) for _ in range(70)]
    own = [None if i % 9 == 4 else 3.0 + 1.7 * (m - level) + rng.uniform(-0.1, 0.1) for i, m in enumerate(market)]
    roll = Roll("slope", "close", 25, "beta", skip=1, need=5, on="high")
    got = rolling(panel({1: {"close": own, "high": market}}), [roll]).orderBy("date").collect()
    for i, row in enumerate(got):
        pairs = [(o, m) for o, m in zip(own[max(0, i - 25) : i], market[max(0, i - 25) : i]) if o is not None]
        if len(pairs) < 5:
            assert row["beta"] is None
        else:
            assert row["beta"] == pytest.approx(statistics.linear_regression([m for _, m in pairs], [o for o, _ in pairs]).slope, rel=1e-6)
