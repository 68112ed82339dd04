import random

import pytest
from conftest import by_id, day

from aftershock.operators.labels import build_labels, with_terminal_rows

H, T = (2, 4), ((5, 0.05), (10, 0.10))
PATHS = {
    1: {"close": [20.0, 21.0, 19.0, 22.5, 18.0]},  # active, complete
    2: {"close": [20.0, 19.0, 20.5]},  # active, the data end
    3: {"close": [20.0, 15.0]},  # delisted at a loss
    4: {"close": [20.0, 20.5]},  # delisted at a gain
    5: {"close": [20.0, 20.5, 20.2, 20.1, 20.0], "high": [20.0, 22.4, 20.2, 20.1, 20.0]},
    6: {"close": [20.0, None, 21.5, None, None]},  # closes missing on the way
    7: {"close": [None, None, None]},
    8: {"close": [20.0, 18.0, None, None]},  # delisted, rows without close behind the last close
}


@pytest.fixture(scope="module")
def master(spark):
    rows = [(s, day(40) if s in (3, 4, 8) else None, {3: -0.8, 4: 0.1}.get(s)) for s in PATHS]
    return spark.createDataFrame(rows, "security_id long, delisting_date date, delisting_return double")


@pytest.fixture(scope="module")
def rows(panel, events, master):
    ev = events([(str(s), s, 0, -0.2, p["close"][0]) for s, p in PATHS.items()] + [("off", 1, 30, -0.2, 9.0)])
    return by_id(build_labels(ev, panel(PATHS), master, horizons=H, thresholds=T))


def test_complete_path(rows):
    r = rows["1"]
    assert (r["hit_5pct_2d"], r["hit_10pct_2d"], r["hit_10pct_4d"]) == (1, 0, 1)
    assert r["return_2d"] == pytest.approx(19 / 20 - 1) and r["return_4d"] == pytest.approx(18 / 20 - 1)
    assert r["max_rebound_4d"] == pytest.approx(22.5 / 20 - 1) and r["max_drawdown_4d"] == pytest.approx(-0.1)
    assert not r["censored_2d"] and not r["censored_4d"] and not r["no_close_data"]
    assert r["n_forward_4d"] == 4


def test_end_of_data_censors_only_the_longer_horizon(rows):
    r = rows["2"]
    assert not r["censored_2d"] and r["hit_5pct_2d"] == 0
    assert r["censored_4d"] and r["hit_5pct_4d"] is None and r["return_4d"] is None
    assert r["n_forward_4d"] == 2


def test_delisting_is_an_outcome(rows):
    loss, gain = rows["3"], rows["4"]
    assert not loss["censored_4d"] and loss["hit_5pct_4d"] == 0
    assert loss["return_4d"] == pytest.approx(15 * 0.2 / 20 - 1)
    assert gain["hit_10pct_4d"] == 1 and gain["return_4d"] == pytest.approx(20.5 * 1.1 / 20 - 1)
    assert loss["delisting_return_missing"] is False and rows["8"]["delisting_return_missing"] is True


def test_intraday_hits_are_separate(rows):
    r = rows["5"]
    assert r["hit_10pct_2d"] == 0 and r["hit_10pct_2d_hi"] == 1


def test_missing_closes_on_the_way(rows):
    r = rows["6"]
    assert r["n_forward_2d"] == 1 and r["n_forward_4d"] == 1 and not r["censored_4d"]
    assert r["return_4d"] == pytest.approx(21.5 / 20 - 1) and r["hit_5pct_2d"] == 1


def test_no_close_is_not_censoring(rows):
    r = rows["7"]
    assert r["no_close_data"] and not r["censored_2d"] and r["hit_5pct_2d"] is None


def test_event_off_the_panel_is_censored_not_lost(rows):
    r = rows["off"]
    assert r["censored_2d"] and r["n_forward_2d"] == 0 and r["return_2d"] is None


def test_terminal_row_follows_a_real_row_of_its_date(panel, master):
    path = with_terminal_rows(panel({8: PATHS[8]}), master).orderBy("date", "is_terminal").collect()
    assert [(r["date"], r["is_terminal"], r["close"]) for r in path] == [
        (day(0), False, 20.0),
        (day(1), False, 18.0),
        (day(2), False, None),
        (day(2), True, 18.0),
        (day(3), False, None),
    ]


def test_labels_equal_frames_over_paths_with_their_final_row(spark, panel, events):
    """The final row as a value against paths that hold it as a row."""
    rng = random.Random(11)
    paths, gone = {}, []
    for s in range(1, 41):
        n = rng.randint(1, 14)
        close = [None if rng.random() < 0.25 else round(rng.uniform(5, 30), 2) for _ in range(n)]
        if s % 3 == 0:
            close[-rng.randint(1, n) :] = [None] * rng.randint(1, n)
            close = close[:n]
        paths[s] = {"close": close, "high": [round(rng.uniform(5, 60), 2) for _ in close]}
        if s % 2:
            gone.append((s, day(rng.randint(0, 20)), rng.choice([None, -0.9, 0.3, 4.0])))
        else:
            gone.append((s, None, None))
    master = spark.createDataFrame(gone, "security_id long, delisting_date date, delisting_return double")
    prices = panel(paths)
    given = [(f"{s}-{i}", s, i, -0.2, c) for s, p in paths.items() for i, c in enumerate(p["close"])]
    horizons = (1, 2, 5, 9)
    got = by_id(build_labels(events(given), prices, master, horizons=horizons, thresholds=T))
    full = {}
    for r in with_terminal_rows(prices, master).collect():
        full.setdefault(r["security_id"], []).append((r["date"], r["is_terminal"], r["close"], r["high"]))
    delisted = {s for s, d, _ in gone if d is not None}
    for eid, s, i, _, p0 in given:
        path = sorted(full[s])
        at = [k for k, x in enumerate(path) if not x[1]][i]
        for h in horizons:
            frame = path[at + 1 : at + 1 + h]
            closes, highs = [x[2] for x in frame if x[2] is not None], [x[3] for x in frame if x[3] is not None]
            r = got[eid]
            assert r[f"n_forward_{h}d"] == len(closes)
            known = p0 is not None and (s in delisted or len(frame) == h)
            assert r[f"censored_{h}d"] == (p0 is not None and not known)
            want = closes[-1] / p0 - 1 if known and closes else None
            assert r[f"return_{h}d"] == (None if want is None else pytest.approx(want))
            for name, best in (("max_rebound", max), ("max_drawdown", min)):
                want = best(closes) / p0 - 1 if known and closes else None
                assert r[f"{name}_{h}d"] == (None if want is None else pytest.approx(want)), (eid, h, name)
            for percent, fraction in T:
                for column, values in ((f"hit_{percent}pct_{h}d", closes), (f"hit_{percent}pct_{h}d_hi", highs)):
                    want = int(max(values) >= p0 * (1 + fraction)) if known and values else None
                    assert r[column] == want, (eid, h, column)
