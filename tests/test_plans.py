"""Shape of the physical plans, and the registered queries against SQL."""

import re

import pytest

from aftershock.operators import features, labels, outcomes, passes
from aftershock.plans import oracle, queries
from aftershock.plans.study import Study
from compare import connect, rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def study(spark):
    s = Study(spark, SMALL, ("daily_prices", "crash_events"))
    s.events
    return s


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def no_broadcast(spark):
    """Plans as they are when no table is small enough to broadcast by size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _below(plan):
    """Each line of a plan with the lines of its subtree."""
    lines = [x for x in plan.splitlines() if x.strip()]
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, line in enumerate(lines):
        end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        yield line, lines[i + 1 : end]


def _panel_moves(plan):
    """Exchanges of rows of the panel itself: read from it, neither aggregated nor moved before."""
    moves = []
    for line, subtree in _below(plan):
        own = list(subtree)
        if "Exchange hashpartitioning" in line and any("daily_prices-" in x for x in own):
            if not any("Aggregate" in x or "Exchange hashpartitioning" in x for x in own):
                moves.append(line.strip())
    return moves


def _panel_sorts(plan):
    return re.findall(r"\bSort \[security_id#\d+L ASC NULLS FIRST, date#", plan)


@pytest.fixture(scope="module")
def long_paths(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_panel_passes_move_and_sort_the_panel_once(study, no_broadcast, long_paths):
    families = {
        "price": features.build_price_features(study.events, study.prices),
        "recent": features.build_recent_crash_features(study.events, study.prices),
        "beta": features.event_beta(study.events, study.prices),
        "labels": labels.build_labels(study.events, study.prices, study.master),
        "outcomes": outcomes.outcome_table(study.events, study.prices, (5, 252)),
    }
    for name, df in families.items():
        plan = _plan(df)
        assert len(_panel_moves(plan)) == 1, (name, _panel_moves(plan))
        assert len(_panel_sorts(plan)) == 1, name


def test_all_families_share_one_move_and_one_sort(study, no_broadcast, long_paths):
    wide = study.rows("price", "recent", "labels", "beta", "outcomes")
    tables = {"dataset": study.dataset, "all": wide}
    for name, df in tables.items():
        plan = _plan(df)
        assert len(_panel_moves(plan)) == 1, (name, _panel_moves(plan))
        assert len(_panel_sorts(plan)) == 1, name


def test_panel_is_cut_to_securities_with_events_before_it_moves(study, long_paths):
    some = study.events.filter("security_id % 3 = 0")
    for df in (
        features.event_beta(some, study.prices),
        outcomes.outcome_table(some, study.prices, (5,)),
        features.build_price_features(some, study.prices),
    ):
        plan = _plan(df)
        moved = [
            subtree for line, subtree in _below(plan)
            if "Exchange hashpartitioning(security_id" in line and any("daily_prices-" in x for x in subtree)
        ]
        assert moved and all(any("LeftSemi" in x for x in subtree) for subtree in moved)
    ids = some.select("security_id").distinct().count()
    assert passes.of_securities(study.prices, some).select("security_id").distinct().count() == ids


def test_large_id_sets_cut_the_panel_where_it_is_placed(study, monkeypatch):
    monkeypatch.setattr(passes, "BROADCAST_ROWS", 0)
    some = study.events.filter("security_id % 3 = 0")
    cut = passes.of_securities(study.prices, some)
    assert "ShuffledHashJoin" in _plan(cut)
    assert cut.count() == study.prices.join(some.select("security_id"), "security_id", "left_semi").count()


def test_no_choice_of_columns_moves_the_panel_again(study, no_broadcast):
    """Dropping columns must not drop what places the panel."""
    families = {
        "price": features.build_price_features(study.events, study.prices),
        "recent": features.build_recent_crash_features(study.events, study.prices),
        "beta": features.event_beta(study.events, study.prices),
        "labels": labels.build_labels(study.events, study.prices, study.master),
    }
    for name, df in families.items():
        for column in df.columns:
            if column in ("event_id", "security_id", "crash_date"):
                continue
            plan = _plan(df.select("event_id", column))
            assert not re.search(r"Exchange hashpartitioning\(security_id#\d+L, date", plan), (name, column)


def test_sector_join_places_events_by_sector_and_day(study, no_broadcast):
    plan = _plan(study.market_sector)
    assert re.search(r"Exchange hashpartitioning\(__key#\d+L, crash_date#\d+, \d+\)", plan)
    assert not re.search(r"Exchange hashpartitioning\(__key#\d+L, \d+\)", plan)


def test_shown_keeps_values_of_any_size(spark):
    df = spark.sql("SELECT inline(array(struct(1, double('NaN')), struct(2, double('inf')), struct(3, -double('inf')), struct(4, 2e13D), struct(5, 0.1234565D), struct(6, cast(null AS double)))) AS (k, v)")
    got = [r.v for r in queries.shown(df).orderBy("k").collect()]
    assert got[0] != got[0] and got[1] == float("inf") and got[2] == float("-inf")
    assert got[3] == 2e13 and got[4] == 0.123457 and got[5] is None


@pytest.mark.parametrize("name", ["event_dataset", "bucket_outcomes_recent", "fundamental_features", "quantile_buckets"])
def test_no_cartesian_products_or_python_workers(spark, no_broadcast, name):
    plan = _plan(queries.queries()[name](spark, SMALL))
    for bad in ("CartesianProduct", "PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan, (name, bad)
    if name != "quantile_buckets":  # its single row of breaks joins every row
        assert not re.search(r"BroadcastNestedLoopJoin BuildRight, LeftOuter", plan)


def test_event_scan_is_pushed_down_and_pruned(study):
    from aftershock.operators.events import detect_crashes

    plan = _plan(detect_crashes(study.prices).select("security_id", "crash_date"))
    assert "LessThanOrEqual(daily_return,-0.1)" in plan
    assert re.search(r"ReadSchema: struct<date:date,security_id:bigint,daily_return:double>", plan)


def test_a_wrong_edge_shows(study, duck, monkeypatch):
    """The SQL has its own constants: a changed one in the operators makes the results differ."""
    from aftershock.operators import buckets

    wrong = dict(buckets.FULL_OPEN_LOW, crash_return=[("sev_10_15", -0.18, -0.10), *buckets.FULL_OPEN_LOW["crash_return"][1:]])
    sql = oracle.oracle_sql()["bucket_outcomes_full"]
    want = {r[0]: r[1] for r in duck.execute(f"SELECT bucket, n FROM ({sql})").fetchall()}
    table = study.bucket_table(None, 60, 252)
    for ranges, same in ((buckets.FULL_OPEN_LOW, True), (wrong, False)):
        monkeypatch.setattr(buckets, "FULL_OPEN_LOW", ranges)
        got = {r["bucket"]: r["n"] for r in buckets.bucket_outcomes(table, {"ret_252": buckets.full_buckets()}).collect()}
        assert (got["sev_10_15"] == want["sev_10_15"]) is same


def test_bucket_table_makes_only_what_it_needs(spark, monkeypatch):
    """One search of the statements, frames without functions of each value, and a stored panel of the columns in use."""
    from aftershock.plans import study as module

    stored = {}
    monkeypatch.setattr(module, "staged", lambda df, name: stored.setdefault(name, df))
    Study(spark, SMALL, queries.BOTH, queries.BUCKET_PANEL).bucket_table(None, 60, 252)
    plan = _plan(stored["buckets"])
    assert len(re.findall(r"FileScan parquet \[l_suppkey[^\]]*l_extendedprice", plan)) == 1
    assert "lambda" not in plan
    assert set(stored["daily_prices"].columns) == set(queries.BUCKET_PANEL)
    for unused in ("max(l_tax", "max(l_discount"):
        assert unused not in _plan(stored["daily_prices"])


def test_a_family_reads_what_its_results_need():
    part = features.price_family().only(["return_252d_pre"])
    assert part.reads == ("close",) and {r.name for r in part.rolls} == {"__close_1", "__close_253"}


def test_labels_keep_every_event(study):
    assert labels.build_labels(study.events, study.prices, study.master).count() == study.events.count()
    assert study.dataset.count() == study.events.count() == study.events.select("event_id").distinct().count()


def test_features_of_a_prefix_equal_features_of_the_whole(study):
    """Cutting the panel after a date changes nothing up to that date."""
    cut = "1998-12-31"
    head = study.prices.filter(f"date <= DATE '{cut}'")
    early = study.events.filter(f"crash_date <= DATE '{cut}'")
    pairs = [
        (features.build_price_features(early, head), features.build_price_features(early, study.prices)),
        (features.build_recent_crash_features(early, head), features.build_recent_crash_features(study.events, study.prices)),
        (features.build_market_sector_features(early, head, study.master), features.build_market_sector_features(early, study.prices, study.master)),
        (features.event_beta(early, head), features.event_beta(early, study.prices)),
    ]
    for part, full in pairs:
        known = {r["event_id"]: r for r in full.collect()}
        got = part.collect()
        assert got
        for r in got:
            for c in part.columns:
                a, b = r[c], known[r["event_id"]][c]
                assert a == b or a == pytest.approx(b, abs=1e-9), (c, r["event_id"])


def test_contract_lists_the_same_queries():
    assert set(queries.queries()) == set(oracle.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = connect(SMALL)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SMALL)
    cur = duck.execute(oracle.oracle_sql()[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want


