from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aftershock.sources import normalize, schemas, tables, writers
from aftershock.sources.schemas import DAILY_PRICE, SECTOR_METADATA, SchemaError, conform, empty
from aftershock.session import stage_path

BARS = "permno int, dlycaldt timestamp, dlyopen double, dlyhigh double, dlylow double, dlyclose double, dlyret double, dlyretx double, dlyvol long, dlycumfacpr double, dlycumfacshr double, shrout double"


def _bars(spark, rows):
    full = [(p, f"{d} 00:00:00", c, c, c, c, r, r, 10, f, f, 5.0) for p, d, c, r, f in rows]
    text = BARS.replace("dlycaldt timestamp", "dlycaldt string")
    return spark.createDataFrame(full, text).selectExpr(
        *[f"cast({c} AS timestamp) AS {c}" if c == "dlycaldt" else c for c in [x.split()[0] for x in BARS.split(", ")]]
    )


@pytest.fixture(scope="module")
def bars(spark):
    return _bars(
        spark,
        [
            (3, "2018-12-31", 30.0, -0.12, 1.0),
            (3, "2019-01-02", 15.0, 0.02, 0.5),
            (4, "2019-01-02", 12.0, -0.2, 0.0),
            (4, "2021-01-04", 9.0, -0.3, None),
        ],
    )


@pytest.fixture(scope="module")
def names(spark):
    rows = [
        (3, 30, date(2010, 1, 1), date(2018, 12, 31), "AB", "Alpha Beta", "N", "EQTY", "COM", "NS", "Y", 2834),
        (3, 30, date(2019, 1, 1), date(2099, 1, 1), "ABX", "Alpha Beta", "Q", "EQTY", "COM", "NS", "Y", 2834),
        (4, 40, date(2010, 1, 1), date(2021, 1, 5), "AB", "alphabet", "A", "EQTY", "COM", "AD", "N", None),
        (5, 50, date(2010, 1, 1), date(2021, 1, 5), "ZZ", "Zeta", "Z", "FUND", "ETF", "NS", "Y", 1890),
    ]
    return spark.createDataFrame(
        [(*r, date(2010, 1, 1)) for r in rows],
        "permno long, permco long, namedt date, nameenddt date, ticker string, issuernm string, primaryexch string, "
        "securitytype string, securitysubtype string, sharetype string, usincflg string, siccd long, securitybegdt date",
    )


@pytest.fixture(scope="module")
def delistings(spark):
    return spark.createDataFrame(
        [(3, date(2099, 1, 1), 100, 0.5), (4, date(2021, 1, 5), 574, -0.3), (5, date(2021, 1, 5), 233, None)],
        "permno long, dlstdt date, dlstcd long, dlret double",
    )


def test_adjusted_close_uses_a_usable_factor_only(bars):
    rows = normalize.normalize_prices(bars).orderBy("security_id", "date").collect()
    assert [r["adjusted_close"] for r in rows] == [30.0, 30.0, 12.0, 9.0]
    assert normalize.normalize_prices(bars).schema == DAILY_PRICE


def test_delisting_fields_need_a_real_code(names, delistings):
    got = {(r["security_id"], r["ticker"]): r for r in tables.security_master(names, delistings).collect()}
    assert got[3, "AB"]["delisting_code"] is None and got[3, "ABX"]["delisting_date"] is None
    assert got[4, "AB"]["delisting_return"] == -0.3
    assert [got[k]["exchange"] for k in ((3, "AB"), (3, "ABX"), (4, "AB"), (5, "ZZ"))] == ["NYSE", "Nasdaq", "NYSE American", "Z"]
    assert tables.security_master(names).filter("delisting_date IS NOT NULL").count() == 0


def test_universe_filter(names, bars, delistings):
    kept = tables.security_master(names, delistings, universe=tables.US_COMMON_STOCK)
    assert {r["security_id"] for r in kept.collect()} == {3}
    assert tables.security_master(names, universe={}).count() == 4
    assert tables.security_master(names, universe={"primaryexch": ("A", "Z"), "sharetype": ()}).count() == 2
    assert tables.daily_prices(bars, names, universe=tables.US_COMMON_STOCK).count() == 2


def test_id_and_date_filters(spark, bars):
    assert tables.daily_prices(bars, security_ids=[4]).count() == 2
    assert tables.daily_prices(bars, security_ids=[]).count() == 0
    assert tables.daily_prices(bars, security_ids=spark.createDataFrame([(3,)], "x long")).count() == 2
    assert tables.daily_prices(bars, start="2019-01-02", end=date(2021, 1, 4)).count() == 3


def test_corporate_actions_and_sectors(names, delistings):
    actions = {r["security_id"]: r for r in tables.corporate_actions(delistings).collect()}
    assert actions[4]["details"] == "dlstcd=574" and actions[4]["action_type"] == "DELISTING"
    got = {(r["security_id"], r["sic_code"]): r["sic_division"] for r in tables.sector_metadata(names).collect()}
    assert got == {(3, 2834): "Manufacturing", (4, None): "Unknown", (5, 1890): "Nonclassifiable"}


@pytest.mark.parametrize("code,division", [(100, "Agriculture, Forestry & Fishing"), (99, "Nonclassifiable"), (6799, "Finance, Insurance & Real Estate"), (9729, "Public Administration"), (9999, "Nonclassifiable")])
def test_sic_division_edges(spark, code, division):
    assert spark.sql(f"SELECT {normalize.sic_division(str(code))} AS d").first()["d"] == division


def test_conform_orders_casts_and_drops(spark):
    df = spark.createDataFrame([("7", "x", 1, "extra")], "sic_code string, sic_division string, security_id int, other string")
    assert conform(df, SECTOR_METADATA).schema == SECTOR_METADATA
    with pytest.raises(SchemaError, match="missing"):
        conform(df.drop("sic_code"), SECTOR_METADATA)
    with pytest.raises(SchemaError, match="types"):
        conform(df, SECTOR_METADATA, strict=True)
    assert conform(conform(df, SECTOR_METADATA), SECTOR_METADATA, strict=True).count() == 1
    with pytest.raises(Exception):
        conform(df.selectExpr("'no number' AS sic_code", "sic_division", "security_id"), SECTOR_METADATA).collect()


def test_empty_tables(spark):
    for schema in schemas.SCHEMAS.values():
        df = empty(spark, schema)
        assert df.count() == 0 and df.schema == schema and isinstance(schema, T.StructType)


def _statement(freq):
    columns = {k: v for k, v in normalize.FUNDAMENTAL_COLUMNS[freq].items() if v}
    values = dict.fromkeys(columns.values(), "1.5") | {columns["fiscal_year"]: "2020", columns["period_end"]: "2020-06-30", columns["public_date"]: "2020-08-01"}
    if "fqtr" in values:
        values["fqtr"] = "2"
    return values | {"gvkey": "001234", "indfmt": "INDL", "datafmt": "STD", "consol": "C", "popsrc": "D"}


@pytest.mark.parametrize("freq", ["Q", "A"])
def test_fundamentals_by_frequency(spark, freq):
    base = _statement(freq)
    debt = normalize.FUNDAMENTAL_COLUMNS[freq]["short_debt"]
    rows = [base, base | {"gvkey": "000077", debt: None}, base | {"gvkey": "000088", "indfmt": "FS"}]
    raw = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in base))
    link = spark.createDataFrame(
        [("001234", 9, "LC", "P"), ("001234", 4, "LU", "C"), ("000077", 8, "LD", "P")],
        "gvkey string, lpermno long, linktype string, linkprim string",
    )
    got = {r["company_id"]: r for r in tables.fundamentals(raw, link, freq=freq).collect()}
    assert set(got) == {1234, 77}
    assert got[1234]["security_id"] == 4 and got[77]["security_id"] is None
    assert got[1234]["total_debt"] == 3.0 and got[77]["total_debt"] == 1.5
    assert got[1234]["fiscal_quarter"] == (2 if freq == "Q" else None)
    assert {r["company_id"] for r in tables.fundamentals(raw, link, freq=freq, company_ids=[77]).collect()} == {77}
    assert {r["company_id"] for r in tables.fundamentals(raw, link, freq=freq, security_ids=[9]).collect()} == {1234}
    assert tables.fundamentals(raw, link, freq=freq, security_ids=[]).count() == 0
    with pytest.raises(ValueError):
        normalize.normalize_fundamentals(raw, "M")


def test_resolve_security_prefers_common_shares(names):
    assert [r["permno"] for r in tables.resolve_security(names, "AB", "alpha").collect()] == [3]
    assert [r["permno"] for r in tables.resolve_security(names, "AB", "alphab").collect()] == [4]
    assert tables.resolve_security(names, "AB", "zeta").count() == 0


def test_panel_round_trip_by_year(spark, bars):
    prices = normalize.normalize_prices(bars)
    path = stage_path(spark, "test-panel")
    manifest = {r["year"]: (r["rows"], r["securities"]) for r in writers.write_prices(prices, path, 2018, 2021).collect()}
    assert manifest == {2018: (1, 1), 2019: (2, 2), 2021: (1, 1)}  # 2020 has no rows
    stored = tables.scan_prices(spark, path)
    assert sorted(map(tuple, stored.select(*DAILY_PRICE.names).collect())) == sorted(map(tuple, prices.collect()))
    # one year again: the others stay
    writers.write_prices(prices.filter("security_id = 3"), path, 2019, 2019)
    assert spark.read.parquet(path).groupBy("year").count().orderBy("year").collect() == [(2018, 1), (2019, 1), (2021, 1)]
    found = tables.sql_over(spark, path, "SELECT count(*) AS n FROM prices WHERE daily_return <= -0.10D").first()["n"]
    assert found == 2


def test_duplicate_days_are_rejected_before_writing(spark, bars):
    prices = normalize.normalize_prices(bars)
    path = stage_path(spark, "test-duplicates")
    with pytest.raises(writers.DuplicateKeyError, match="duplicate"):
        writers.write_prices(prices.unionByName(prices.limit(1)), path)
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_versioned_table_describes_itself(spark, bars):
    folder = stage_path(spark, "test-artifacts")
    prices = normalize.normalize_prices(bars)
    d = writers.write_versioned(prices, folder, "prices", "v2", meta={"threshold": -0.1}).first()
    assert d["row_count"] == 4 and d["columns"] == DAILY_PRICE.names and d["meta"] == {"threshold": "-0.1"}
    stored = spark.read.parquet(d["path"])
    assert writers.fingerprint(stored.repartition(3, "close")).first()["content"] == d["content"]
    changed = stored.selectExpr("* EXCEPT (close)", "close + 1 AS close")
    assert writers.fingerprint(changed).first()["content"] != d["content"]


def test_panel_without_rows_gives_an_empty_manifest(spark, bars, tmp_path):
    prices = normalize.normalize_prices(bars).limit(0)
    manifest = writers.write_prices(prices, str(tmp_path / "none"), 2018, 2021)
    assert manifest.collect() == []
    assert tables.scan_prices(spark, str(tmp_path / "none")).count() == 0


def test_manifest_tells_its_range(spark, bars, tmp_path):
    rows = writers.write_prices(normalize.normalize_prices(bars), str(tmp_path / "panel"), 2018, 2021, revision="r7").collect()
    assert {(r["start_year"], r["end_year"], r["revision"]) for r in rows} == {(2018, 2021, "r7")}
    assert {r["total_rows"] for r in rows} == {sum(r["rows"] for r in rows)}


def test_fingerprint_tells_where_nulls_are(spark):
    a = spark.sql("SELECT cast(null AS double) AS x, 1.0D AS y")
    b = spark.sql("SELECT 1.0D AS x, cast(null AS double) AS y")
    assert writers.fingerprint(a).first()["content"] != writers.fingerprint(b).first()["content"]


def test_year_filter_prunes_folders(spark, bars, tmp_path):
    writers.write_prices(normalize.normalize_prices(bars), str(tmp_path / "panel"))
    plan = tables.scan_prices(spark, str(tmp_path / "panel")).filter("year = 2019")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_versioned_table_without_rows(spark, tmp_path):
    described = writers.write_versioned(spark.createDataFrame([], "a long, b string"), str(tmp_path), "none", "v1").first()
    assert described["row_count"] == 0 and described["content"] == "0"


def test_written_fingerprint_is_that_of_the_stored_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (None, "y"), (1, "x"), (2, None)], "a long, b string")
    described = writers.write_versioned(df.repartition(3), str(tmp_path), "some", "v1").first()
    stored = writers.fingerprint(spark.read.parquet(described["path"])).first()
    assert (described["row_count"], described["content"]) == (stored["row_count"], stored["content"]) == (4, stored["content"])


def test_years_of_events_prune_the_stored_panel(spark, tmp_path):
    rows = [(d, 1, float(i)) for i, d in enumerate([date(y, 6, 1) for y in range(1990, 2000)])]
    panel = spark.createDataFrame(rows, "date date, security_id long, close double").withColumn("year", F.year("date"))
    path = str(tmp_path / "panel")
    schemas.conform(panel.select("*", *[F.lit(1.0).alias(c) for c in schemas.DAILY_PRICE.names if c not in panel.columns]), schemas.DAILY_PRICE).withColumn(
        "year", F.year("date")
    ).write.partitionBy("year").parquet(path)
    events = spark.createDataFrame([(date(1995, 3, 1), -0.5), (date(1998, 3, 1), -0.05)], "crash_date date, crash_return double")
    events.write.parquet(str(tmp_path / "events"))
    severe = spark.read.parquet(str(tmp_path / "events")).filter("crash_return <= -0.3")
    found = tables.prices_of_years(spark, path, severe, back=2, ahead=1)
    assert sorted(r["year"] for r in found.select("year").collect()) == [1993, 1994, 1995, 1996]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_stored_ranges_come_from_the_footers(spark, tmp_path):
    rows = [(date(1990 + i % 3, 1 + i % 12, 1 + i % 28), i % 5, None if i % 4 == 0 else float(i), -0.01 * i) for i in range(60)]
    panel = spark.createDataFrame(rows, "date date, security_id long, close double, daily_return double")
    filled = panel.select("*", *[F.lit(1.0).alias(c) for c in schemas.DAILY_PRICE.names if c not in panel.columns])
    path = str(tmp_path / "panel")
    writers.write_prices(filled.dropDuplicates(["security_id", "date"]), path)
    found = tables.stored_ranges(spark, path)
    assert "PushedAggregation: [COUNT(*)" in found._jdf.queryExecution().executedPlan().toString()
    plain = tables.scan_prices(spark, path).groupBy("year").agg(
        F.count(F.lit(1)), F.count("close"), F.min("date"), F.max("date"), F.min("daily_return"), F.max("daily_return")
    )
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_company_ids_are_padded(spark):
    raw = spark.createDataFrame([("001002", 1), ("1002", 2), ("200001", 3)], "gvkey string, n int")
    for ids in ([1002], spark.createDataFrame([(1002,)], "id long")):
        assert [r["n"] for r in tables.restrict(raw, "gvkey", tables._padded(ids)).collect()] == [1]
