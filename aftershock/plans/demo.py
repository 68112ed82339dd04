"""Raw study tables derived from the line items: a supplier is a security, a ship date a trading day.

``oracle.py`` states the same definitions in SQL. Sums are taken over whole cents or hundredths and
values are rounded in doubles, so both engines arrive at the same numbers in any order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(c: str, digits: int) -> str:
    """Rounding that stays in doubles, whatever the size."""
    scale = f"1e{digits}D"
    return f"rint(({c}) * {scale}) / {scale}"


def _whole(c: str) -> str:
    """Hundredths as a whole number."""
    return f"floor({c} * 100D + 0.5D)"


def raw_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars under raw column names."""
    items = table(spark, folder, "lineitem").selectExpr(
        "cast(l_suppkey AS bigint) AS sid", "to_date(l_shipdate) AS day", "l_quantity", "l_tax", "l_discount"
    )
    daily = (
        items.groupBy("sid", "day")
        .agg(
            F.expr("count(*) AS n"),
            F.expr(f"sum({_whole('l_tax')}) AS tax"),
            F.expr(f"sum({_whole('l_discount')}) AS discount"),
            F.expr("sum(l_quantity) AS volume"),
            F.expr("max(l_tax) AS mt"),
            F.expr("max(l_discount) AS md"),
        )
        .selectExpr("*", f"{rounded('(tax - 2 * discount) / (n * 100) + 0.06D', 6)} AS b")
        .selectExpr("*", f"{rounded('CASE WHEN b <= -0.135D THEN 2.5D * b ELSE 100D * b * b * b END', 6)} AS r")
    )
    logs = "sum(floor(ln(1D + r) * 1e9D + 0.5D)) OVER (PARTITION BY sid ORDER BY day ROWS UNBOUNDED PRECEDING)"
    return daily.selectExpr("*", f"{rounded(f'100D * exp({logs} / 1e9D)', 4)} AS level").selectExpr(
        "sid AS permno",
        "day AS dlycaldt",
        f"{rounded('level * (1D + (mt - md) / 2D)', 4)} AS dlyopen",
        f"{rounded('level * (1D + mt / 2D)', 4)} AS dlyhigh",
        f"{rounded('level * (1D - md / 2D)', 4)} AS dlylow",
        "CASE WHEN NOT (sid % 5 = 2 AND dayofmonth(day) = 13) THEN level END AS dlyclose",
        "volume AS dlyvol",
        "CASE WHEN NOT (sid % 5 = 3 AND dayofmonth(day) = 28) THEN r END AS dlyret",
        "CASE WHEN NOT (sid % 5 = 3 AND dayofmonth(day) = 28) THEN r END AS dlyretx",
        "CASE WHEN sid % 2 = 0 AND day >= DATE '1998-07-01' THEN 2D ELSE 1D END AS dlycumfacpr",
        "CASE WHEN sid % 2 = 0 AND day >= DATE '1998-07-01' THEN 2D ELSE 1D END AS dlycumfacshr",
        "cast(1000 + sid AS double) AS shrout",
    )


def raw_names(spark: SparkSession, folder: str) -> DataFrame:
    """Name periods: one ticker until mid-1998 and, for most, another from August 1998 on."""
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    supplier = table(spark, folder, "supplier").join(nation, F.expr("s_nationkey = n_nationkey"))
    first = "struct('A' AS letter, DATE '1990-01-01' AS start, DATE '1998-06-30' AS stop)"
    second = "struct('B' AS letter, DATE '1998-08-01' AS start, DATE '2099-12-31' AS stop)"
    base = supplier.selectExpr("cast(s_suppkey AS bigint) AS sid", "s_name", "n_regionkey").selectExpr(
        "*", f"inline(CASE WHEN sid % 9 = 4 THEN array({first}) ELSE array({first}, {second}) END)"
    )
    return base.selectExpr(
        "sid AS permno",
        "1000 + sid AS permco",
        "start AS namedt",
        "stop AS nameenddt",
        "concat('S', sid, letter) AS ticker",
        "s_name AS issuernm",
        "element_at(array('N', 'A', 'Q', 'X'), cast(sid % 4 + 1 AS int)) AS primaryexch",
        "'EQTY' AS securitytype",
        "'COM' AS securitysubtype",
        "CASE WHEN sid % 23 = 0 THEN 'AD' ELSE 'NS' END AS sharetype",
        "CASE WHEN sid % 37 = 0 THEN 'N' ELSE 'Y' END AS usincflg",
        "CASE WHEN sid % 31 <> 0 THEN 1000 + 1500 * cast(n_regionkey AS bigint) + 10 * (sid % 3) END AS siccd",
        "DATE '1990-01-01' AS securitybegdt",
        "stop AS securityenddt",
    )


def raw_delistings(spark: SparkSession, folder: str) -> DataFrame:
    """Delisting records on the last day a security traded, some of them the "still trading" code 100.

    A security that stopped more than 17 days before the end of all trading has a record in any case.
    """
    items = table(spark, folder, "lineitem").selectExpr("cast(l_suppkey AS bigint) AS sid", "to_date(l_shipdate) AS day")
    last = items.groupBy("sid").agg(F.max("day").alias("last_day"))
    edge = F.broadcast(items.agg(F.max("day").alias("edge")))  # one row
    base = last.crossJoin(edge).selectExpr("*", "sid % 7 = 0 OR last_day < date_sub(edge, 17) AS gone")
    return base.filter("gone OR sid % 7 = 1").selectExpr(
        "sid AS permno",
        "CASE WHEN gone THEN last_day ELSE DATE '2001-12-31' END AS dlstdt",
        "cast(CASE WHEN NOT gone THEN 100 WHEN sid % 35 = 0 THEN 233 ELSE 574 END AS bigint) AS dlstcd",
        "CASE WHEN sid % 35 = 0 THEN 0.05D WHEN gone AND sid % 14 <> 0 THEN -0.5D END AS dlret",
    )


def _statement_sums(spark: SparkSession, folder: str, unit: str) -> DataFrame:
    """Whole-cent sums per supplier and period."""
    items = table(spark, folder, "lineitem").selectExpr(
        "cast(l_suppkey AS bigint) AS sid",
        f"trunc(to_date(l_shipdate), '{unit}') AS period",
        f"{_whole('l_extendedprice')} AS cents",
        f"{_whole('l_discount')} AS d",
        f"{_whole('l_tax')} AS t",
    )
    sums = items.groupBy("sid", "period").agg(
        F.expr("sum(cents) AS cents"), F.expr("sum(cents * (100 - d)) AS net"), F.expr("sum(cents * t) AS taxed")
    )
    return (
        sums.selectExpr(
            "sid", "period", "net / 1e7D AS sales", "0.6D * (cents / 1e5D) AS cogs", "taxed / 1e7D AS charge"
        )
        .selectExpr("*", "sales - cogs - charge AS ebitda")
        .selectExpr(
            "*",
            "(0.5D * ebitda - 0.02D * sales) * CASE WHEN sid % 6 = 5 THEN -0.3D ELSE 1D END AS income",
            "4D * sales + 50D AS assets",
            "2D * sales AS owed",
            "lpad(cast(1000 + sid AS string), 6, '0') AS gvkey",
        )
    )


_FORMAT = ["CASE WHEN sid % 29 = 0 THEN 'FS' ELSE 'INDL' END AS indfmt", "'STD' AS datafmt", "'C' AS consol", "'D' AS popsrc"]


def raw_quarters(spark: SparkSession, folder: str) -> DataFrame:
    """Quarterly statements under raw column names."""
    return (
        _statement_sums(spark, folder, "quarter")
        .selectExpr(
            "*",
            "last_day(add_months(period, 2)) AS datadate",
            "cast(quarter(period) AS bigint) AS q",
            "cast(year(period) AS bigint) AS y",
        )
        .selectExpr(
            "gvkey",
            "datadate",
            "CASE WHEN (sid + q) % 5 <> 0 THEN date_add(datadate, cast(20 + sid % 40 AS int)) END AS rdq",
            "q AS fqtr",
            "y AS fyrq",
            "y AS fyearq",
            "sales AS saleq",
            "sales AS revtq",
            "cogs AS cogsq",
            "ebitda AS oibdpq",
            "0.05D * sales AS dpq",
            "income AS niq",
            "income / (1000 + sid) AS epspxq",
            "CASE WHEN sid % 17 = 0 THEN 0D ELSE 0.01D * sales END AS xintq",
            "assets AS atq",
            "owed AS ltq",
            "0.3D * sales AS cheq",
            "CASE WHEN sid % 3 <> 0 THEN 0.5D * sales END AS dlttq",
            "CASE WHEN sid % 6 <> 0 THEN 0.2D * sales END AS dlcq",
            "1.5D * sales AS actq",
            "CASE WHEN sid % 19 <> 0 THEN 0.8D * sales END AS lctq",
            "assets - owed AS seqq",
            "0.95D * (assets - owed) AS ceqq",
            "cast(1 + sid % 97 AS double) AS cshoq",
            *_FORMAT,
        )
    )


def raw_years(spark: SparkSession, folder: str) -> DataFrame:
    """Annual statements under raw column names."""
    return (
        _statement_sums(spark, folder, "year")
        .selectExpr("*", "last_day(add_months(period, 11)) AS datadate")
        .selectExpr(
            "gvkey",
            "datadate",
            "date_add(datadate, cast(60 + sid % 30 AS int)) AS pdate",
            "cast(year(period) AS bigint) AS fyear",
            "sales AS revt",
            "income AS ni",
            "assets AS at",
            "owed AS lt",
            "0.3D * sales AS che",
            "CASE WHEN sid % 3 <> 0 THEN 0.5D * sales END AS dltt",
            "CASE WHEN sid % 6 <> 0 THEN 0.2D * sales END AS dlc",
            "cast(1 + sid % 97 AS double) AS csho",
            *_FORMAT,
        )
    )


def link(spark: SparkSession, folder: str) -> DataFrame:
    """Security-company links: ended ones, secondary ones and ones of unusable type among them."""
    base = table(spark, folder, "supplier").selectExpr("cast(s_suppkey AS bigint) AS lpermno")
    begun = "DATE '1990-01-01' AS linkdt"
    ended = "CASE WHEN lpermno % 11 = 0 THEN DATE '1998-12-31' END AS linkenddt"
    kind = "CASE WHEN lpermno % 13 = 0 THEN 'NR' ELSE 'LC' END AS linktype"
    main = f"struct(lpad(cast(1000 + lpermno AS string), 6, '0') AS gvkey, {kind}, 'P' AS linkprim, {begun}, {ended})"
    second = (
        "struct(cast(200000 + lpermno AS string) AS gvkey, 'LU' AS linktype, 'C' AS linkprim, "
        f"{begun}, cast(null AS date) AS linkenddt)"
    )
    two = "lpermno % 10 = 1 AND lpermno % 13 <> 0"
    return base.selectExpr(
        "lpermno", f"inline(CASE WHEN {two} THEN array({main}, {second}) ELSE array({main}) END)"
    )
