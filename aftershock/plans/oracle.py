"""The registered queries in SQL, written independently of the operators.

Where an operator uses running counts, doubling lags or interval lookups, the SQL here uses plain row
frames, fan-out joins and as-of joins.
"""

from __future__ import annotations

from ..operators.dataset import (
    FEATURE_COLUMNS,
    HIT_COLUMNS,
    OUTCOME_COLUMNS,
)
from ..operators.features import MARKET_FEATURES, PRICE_FEATURES, RECENT_FEATURES
from ..operators.fundamentals import FUNDAMENTAL_META, FUNDAMENTAL_RATIOS
from ..sources.schemas import DAILY_PRICE, FUNDAMENTALS, UNRESTATED_FUNDAMENTALS

# Fixed values, stated here once more so that a wrong one in the operators shows.
MIN_PRICE, RECENT_START = "5.0", "1997-06-01"
SAMPLE_TICKER, SAMPLE_START, SAMPLE_END = "S1A", "1997-01-01", "1998-03-31"
HORIZONS = (5, 20, 60)
THRESHOLDS = ((5, 0.05), (10, 0.10), (20, 0.20))
REGIMES = (
    ("one_week", 5, None),
    ("sixty_day", 60, None),
    ("one_year", 252, None),
    ("one_year_later", 252, "1998-01-01"),
    ("sixty_day_recent", 60, RECENT_START),
    ("one_year_recent", 252, RECENT_START),
)
_DIVISIONS = """
WHEN {c} >= 100 AND {c} < 1000 THEN 'Agriculture, Forestry & Fishing'
WHEN {c} >= 1000 AND {c} < 1500 THEN 'Mining'
WHEN {c} >= 1500 AND {c} < 1800 THEN 'Construction'
WHEN {c} >= 2000 AND {c} < 4000 THEN 'Manufacturing'
WHEN {c} >= 4000 AND {c} < 5000 THEN 'Transportation & Public Utilities'
WHEN {c} >= 5000 AND {c} < 5200 THEN 'Wholesale Trade'
WHEN {c} >= 5200 AND {c} < 6000 THEN 'Retail Trade'
WHEN {c} >= 6000 AND {c} < 6800 THEN 'Finance, Insurance & Real Estate'
WHEN {c} >= 7000 AND {c} < 9000 THEN 'Services'
WHEN {c} >= 9100 AND {c} < 9730 THEN 'Public Administration'
"""

LONG_COLUMNS = {
    "prior_crash_count_5d",
    "prior_crash_count_20d",
    "prior_crash_count_60d",
    "days_since_previous_crash",
    "sector_n_members",
    "days_since_fundamental",
}


def r6(expr: str, name: str | None = None) -> str:
    """A double rounded as the registered queries round it."""
    return f"round_even(({expr})::DOUBLE * 1e6 + 0.000001::DOUBLE, 0) / 1e6" + (f" AS {name}" if name else "")


def doubles(*names: str, table: str = "") -> str:
    """Rounded double columns under their own names; whole-number columns as they are."""
    at = f"{table}." if table else ""
    return ", ".join(f"{at}{n}::BIGINT AS {n}" if n in LONG_COLUMNS else r6(at + n, n) for n in names)


def _sic_division(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'Unknown' {_DIVISIONS.format(c=c)} ELSE 'Nonclassifiable' END"


def _log(c: str) -> str:
    return f"CASE WHEN {c} <= -1 THEN '-inf'::DOUBLE WHEN {c} IS NOT NULL THEN ln(1 + {c}) END"


def _full(agg: str, c: str, frame: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER {frame} >= {n} THEN {agg}({c}) OVER {frame} END"


_WILSON = """
rate AS rate,
CASE WHEN n > 0 THEN (rate + 3.8416 / (2.0 * n)) / (1 + 3.8416 / n)
  - 1.96 / (1 + 3.8416 / n) * sqrt(rate * (1 - rate) / n + 3.8416 / (4.0 * n * n)) END AS ci_low,
CASE WHEN n > 0 THEN (rate + 3.8416 / (2.0 * n)) / (1 + 3.8416 / n)
  + 1.96 / (1 + 3.8416 / n) * sqrt(rate * (1 - rate) / n + 3.8416 / (4.0 * n * n)) END AS ci_high"""


def _wilson(counted: str, keys: str = "") -> str:
    """Rates over a subquery with hits and n."""
    lead = f"{keys}, " if keys else ""
    return (
        f"SELECT {lead}hits::BIGINT AS hits, n::BIGINT AS n, {doubles('rate', 'ci_low', 'ci_high')} FROM ("
        f"SELECT {lead}hits, n, {_WILSON} FROM (SELECT *, hits::DOUBLE / nullif(n, 0) AS rate FROM ({counted})))"
    )


_RAW = """
days AS (
  SELECT l_suppkey::BIGINT AS sid, l_shipdate::DATE AS day, count(*) AS n,
    sum(floor(l_tax * 1e2 + 0.5)::BIGINT) AS tax, sum(floor(l_discount * 1e2 + 0.5)::BIGINT) AS discount,
    sum(l_quantity) AS volume, max(l_tax) AS mt, max(l_discount) AS md
  FROM lineitem GROUP BY 1, 2),
based AS (SELECT *, round_even(((tax - 2 * discount)::DOUBLE / (n * 100)::DOUBLE + 6e-2) * 1e6, 0) / 1e6 AS b FROM days),
returned AS (
  SELECT *, round_even((CASE WHEN b <= -135e-3 THEN 25e-1 * b ELSE 1e2 * b * b * b END) * 1e6, 0) / 1e6 AS r FROM based),
levels AS (
  SELECT *, round_even(1e2 * exp(sum(floor(ln(1e0 + r) * 1e9 + 0.5)::BIGINT) OVER (
      PARTITION BY sid ORDER BY day ROWS UNBOUNDED PRECEDING)::DOUBLE / 1e9) * 1e4, 0) / 1e4 AS level
  FROM returned),
bars AS (
  SELECT sid AS permno, day AS dlycaldt,
    round_even(level * (1e0 + (mt - md) / 2e0) * 1e4, 0) / 1e4 AS dlyopen,
    round_even(level * (1e0 + mt / 2e0) * 1e4, 0) / 1e4 AS dlyhigh,
    round_even(level * (1e0 - md / 2e0) * 1e4, 0) / 1e4 AS dlylow,
    CASE WHEN NOT (sid % 5 = 2 AND day(day) = 13) THEN level END AS dlyclose,
    volume AS dlyvol,
    CASE WHEN NOT (sid % 5 = 3 AND day(day) = 28) THEN r END AS dlyret,
    CASE WHEN sid % 2 = 0 AND day >= DATE '1998-07-01' THEN 2e0 ELSE 1e0 END AS factor,
    (1000 + sid)::DOUBLE AS shrout
  FROM levels),
px AS (
  SELECT dlycaldt AS date, permno AS security_id, dlyopen AS open, dlyhigh AS high, dlylow AS low, dlyclose AS close,
    dlyclose / factor AS adjusted_close, dlyvol AS volume, dlyret AS daily_return, dlyret AS daily_return_ex_div,
    factor AS cum_factor_price, factor AS cum_factor_shares, shrout AS shares_outstanding
  FROM bars),
names AS (
  SELECT s_suppkey::BIGINT AS permno, 1000 + s_suppkey::BIGINT AS permco, p.start AS namedt, p.stop AS nameenddt,
    'S' || s_suppkey || p.letter AS ticker, s_name AS issuernm, ['N', 'A', 'Q', 'X'][s_suppkey % 4 + 1] AS primaryexch,
    'EQTY' AS securitytype, 'COM' AS securitysubtype,
    CASE WHEN s_suppkey % 23 = 0 THEN 'AD' ELSE 'NS' END AS sharetype,
    CASE WHEN s_suppkey % 37 = 0 THEN 'N' ELSE 'Y' END AS usincflg,
    CASE WHEN s_suppkey % 31 <> 0 THEN 1000 + 1500 * n_regionkey::BIGINT + 10 * (s_suppkey % 3) END AS siccd,
    DATE '1990-01-01' AS securitybegdt
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  CROSS JOIN (VALUES ('A', DATE '1990-01-01', DATE '1998-06-30'), ('B', DATE '1998-08-01', DATE '2099-12-31'))
    AS p(letter, start, stop)
  WHERE NOT (s_suppkey % 9 = 4 AND p.letter = 'B')),
universe AS (
  SELECT * FROM names WHERE sharetype = 'NS' AND securitytype = 'EQTY' AND securitysubtype = 'COM'
    AND primaryexch IN ('N', 'A', 'Q') AND usincflg = 'Y'),
delistings AS (
  SELECT sid AS permno, CASE WHEN gone THEN last_day ELSE DATE '2001-12-31' END AS dlstdt,
    CASE WHEN NOT gone THEN 100 WHEN sid % 35 = 0 THEN 233 ELSE 574 END::BIGINT AS dlstcd,
    CASE WHEN sid % 35 = 0 THEN 5e-2 WHEN gone AND sid % 14 <> 0 THEN -5e-1 END AS dlret
  FROM (SELECT sid, last_day, sid % 7 = 0 OR last_day < max(last_day) OVER () - 17 AS gone
    FROM (SELECT sid, max(day) AS last_day FROM days GROUP BY 1))
  WHERE gone OR sid % 7 = 1),
master AS (
  SELECT u.permno AS security_id, permco AS company_id, ticker, namedt AS ticker_start, nameenddt AS ticker_end,
    CASE primaryexch WHEN 'N' THEN 'NYSE' WHEN 'A' THEN 'NYSE American' WHEN 'Q' THEN 'Nasdaq' ELSE primaryexch END
      AS exchange,
    securitytype AS security_type, siccd AS sic_code, securitybegdt AS listing_date,
    CASE WHEN dlstcd >= 200 THEN dlstdt END AS delisting_date, CASE WHEN dlstcd >= 200 THEN dlstcd END AS delisting_code,
    CASE WHEN dlstcd >= 200 THEN dlret END AS delisting_return
  FROM universe u LEFT JOIN delistings d ON u.permno = d.permno),
cents AS (
  SELECT l_suppkey::BIGINT AS sid, l_shipdate AS shipped, floor(l_extendedprice * 1e2 + 0.5)::BIGINT AS cents,
    floor(l_discount * 1e2 + 0.5)::BIGINT AS d, floor(l_tax * 1e2 + 0.5)::BIGINT AS t FROM lineitem),
quarter_sums AS (
  SELECT sid, date_trunc('quarter', shipped)::DATE AS period, sum(cents)::DOUBLE AS cents,
    sum(cents * (100 - d))::DOUBLE AS net, sum(cents * t)::DOUBLE AS taxed FROM cents GROUP BY 1, 2),
year_sums AS (
  SELECT sid, date_trunc('year', shipped)::DATE AS period, sum(cents)::DOUBLE AS cents,
    sum(cents * (100 - d))::DOUBLE AS net, sum(cents * t)::DOUBLE AS taxed FROM cents GROUP BY 1, 2),
quarter_base AS (
  SELECT sid, period, last_day(period + INTERVAL 2 MONTH)::DATE AS datadate, quarter(period) AS q, year(period) AS y,
    net / 1e7 AS sales, 6e-1 * (cents / 1e5) AS cogs,
    net / 1e7 - 6e-1 * (cents / 1e5) - taxed / 1e7 AS ebitda FROM quarter_sums),
quarters AS (
  SELECT 1000 + sid AS company_id, sid, datadate, q, y, sales, cogs, ebitda,
    CASE WHEN (sid + q) % 5 <> 0 THEN datadate + (20 + sid % 40)::INTEGER END AS rdq,
    (5e-1 * ebitda - 2e-2 * sales) * CASE WHEN sid % 6 = 5 THEN -3e-1 ELSE 1e0 END AS income,
    CASE WHEN sid % 17 = 0 THEN 0e0 ELSE 1e-2 * sales END AS interest,
    4e0 * sales + 5e1 AS assets, 2e0 * sales AS owed, 3e-1 * sales AS cash,
    CASE WHEN sid % 3 <> 0 THEN 5e-1 * sales END AS long_debt, CASE WHEN sid % 6 <> 0 THEN 2e-1 * sales END AS short_debt,
    15e-1 * sales AS current_assets, CASE WHEN sid % 19 <> 0 THEN 8e-1 * sales END AS current_liabilities,
    (1 + sid % 97)::DOUBLE AS shares
  FROM quarter_base),
year_base AS (
  SELECT sid, last_day(period + INTERVAL 11 MONTH)::DATE AS datadate, year(period) AS y, net / 1e7 AS sales,
    net / 1e7 - 6e-1 * (cents / 1e5) - taxed / 1e7 AS ebitda FROM year_sums),
link AS (
  SELECT (1000 + s_suppkey)::BIGINT AS company_id, s_suppkey::BIGINT AS lpermno,
    CASE WHEN s_suppkey % 13 = 0 THEN 'NR' ELSE 'LC' END AS linktype, 'P' AS linkprim, DATE '1990-01-01' AS linkdt,
    CASE WHEN s_suppkey % 11 = 0 THEN DATE '1998-12-31' END AS linkenddt FROM supplier
  UNION ALL
  SELECT (200000 + s_suppkey)::BIGINT, s_suppkey::BIGINT, 'LU', 'C', DATE '1990-01-01', NULL
  FROM supplier WHERE s_suppkey % 10 = 1 AND s_suppkey % 13 <> 0),
good_link AS (SELECT * FROM link WHERE linktype IN ('LU', 'LC') AND linkprim IN ('P', 'C')),
fund AS (
  SELECT company_id, datadate AS period_end, coalesce(rdq, datadate + 60) AS public_date, rdq IS NOT NULL AS rdq_available,
    'Q' AS freq, y AS fiscal_year, q AS fiscal_quarter, sales AS revenue, cogs, sales - cogs AS gross_profit, ebitda,
    5e-2 * sales AS depreciation, ebitda - 5e-2 * sales AS operating_income, income AS net_income,
    income / (1000 + sid)::DOUBLE AS eps, interest AS interest_expense, assets AS total_assets, owed AS total_liabilities,
    cash, long_debt AS debt_long_term, short_debt AS debt_current,
    CASE WHEN long_debt IS NOT NULL OR short_debt IS NOT NULL
      THEN coalesce(long_debt, 0e0) + coalesce(short_debt, 0e0) END AS total_debt,
    current_assets, current_liabilities, assets - owed AS stockholders_equity, 95e-2 * (assets - owed) AS common_equity,
    shares AS shares_outstanding
  FROM quarters),
"""

_EVENTS = f"""
ev AS (
  SELECT p.security_id || '_' || strftime(p.date, '%Y%m%d') AS event_id, p.security_id, m.company_id,
    m.ticker AS ticker_as_of_event, p.date AS crash_date, p.daily_return AS crash_return, p.close AS crash_close,
    p.volume AS crash_volume, m.security_id IS NOT NULL AS in_universe_at_event, p.close >= {MIN_PRICE} AS passes_min_price
  FROM px p LEFT JOIN master m
    ON p.security_id = m.security_id AND p.date BETWEEN m.ticker_start AND m.ticker_end
  WHERE p.daily_return <= -0.1
  QUALIFY row_number() OVER (PARTITION BY p.security_id, p.date ORDER BY m.ticker_start DESC NULLS LAST, m.ticker) = 1),
clean AS (SELECT * FROM ev WHERE in_universe_at_event AND passes_min_price),
"""

_PRICE = """
pw AS (
  SELECT security_id, date, open, high, low, close, volume, daily_return, lag(close) OVER w AS prev,
    CASE WHEN count(volume) OVER b20 = 20 THEN avg(volume) OVER b20 END AS v20,
    CASE WHEN count(daily_return) OVER b20 = 20 THEN stddev_samp(daily_return) OVER b20 END AS s20,
    CASE WHEN count(daily_return) OVER b60 = 60 THEN stddev_samp(daily_return) OVER b60 END AS s60,
    lag(close, 6) OVER w AS l5, lag(close, 21) OVER w AS l20, lag(close, 61) OVER w AS l60, lag(close, 253) OVER w AS l252,
    CASE WHEN count(high) OVER c20 = 20 THEN max(high) OVER c20 END AS h20,
    CASE WHEN count(high) OVER c60 = 60 THEN max(high) OVER c60 END AS h60,
    CASE WHEN count(high) OVER c252 = 252 THEN max(high) OVER c252 END AS h252,
    CASE WHEN count(close) OVER c20 = 20 THEN max(close) OVER c20 END AS p20,
    CASE WHEN count(close) OVER c60 = 60 THEN max(close) OVER c60 END AS p60,
    CASE WHEN count(close) OVER c252 = 252 THEN max(close) OVER c252 END AS p252
  FROM px
  WINDOW w AS (PARTITION BY security_id ORDER BY date),
    b20 AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
    b60 AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING),
    c20 AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
    c60 AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
    c252 AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
pf AS (
  SELECT e.event_id, e.security_id, e.crash_date, p.daily_return AS crash_return, open / nullif(prev, 0) - 1 AS opening_gap,
    (high - low) / nullif(prev, 0) AS intraday_range, close / nullif(low, 0) - 1 AS close_vs_low,
    close / nullif(open, 0) - 1 AS close_vs_open, volume AS crash_volume, volume / nullif(v20, 0) AS relative_volume_20d,
    s20 AS volatility_20d, s60 AS volatility_60d, prev / nullif(l5, 0) - 1 AS return_5d_pre,
    prev / nullif(l20, 0) - 1 AS return_20d_pre, prev / nullif(l60, 0) - 1 AS return_60d_pre,
    prev / nullif(l252, 0) - 1 AS return_252d_pre, close / nullif(h20, 0) - 1 AS distance_from_20d_high,
    close / nullif(h60, 0) - 1 AS distance_from_60d_high, close / nullif(h252, 0) - 1 AS distance_from_52w_high,
    close / nullif(p20, 0) - 1 AS drawdown_20d, close / nullif(p60, 0) - 1 AS drawdown_60d,
    close / nullif(p252, 0) - 1 AS drawdown_252d
  FROM ev e LEFT JOIN pw p ON e.security_id = p.security_id AND e.crash_date = p.date),
"""

_RECENT = """
marked AS (
  SELECT p.security_id, p.date, p.close, p.daily_return, e.event_id IS NOT NULL AS hit,
    row_number() OVER (PARTITION BY p.security_id ORDER BY p.date) AS seq
  FROM px p LEFT JOIN ev e ON p.security_id = e.security_id AND p.date = e.crash_date),
history AS (
  SELECT *,
    coalesce(sum(hit::INT) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS n5,
    coalesce(sum(hit::INT) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0)
      AS n20,
    coalesce(sum(hit::INT) OVER (PARTITION BY security_id ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), 0)
      AS n60,
    last_value(CASE WHEN hit THEN seq END IGNORE NULLS) OVER past AS pseq,
    last_value(CASE WHEN hit THEN daily_return END IGNORE NULLS) OVER past AS pret,
    last_value(CASE WHEN hit THEN close END IGNORE NULLS) OVER past AS pclose,
    coalesce(sum(hit::INT) OVER past, 0) AS seg
  FROM marked
  WINDOW past AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
peaks AS (
  SELECT *, CASE WHEN close IS NOT NULL THEN max(close) OVER (
    PARTITION BY security_id, seg ORDER BY date ROWS UNBOUNDED PRECEDING) END AS peak FROM history),
rf AS (
  SELECT e.event_id, e.security_id, e.crash_date, n5::BIGINT AS prior_crash_count_5d, n20::BIGINT AS prior_crash_count_20d,
    n60::BIGINT AS prior_crash_count_60d, (seq - pseq)::BIGINT AS days_since_previous_crash,
    pret AS previous_crash_return, close / nullif(pclose, 0) - 1 AS return_since_previous_crash,
    peak / nullif(pclose, 0) - 1 AS max_rebound_since_previous_crash
  FROM ev e LEFT JOIN peaks p ON e.security_id = p.security_id AND e.crash_date = p.date),
"""

_MARKET = f"""
sectors AS (
  SELECT security_id, floor(arg_min(sic_code, ticker_start) FILTER (sic_code IS NOT NULL) / 100)::BIGINT AS sector
  FROM master GROUP BY 1),
market_days AS (SELECT date, avg(daily_return) AS m FROM px GROUP BY 1),
market_logs AS (SELECT *, {_log('m')} AS g FROM market_days),
market AS (
  SELECT date, m AS market_return_1d, exp({_full('sum', 'g', 'c5', 5)}) - 1 AS market_return_5d,
    exp({_full('sum', 'g', 'c20', 20)}) - 1 AS market_return_20d,
    {_full('stddev_samp', 'm', 'c20', 20)} AS market_volatility_20d
  FROM market_logs
  WINDOW c5 AS (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
    c20 AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
sector_days AS (
  SELECT sector, date, sum(daily_return) AS total, count(daily_return) AS members
  FROM px JOIN sectors USING (security_id) WHERE sector IS NOT NULL GROUP BY 1, 2),
sector_means AS (SELECT *, total / nullif(members, 0) AS m FROM sector_days),
sector_logs AS (SELECT *, {_log('m')} AS g FROM sector_means),
sector AS (
  SELECT sector, date, total, members, exp({_full('sum', 'g', 'c5', 5)}) - 1 AS sector_return_5d,
    {_full('stddev_samp', 'm', 'c20', 20)} AS sector_volatility_20d
  FROM sector_logs
  WINDOW c5 AS (PARTITION BY sector ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
    c20 AS (PARTITION BY sector ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
mf AS (
  SELECT e.event_id, market_return_1d, market_return_5d, market_return_20d, market_volatility_20d,
    CASE WHEN members > 1 THEN (total - crash_return) / (members - 1) END AS sector_return_1d,
    sector_return_5d, sector_volatility_20d, members::BIGINT AS sector_n_members
  FROM ev e LEFT JOIN sectors s ON e.security_id = s.security_id
  LEFT JOIN market m ON e.crash_date = m.date
  LEFT JOIN sector t ON s.sector = t.sector AND e.crash_date = t.date),
"""


def _labels() -> str:
    sums, out = [], []
    for h in HORIZONS:
        near = f"FILTER (f.seq - i.seq <= {h})"
        sums.append(
            f"max(f.close) {near} AS maxc{h}, min(f.close) {near} AS minc{h}, max(f.high) {near} AS maxh{h}, "
            f"count(f.close) {near} AS nf{h}, count(f.seq) {near} AS nr{h}, "
            f"arg_max(f.close, f.seq) FILTER (f.seq - i.seq <= {h} AND f.close IS NOT NULL) AS endc{h}"
        )
        known = f"p0 IS NOT NULL AND (gone OR nr{h} >= {h})"
        out.append(f"nf{h}::BIGINT AS n_forward_{h}d, p0 IS NOT NULL AND NOT gone AND nr{h} < {h} AS censored_{h}d")
        for name, c in (("return", "endc"), ("max_rebound", "maxc"), ("max_drawdown", "minc")):
            out.append(f"CASE WHEN {known} THEN {c}{h} / nullif(p0, 0) - 1 END AS {name}_{h}d")
        for pct, frac in THRESHOLDS:
            for c, suffix in (("maxc", ""), ("maxh", "_hi")):
                out.append(
                    f"CASE WHEN {known} THEN ({c}{h} >= p0 * {repr(1.0 + frac)}::DOUBLE)::TINYINT END AS hit_{pct}pct_{h}d{suffix}"
                )
    return f"""
gone AS (
  SELECT security_id, max(delisting_date) IS NOT NULL AS gone,
    arg_min(delisting_return, ticker_start) FILTER (delisting_return IS NOT NULL) AS loss FROM master GROUP BY 1),
path AS (
  SELECT security_id, date, close, high, 0 AS final FROM px
  UNION ALL
  SELECT p.security_id, max(date) + 1, arg_max(close, date) * (1 + coalesce(any_value(loss), 0)),
    arg_max(close, date) * (1 + coalesce(any_value(loss), 0)), 1
  FROM px p JOIN gone g ON p.security_id = g.security_id AND g.gone WHERE close IS NOT NULL GROUP BY 1),
steps AS (
  SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY date, final) AS seq FROM path),
anchors AS (
  SELECT e.event_id, e.security_id, e.crash_date, e.crash_close, s.seq
  FROM ev e LEFT JOIN steps s ON e.security_id = s.security_id AND e.crash_date = s.date AND s.final = 0),
ahead AS (
  SELECT i.event_id, {", ".join(sums)}
  FROM anchors i LEFT JOIN steps f ON i.security_id = f.security_id AND f.seq > i.seq AND f.seq <= i.seq + {max(HORIZONS)}
  GROUP BY 1),
lb_in AS (
  SELECT a.*, i.security_id, i.crash_date, i.crash_close AS p0, coalesce(g.gone, false) AS gone,
    g.gone AND g.loss IS NULL AS delisting_return_missing
  FROM ahead a JOIN anchors i USING (event_id) LEFT JOIN gone g ON i.security_id = g.security_id),
lb AS (
  SELECT event_id, security_id, crash_date, p0 AS crash_close, p0 IS NULL AS no_close_data, delisting_return_missing,
    {", ".join(out)} FROM lb_in),
"""


_FUND = """
fe AS (
  SELECT *,
    CASE WHEN count(revenue) OVER y = 4 THEN sum(revenue) OVER y END AS revenue_ttm,
    CASE WHEN count(net_income) OVER y = 4 THEN sum(net_income) OVER y END AS ni_ttm,
    CASE WHEN count(gross_profit) OVER y = 4 THEN sum(gross_profit) OVER y END AS gross_profit_ttm,
    CASE WHEN count(operating_income) OVER y = 4 THEN sum(operating_income) OVER y END AS operating_income_ttm,
    CASE WHEN count(ebitda) OVER y = 4 THEN sum(ebitda) OVER y END AS ebitda_ttm,
    CASE WHEN count(interest_expense) OVER y = 4 THEN sum(interest_expense) OVER y END AS interest_ttm,
    revenue / nullif(lag(revenue, 4) OVER w, 0) - 1 AS revenue_growth_yoy,
    revenue / nullif(lag(revenue, 1) OVER w, 0) - 1 AS revenue_growth_qoq,
    eps / nullif(lag(eps, 4) OVER w, 0) - 1 AS eps_growth_yoy
  FROM fund
  WINDOW w AS (PARTITION BY company_id ORDER BY period_end),
    y AS (PARTITION BY company_id ORDER BY period_end ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
linked AS (
  SELECT e.event_id, e.security_id, e.crash_date, e.crash_close, l.company_id
  FROM ev e LEFT JOIN good_link l ON e.security_id = l.lpermno AND e.crash_date >= l.linkdt
    AND (l.linkenddt IS NULL OR e.crash_date <= l.linkenddt)
  QUALIFY row_number() OVER (PARTITION BY e.event_id
    ORDER BY CASE WHEN l.linkprim = 'P' THEN 0 ELSE 1 END, l.linkdt DESC NULLS LAST, l.company_id) = 1),
known AS (
  SELECT l.event_id, l.crash_date, l.crash_close, l.company_id, f.* EXCLUDE (company_id), crash_close * shares_outstanding AS cap,
    total_debt - cash AS debt
  FROM linked l ASOF LEFT JOIN fe f ON l.company_id = f.company_id AND l.crash_date >= f.public_date),
ff AS (
  SELECT event_id, revenue_growth_yoy, revenue_growth_qoq, eps_growth_yoy,
    gross_profit_ttm / nullif(revenue_ttm, 0) AS gross_margin, operating_income_ttm / nullif(revenue_ttm, 0) AS operating_margin,
    ni_ttm / nullif(revenue_ttm, 0) AS net_margin, ni_ttm / nullif(total_assets, 0) AS roa,
    ni_ttm / nullif(stockholders_equity, 0) AS roe, debt AS net_debt,
    current_assets / nullif(current_liabilities, 0) AS current_ratio, total_debt / nullif(total_assets, 0) AS debt_to_assets,
    debt / nullif(ebitda_ttm, 0) AS net_debt_to_ebitda, operating_income_ttm / nullif(interest_ttm, 0) AS interest_coverage,
    cap AS market_cap, cap / nullif(ni_ttm, 0) AS pe, cap / nullif(revenue_ttm, 0) AS price_to_sales,
    (cap + debt) / nullif(revenue_ttm, 0) AS ev_to_sales, (cap + debt) / nullif(ebitda_ttm, 0) AS ev_to_ebitda,
    period_end IS NOT NULL AS fundamentals_available, period_end AS fundamentals_period_end,
    public_date AS fundamentals_public_date, (crash_date - period_end)::BIGINT AS days_since_fundamental,
    (crash_date - period_end) > 200 AS fundamentals_stale, coalesce(rdq_available, false) AS fundamentals_rdq_available
  FROM known),
em AS (
  SELECT l.event_id, ebitda_ttm / nullif(revenue_ttm, 0) AS ebitda_margin
  FROM linked l JOIN clean c USING (event_id)
  ASOF LEFT JOIN fe f ON l.company_id = f.company_id AND l.crash_date >= f.public_date
  WHERE l.company_id IS NOT NULL),
"""

_OUTCOMES = f"""
growth AS (
  SELECT security_id, date, row_number() OVER w AS k,
    sum({_log('coalesce(daily_return, 0)')}) OVER (PARTITION BY security_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS g
  FROM px WHERE security_id IN (SELECT security_id FROM clean)
  WINDOW w AS (PARTITION BY security_id ORDER BY date)),
ends AS (SELECT security_id, max(k) AS last_k, max(date) AS last_date FROM growth GROUP BY 1),
edge AS (SELECT max(date) - 17 AS edge FROM growth),
fwd AS (
  SELECT c.event_id, c.security_id, c.crash_date, h.h, x.k + h.h > n.last_k AND n.last_date >= edge AS censored,
    exp(y.g - x.g) - 1 AS ret
  FROM clean c JOIN growth x ON c.security_id = x.security_id AND c.crash_date = x.date
  JOIN ends n ON c.security_id = n.security_id CROSS JOIN edge CROSS JOIN (VALUES (5), (60), (252)) AS h(h)
  JOIN growth y ON c.security_id = y.security_id AND y.k = least(x.k + h.h, n.last_k)),
seen AS (SELECT event_id, security_id, crash_date, h, ret FROM fwd WHERE NOT censored AND NOT isnan(ret)),
"""

_BETA = """
pairs AS (
  SELECT p.security_id, p.date, coalesce(daily_return, 0) AS x, coalesce(m.m, 0) AS y
  FROM px p LEFT JOIN (SELECT date, avg(daily_return) AS m FROM px GROUP BY 1) m USING (date)),
betas AS (
  SELECT security_id, date, CASE WHEN count(*) OVER w >= 120
    THEN covar_pop(x, y) OVER w / nullif(var_pop(y) OVER w, 0) END AS beta
  FROM pairs WINDOW w AS (PARTITION BY security_id ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
bt AS (
  SELECT c.event_id, b.beta FROM clean c
  LEFT JOIN betas b ON c.security_id = b.security_id AND c.crash_date = b.date),
"""

_DATASET = f"""
ds AS (
  SELECT e.event_id, e.security_id, e.company_id, e.ticker_as_of_event, e.crash_date, e.in_universe_at_event,
    e.passes_min_price, e.crash_close, {", ".join('pf.' + c for c in PRICE_FEATURES)},
    {", ".join('rf.' + c for c in RECENT_FEATURES)}, {", ".join('mf.' + c for c in MARKET_FEATURES)},
    {", ".join('ff.' + c for c in FUNDAMENTAL_RATIOS + FUNDAMENTAL_META)},
    lb.* EXCLUDE (event_id, security_id, crash_date, crash_close)
  FROM ev e LEFT JOIN pf USING (event_id) LEFT JOIN rf USING (event_id) LEFT JOIN mf USING (event_id)
  LEFT JOIN ff USING (event_id) LEFT JOIN lb USING (event_id)),
dc AS (SELECT * FROM ds WHERE in_universe_at_event AND passes_min_price)
"""


def _with(body: str) -> str:
    """The body after every shared table; the engine evaluates only those it reaches."""
    parts = _RAW + _EVENTS + _PRICE + _RECENT + _MARKET + _labels() + _FUND + _OUTCOMES + _BETA + _DATASET
    return f"WITH {parts.strip()}\n{body.strip()}"


def _stats(source: str, keys: str) -> str:
    """Return statistics of a subquery with ret."""
    return f"""SELECT {keys}, n, {doubles('median', 'mean', 'p_positive')}, n < 50 AS small_n FROM (
      SELECT {keys}, count(*) AS n, quantile_cont(ret, 0.5) AS median, avg(ret) AS mean,
        avg((ret > 0)::INT) AS p_positive FROM ({source}) GROUP BY {keys})"""


_FIXED_BUCKETS = {
    "mcap_micro": "market_cap > 0 AND market_cap < 100",
    "mcap_small": "market_cap >= 100 AND market_cap < 1000",
    "mcap_midlarge": "market_cap >= 1000 AND market_cap < 10000",
    "pe_unprofitable": "pe < 0",
    "pe_cheap": "pe > 0 AND pe <= 15",
    "pe_fair": "pe > 15 AND pe <= 30",
    "pe_expensive": "pe > 30",
}


_SIZE_BUCKETS = {
    "sev_10_15": "crash_return > -0.15::DOUBLE AND crash_return <= -0.10::DOUBLE",
    "sev_15_20": "crash_return > -0.20::DOUBLE AND crash_return <= -0.15::DOUBLE",
    "sev_20_30": "crash_return > -0.30::DOUBLE AND crash_return <= -0.20::DOUBLE",
    "sev_30plus": "crash_return <= -0.30::DOUBLE",
    "premom_dn": "return_252d_pre <= -0.5::DOUBLE",
    "premom_mild": "return_252d_pre > -0.5::DOUBLE AND return_252d_pre <= 0",
    "premom_up": "return_252d_pre > 0 AND return_252d_pre <= 0.5::DOUBLE",
    "premom_hot": "return_252d_pre > 0.5::DOUBLE",
    "beta_hi": "beta > 1.2::DOUBLE AND beta <= 1.8::DOUBLE",
    "beta_vhi": "beta > 1.8::DOUBLE",
    "ebm_mid": "ebitda_margin > 0.10::DOUBLE AND ebitda_margin <= 0.25::DOUBLE",
    "ebm_hi": "ebitda_margin > 0.25::DOUBLE",
    "revg_mid": "revenue_growth_yoy > 0.10::DOUBLE AND revenue_growth_yoy <= 0.30::DOUBLE",
    "revg_hi": "revenue_growth_yoy > 0.30::DOUBLE",
}

# the two sets differ at these edges
_FULL_EDGES = {
    "beta_lo": "beta <= 0.8::DOUBLE",
    "beta_mkt": "beta > 0.8::DOUBLE AND beta <= 1.2::DOUBLE",
    "ebm_neg": "ebitda_margin <= 0",
    "ebm_lo": "ebitda_margin > 0 AND ebitda_margin <= 0.10::DOUBLE",
    "revg_dn": "revenue_growth_yoy <= 0",
    "revg_lo": "revenue_growth_yoy > 0 AND revenue_growth_yoy <= 0.10::DOUBLE",
    "mkt_crash": "market_return_20d <= -0.10::DOUBLE",
    "mkt_dn": "market_return_20d > -0.10::DOUBLE AND market_return_20d <= -0.03::DOUBLE",
    "mkt_flat": "market_return_20d > -0.03::DOUBLE AND market_return_20d <= 0",
    "mkt_up": "market_return_20d > 0",
    "relsec_worse": "rel_sector <= -0.10::DOUBLE",
    "relsec_mid": "rel_sector > -0.10::DOUBLE AND rel_sector <= -0.03::DOUBLE",
    "relsec_with": "rel_sector > -0.03::DOUBLE",
    "prior_0": "coalesce(prior_crash_count_20d, 0) = 0",
    "prior_1": "prior_crash_count_20d = 1",
    "prior_2plus": "prior_crash_count_20d >= 2",
    "mcap_mega": "market_cap >= 10000 AND market_cap < 1e12",
}
_RECENT_EDGES = {
    "beta_lo": "beta < 0.8::DOUBLE",
    "beta_mkt": "beta >= 0.8::DOUBLE AND beta <= 1.2::DOUBLE",
    "ebm_neg": "ebitda_margin < 0",
    "ebm_lo": "ebitda_margin >= 0 AND ebitda_margin <= 0.10::DOUBLE",
    "revg_dn": "revenue_growth_yoy < 0",
    "revg_lo": "revenue_growth_yoy >= 0 AND revenue_growth_yoy <= 0.10::DOUBLE",
    "mkt_crash": "market_return_20d < -0.10::DOUBLE",
    "mkt_dn": "market_return_20d >= -0.10::DOUBLE AND market_return_20d < -0.03::DOUBLE",
    "mkt_flat": "market_return_20d >= -0.03::DOUBLE AND market_return_20d < 0",
    "mkt_up": "market_return_20d >= 0",
    "relsec_worse": "rel_sector < -0.10::DOUBLE",
    "relsec_mid": "rel_sector >= -0.10::DOUBLE AND rel_sector < -0.03::DOUBLE",
    "relsec_with": "rel_sector >= -0.03::DOUBLE",
    "prior_0": "prior_crash_count_20d = 0",
    "prior_1": "prior_crash_count_20d = 1",
    "prior_2plus": "prior_crash_count_20d >= 2",
    "mcap_mega": "market_cap >= 10000",
}


def _full_buckets() -> dict[str, str]:
    return _SIZE_BUCKETS | _FULL_EDGES | _FIXED_BUCKETS


def _recent_buckets() -> dict[str, str]:
    return _SIZE_BUCKETS | _RECENT_EDGES | _FIXED_BUCKETS


def _bucketed(buckets: dict[str, str], horizon: int, since: str | None) -> str:
    floor = f" AND s.crash_date >= DATE '{since}'" if since else ""
    base = f"""SELECT s.ret, d.*, b.beta, m.ebitda_margin, d.crash_return - d.sector_return_1d AS rel_sector
      FROM seen s JOIN ds d USING (event_id) LEFT JOIN bt b USING (event_id) LEFT JOIN em m USING (event_id)
      WHERE s.h = {horizon}{floor}"""
    return " UNION ALL ".join(f"SELECT '{k}' AS bucket, ret FROM ({base}) WHERE {test}" for k, test in buckets.items())


def _severity(buckets: dict[str, str], suffix: str) -> dict[str, str]:
    return {k + suffix: v for k, v in buckets.items() if k.startswith("sev_")}


_SLICES = {
    "magnitude": "CASE WHEN crash_return > -0.15 THEN 0 WHEN crash_return > -0.20 THEN 1 WHEN crash_return > -0.30 THEN 2 ELSE 3 END",
    "prior_count": "CASE prior_crash_count_20d WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END",
    "size": "CASE WHEN market_cap IS NULL THEN NULL WHEN market_cap < 300 THEN 0 WHEN market_cap < 2000 THEN 1 WHEN market_cap < 10000 THEN 2 ELSE 3 END",
    "profitability": "CASE WHEN net_margin IS NULL THEN NULL WHEN net_margin < 0 THEN 0 ELSE 1 END",
    "leverage": "CASE WHEN debt_to_assets IS NULL THEN NULL WHEN debt_to_assets < 0.1 THEN 0 WHEN debt_to_assets < 0.3 THEN 1 WHEN debt_to_assets < 0.5 THEN 2 ELSE 3 END",
    "market_day": "CASE WHEN market_return_1d <= -0.05 THEN 0 WHEN market_return_1d <= -0.02 THEN 1 WHEN market_return_1d < 0 THEN 2 ELSE 3 END",
}

# Labels of the codes, stated here once more.
_SLICE_LABELS = {
    "magnitude": ["-10% to -15%", "-15% to -20%", "-20% to -30%", "≤ -30%"],
    "prior_count": ["fresh (0 prior/20d)", "1 prior", "2 prior", "3+ prior"],
    "size": ["micro (<$300M)", "small ($0.3–2B)", "mid ($2–10B)", "large (≥$10B)"],
    "profitability": ["unprofitable (margin<0)", "profitable (margin≥0)"],
    "leverage": ["<0.1", "0.1–0.3", "0.3–0.5", "≥0.5"],
    "market_day": ["market ≤ -5% (broad crash)", "-5% to -2%", "-2% to 0%", "market ≥ 0%"],
}

_HEADLINES = {
    "fresh": "prior_crash_count_20d = 0",
    "three_or_more_prior": "prior_crash_count_20d >= 3",
    "market_crash": "market_return_1d <= -0.05",
    "market_up": "market_return_1d >= 0",
    "micro_cap": "market_cap < 300",
    "large_cap": "market_cap >= 10000",
    "unprofitable": "net_margin < 0",
    "profitable": "net_margin >= 0",
}


# Lower end, upper end and width of the displayed bins, stated here once more.
_DISPLAYS = {252: (-1.0, 2.0, 0.10), 60: (-1.0, 1.0, 0.05), 5: (-0.5, 0.5, 0.025)}


def _histogram(source: str, horizon: int, keys: str = "") -> str:
    low, high, width = _DISPLAYS[horizon]
    step = (low + width) - low
    edges = [low + i * step for i in range(round((high - low) / width) + 1)]
    steps = " + ".join(f"(v >= {e!r}::DOUBLE)::INT" for e in edges[1:-1])
    lows = ", ".join(f"{e!r}::DOUBLE" for e in edges)
    lead, whole = (f"{keys}, ", f"PARTITION BY {keys}") if keys else ("", "")
    return f"""SELECT {lead}bin, {r6(f'[{lows}][bin + 1]', 'bin_low')}, n, {r6(f'100.0 * n / sum(n) OVER ({whole})', 'percent')} FROM (
      SELECT {lead}{steps} AS bin, count(*) AS n
      FROM (SELECT {lead}least(greatest(ret, {low!r}::DOUBLE), {high!r}::DOUBLE) AS v FROM ({source})) GROUP BY {lead}bin)"""


def _types(schema) -> str:
    """Columns of a canonical table, doubles rounded."""
    return ", ".join(r6(f.name, f.name) if f.dataType.typeName() == "double" else f.name for f in schema)


def oracle_sql() -> dict[str, str]:
    """SQL per registered query."""
    q: dict[str, str] = {}
    price_types = _types(DAILY_PRICE)
    q["scan_panel_range"] = f"""SELECT {price_types} FROM px
      WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-06-30' AND security_id IN (SELECT permno FROM universe)"""
    q["panel_write_manifest"] = """SELECT year(date)::INTEGER AS year, count(*) AS rows,
      count(DISTINCT security_id) AS securities FROM px GROUP BY 1"""
    q["scan_stored_panel"] = f"SELECT {price_types} FROM px WHERE year(date) BETWEEN 1997 AND 1998"
    q["stored_panel_ranges"] = f"""SELECT year(date)::INTEGER AS year, count(*) AS n_rows, count(close) AS n_closes,
      min(date) AS min_date, max(date) AS max_date, {r6('min(daily_return)', 'lowest_return')},
      {r6('max(daily_return)', 'highest_return')} FROM px GROUP BY 1"""
    q["panel_around_severe_events"] = f"""SELECT event_id, count(*) AS days, {r6('min(close)', 'lowest')}, {r6('max(close)', 'highest')}
      FROM clean c JOIN px p ON p.security_id = c.security_id AND p.date BETWEEN c.crash_date - 60 AND c.crash_date
      WHERE crash_return <= -0.33 AND crash_date < DATE '1997-01-01' GROUP BY 1"""
    q["versioned_write_fingerprint"] = """SELECT 'crash_events' AS name, 'v1' AS version, count(*) AS row_count,
      'event_id,security_id,company_id,ticker_as_of_event,crash_date,crash_return,crash_close,crash_volume,in_universe_at_event,passes_min_price'
      AS columns, true AS same_content, true AS has_bytes FROM ev"""
    q["sql_over_parquet"] = """SELECT year(date)::INTEGER AS year, count(*) AS crashes, max(daily_return) AS mildest
      FROM px WHERE daily_return <= -0.10 GROUP BY 1"""
    q["security_master"] = f"SELECT * REPLACE ({r6('delisting_return')} AS delisting_return) FROM master"
    q["master_summary"] = """SELECT count(*) AS rows, count(DISTINCT security_id) AS securities,
      count(DISTINCT company_id) AS companies, count(DISTINCT security_id) FILTER (delisting_date IS NOT NULL) AS with_delisting,
      min(ticker_start) AS date_min, max(ticker_end) AS date_max,
      array_to_string(list_sort(list(DISTINCT exchange)), ',') AS exchanges,
      count(DISTINCT security_id) - count(DISTINCT security_id) FILTER (delisting_date IS NOT NULL) AS active FROM master"""
    q["delisting_classes"] = """SELECT CASE WHEN code IS NULL THEN 'active' WHEN code < 400 THEN 'acquired' ELSE 'dropped' END
      AS delisting_class, count(*) AS securities
      FROM (SELECT security_id, max(delisting_code) AS code FROM master GROUP BY 1) GROUP BY 1"""
    q["renamed_securities"] = """SELECT security_id, count(DISTINCT ticker) AS n_tickers FROM master GROUP BY 1
      HAVING count(DISTINCT ticker) > 1"""
    q["corporate_actions"] = f"""SELECT permno AS security_id, dlstdt AS effective_date, 'DELISTING' AS action_type,
      {r6('dlret', 'value')}, dlstcd AS code, 'dlstcd=' || dlstcd AS details FROM delistings"""
    q["sector_metadata"] = f"""SELECT DISTINCT permno AS security_id, siccd AS sic_code,
      {_sic_division('siccd')} AS sic_division FROM names"""
    q["normalize_prices"] = f"SELECT {price_types} FROM px"
    one_link = "(SELECT company_id, min(lpermno) AS security_id FROM good_link GROUP BY 1)"
    basic = _types(FUNDAMENTALS)
    q["normalize_fund_q"] = f"""SELECT {basic} FROM (
      SELECT company_id, security_id, datadate AS period_end, rdq AS public_date, 'Q' AS freq, y AS fiscal_year,
        q AS fiscal_quarter, sales AS revenue, income AS net_income, assets AS total_assets, owed AS total_liabilities,
        cash, coalesce(long_debt, 0) + coalesce(short_debt, 0) AS total_debt, shares AS shares_outstanding
      FROM quarters LEFT JOIN {one_link} USING (company_id) WHERE sid % 29 <> 0)"""
    q["prices_by_id_list"] = f"SELECT {price_types} FROM px WHERE security_id IN (1, 3, 5)"
    q["fund_by_company_ids"] = f"SELECT * FROM ({q['normalize_fund_q']}) WHERE company_id IN (1002, 1004, 1010)"
    q["fund_by_company_table"] = f"SELECT * FROM ({q['normalize_fund_q']}) WHERE company_id % 4 = 2"
    q["normalize_fund_a"] = f"""SELECT {basic} FROM (
      SELECT 1000 + sid AS company_id, security_id, datadate AS period_end, datadate + (60 + sid % 30)::INTEGER AS public_date,
        'A' AS freq, y AS fiscal_year, NULL::BIGINT AS fiscal_quarter, sales AS revenue,
        (5e-1 * ebitda - 2e-2 * sales) * CASE WHEN sid % 6 = 5 THEN -3e-1 ELSE 1e0 END AS net_income,
        4e0 * sales + 5e1 AS total_assets, 2e0 * sales AS total_liabilities, 3e-1 * sales AS cash,
        CASE WHEN sid % 3 <> 0 THEN 5e-1 * sales ELSE 0 END + CASE WHEN sid % 6 <> 0 THEN 2e-1 * sales ELSE 0 END AS total_debt,
        (1 + sid % 97)::DOUBLE AS shares_outstanding
      FROM year_base LEFT JOIN {one_link} ON 1000 + sid = company_id WHERE sid % 29 <> 0)"""
    q["fund_of_universe"] = f"""SELECT {basic} FROM (
      SELECT company_id, security_id, datadate AS period_end, rdq AS public_date, 'Q' AS freq, y AS fiscal_year,
        q AS fiscal_quarter, sales AS revenue, income AS net_income, assets AS total_assets, owed AS total_liabilities,
        cash, coalesce(long_debt, 0) + coalesce(short_debt, 0) AS total_debt, shares AS shares_outstanding
      FROM quarters JOIN (SELECT company_id, min(lpermno) AS security_id FROM good_link
        WHERE lpermno IN (SELECT permno FROM universe) GROUP BY 1) USING (company_id) WHERE sid % 29 <> 0)"""
    unrestated = _types(UNRESTATED_FUNDAMENTALS)
    q["normalize_fund_unrestated"] = f"SELECT {unrestated} FROM fund"
    q["fundamentals_coverage"] = """SELECT count(*) AS rows, count(DISTINCT company_id) AS companies,
      min(period_end) AS period_min, max(period_end) AS period_max, """ + ", ".join(
        [r6("avg(rdq_available::INT)", "rdq_available")]
        + [
            r6(f"avg(({c} IS NOT NULL)::INT)", f"{c}_present")
            for c in ("revenue", "net_income", "total_assets", "total_debt", "eps", "stockholders_equity", "ebitda")
        ]
    ) + " FROM fund"
    q["duplicate_keys"] = """SELECT l_suppkey::BIGINT AS security_id, l_shipdate::DATE AS date, count(*) AS copies
      FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"""
    q["table_profile"] = f"""SELECT 13::BIGINT AS n_columns, '{",".join(DAILY_PRICE.names)}' AS columns, count(*) AS n_rows,
      min(date) AS min_date, max(date) AS max_date, count(DISTINCT security_id) AS n_distinct_ids, count(close) AS n_present
      FROM px"""
    q["code_frequency"] = """SELECT dlstcd AS code, count(*) AS n, (SELECT count(*) FROM delistings) AS total
      FROM delistings GROUP BY 1"""
    q["sample_extract"] = f"""SELECT {price_types} FROM px WHERE security_id = (
        SELECT permno FROM names WHERE ticker = '{SAMPLE_TICKER}' AND upper(issuernm) LIKE 'SUPPLIER%'
        ORDER BY CASE WHEN upper(sharetype) = 'NS' THEN 0 ELSE 1 END, securitybegdt, permno LIMIT 1)
      AND date BETWEEN DATE '{SAMPLE_START}' AND DATE '{SAMPLE_END}'
      UNION ALL SELECT {price_types} FROM px WHERE security_id IN (SELECT permno FROM delistings WHERE dlstcd >= 200)
      AND date BETWEEN DATE '{SAMPLE_START}' AND DATE '{SAMPLE_END}'"""
    q["latest_quarters"] = f"""SELECT lpad((1000 + sid)::VARCHAR, 6, '0') AS gvkey, datadate, rdq, y AS fyearq, q AS fqtr,
      {r6('sales', 'saleq')}, {r6('income', 'niq')} FROM quarters
      QUALIFY row_number() OVER (PARTITION BY sid ORDER BY datadate DESC) <= 4"""

    event_columns = (
        "event_id, security_id, company_id, ticker_as_of_event, crash_date, "
        + doubles("crash_return", "crash_close", "crash_volume")
        + ", in_universe_at_event, passes_min_price"
    )
    q["crash_events"] = f"SELECT {event_columns} FROM ev"
    q["clean_pool"] = f"SELECT {event_columns} FROM clean"
    q["event_summary"] = """SELECT count(*) AS events, count(DISTINCT security_id) AS securities, min(crash_date) AS date_min,
      max(crash_date) AS date_max, count(*) FILTER (in_universe_at_event) AS in_universe,
      count(*) FILTER (passes_min_price) AS pass_min_price,
      count(*) FILTER (in_universe_at_event AND passes_min_price) AS clean,
      count(*) FILTER (crash_close IS NULL) AS null_crash_close FROM ev"""
    q["consecutive_events"] = """SELECT event_id, security_id, crash_date, gap::INTEGER AS gap FROM (
      SELECT *, crash_date - lag(crash_date) OVER (PARTITION BY security_id ORDER BY crash_date) AS gap FROM ev) WHERE gap = 1"""

    q["price_features"] = f"SELECT event_id, security_id, crash_date, {doubles(*PRICE_FEATURES)} FROM pf"
    q["recent_features"] = f"SELECT event_id, security_id, crash_date, {doubles(*RECENT_FEATURES)} FROM rf"
    q["prior_count_hist"] = """SELECT prior_crash_count_20d, count(*) AS n FROM rf GROUP BY 1"""
    q["recent_summary"] = f"""SELECT count(*) AS events, count(*) FILTER (prior_crash_count_60d = 0) AS fresh,
      {r6('avg((prior_crash_count_60d = 0)::INT)', 'fresh_share')} FROM rf"""
    q["market_features"] = f"""SELECT date, {doubles('market_return_1d', 'market_return_5d', 'market_return_20d',
      'market_volatility_20d')} FROM market"""
    q["sector_features"] = f"SELECT event_id, {doubles(*MARKET_FEATURES)} FROM mf"
    label_doubles = [c for h in HORIZONS for c in (f"return_{h}d", f"max_rebound_{h}d", f"max_drawdown_{h}d")]
    q["labels_grid"] = f"""SELECT * REPLACE ({", ".join(r6(c, c) for c in ["crash_close", *label_doubles])}) FROM lb"""
    q["labels_base_rate"] = """SELECT count(*) AS events, count(*) FILTER (pool) AS clean_events, """ + ", ".join(
        f"count(*) FILTER (censored_{h}d) AS censored_{h}d" for h in HORIZONS
    ) + f""", count(hit) AS determined, {r6('avg(hit)', 'base_rate')}, count(hit) FILTER (pool) AS clean_determined,
      {r6('avg(hit) FILTER (pool)', 'clean_base_rate')} FROM (
        SELECT lb.*, coalesce(in_universe_at_event AND passes_min_price, false) AS pool,
          CASE WHEN NOT censored_20d THEN hit_10pct_20d END AS hit FROM lb LEFT JOIN ev USING (event_id))"""

    trailing = "revenue_ttm ni_ttm gross_profit_ttm operating_income_ttm ebitda_ttm interest_ttm".split()
    growth = ["revenue_growth_yoy", "revenue_growth_qoq", "eps_growth_yoy"]
    q["fund_enriched"] = f"SELECT {unrestated}, {doubles(*trailing, *growth)} FROM fe"
    q["company_link"] = f"SELECT event_id, security_id, crash_date, {r6('crash_close', 'crash_close')}, company_id FROM linked"
    fund_columns = doubles(*FUNDAMENTAL_RATIOS) + ", " + ", ".join(FUNDAMENTAL_META)
    q["fundamental_features"] = f"SELECT event_id, {fund_columns} FROM ff"
    q["fundamental_summary"] = """SELECT count(*) AS rows, """ + ", ".join(
        [
            r6("avg(fundamentals_available::INT)", "available"),
            r6("avg(fundamentals_available::INT) FILTER (in_universe_at_event AND passes_min_price)", "available_clean"),
            r6("avg(fundamentals_stale::INT) FILTER (fundamentals_available)", "stale"),
        ]
        + [
            r6(f"avg(({c} IS NOT NULL)::INT) FILTER (in_universe_at_event AND passes_min_price)", f"{c}_present")
            for c in ("net_margin", "roe", "debt_to_assets", "revenue_growth_yoy", "pe", "ev_to_ebitda")
        ]
    ) + " FROM ff JOIN ev USING (event_id)"
    q["ebitda_margin"] = f"SELECT event_id, {r6('ebitda_margin', 'ebitda_margin')} FROM em"
    q["event_beta"] = f"SELECT event_id, {r6('beta', 'beta')} FROM bt"
    for h in (5, 60, 252):
        q[f"forward_return_{h}"] = f"""SELECT event_id, security_id, crash_date, {r6('ret', 'ret')} FROM seen WHERE h = {h}"""
    q["base_rate_regimes"] = _stats(
        " UNION ALL ".join(
            f"SELECT '{name}' AS regime, ret FROM seen WHERE h = {h}" + (f" AND crash_date >= DATE '{since}'" if since else "")
            for name, h, since in REGIMES
        ),
        "regime",
    )
    q["base_rate_tails"] = f"""SELECT count(*) AS events, count(*) FILTER (censored) AS censored, count(r) AS observed,
      {r6('avg((r > 0)::INT)', 'p_positive')}, {r6('avg((r >= 0.10)::INT)', 'p_up_10')},
      {r6('avg((r <= -0.50)::INT)', 'p_down_50')}, {r6('avg(r)', 'mean')}, {r6('quantile_cont(r, 0.5)', 'median')}
      FROM (SELECT censored, CASE WHEN NOT censored AND NOT isnan(ret) THEN ret END AS r FROM fwd WHERE h = 252)"""

    exact = set(LONG_COLUMNS) | set(FUNDAMENTAL_META) | set(HIT_COLUMNS)
    rounded = [c for c in ("crash_close", *FEATURE_COLUMNS, *OUTCOME_COLUMNS) if c not in exact]
    q["event_dataset"] = f"SELECT * REPLACE ({', '.join(r6(c, c) for c in rounded)}) FROM ds"
    hit_tests = " + ".join(f"count(*) FILTER ({c} NOT IN (0, 1))" for c in HIT_COLUMNS)
    q["dataset_validation"] = f"""SELECT count(*) AS rows, count(DISTINCT event_id) AS unique_events,
      count(*) - count(DISTINCT event_id) AS duplicate_rows, {len(FEATURE_COLUMNS)}::BIGINT AS n_features,
      {len(OUTCOME_COLUMNS)}::BIGINT AS n_outcomes, 0::BIGINT AS n_overlapping, '' AS missing_columns,
      {r6('max(crash_return)', 'max_crash_return')}, max(crash_return) <= -0.1 + 1e-9 AS returns_within_threshold,
      ({hit_tests})::BIGINT AS non_binary_hits FROM ds"""
    q["feature_missingness"] = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r6(f'avg(({c} IS NULL)::INT)', 'missing')} FROM dc" for c in FEATURE_COLUMNS
    )
    target = "hit_10pct_20d"
    q["overall_rate"] = _wilson(f"SELECT coalesce(sum({target}), 0) AS hits, count({target}) AS n FROM dc")
    q["recovery_grid"] = _wilson(
        " UNION ALL ".join(
            f"SELECT {p} AS threshold_pct, {h} AS horizon, coalesce(sum(hit_{p}pct_{h}d), 0) AS hits, count(hit_{p}pct_{h}d) AS n FROM dc"
            for p, _ in THRESHOLDS
            for h in HORIZONS
        ),
        "threshold_pct, horizon",
    )
    for name, code in _SLICES.items():
        labels = ", ".join(f"'{x}'" for x in _SLICE_LABELS[name])
        inner = _wilson(
            f"SELECT code, sum({target}) AS hits, count(*) AS n FROM (SELECT {code} AS code, {target} FROM dc) "
            f"WHERE code IS NOT NULL AND {target} IS NOT NULL GROUP BY 1",
            "code",
        )
        q[f"grouped_rate_{name}"] = f"SELECT *, [{labels}][code + 1] AS label FROM ({inner})"
    q["grouped_rate_sector"] = _wilson(
        f"""SELECT sector, sum({target}) AS hits, count(*) AS n FROM (
          SELECT {target}, {_sic_division('sic')} AS sector FROM dc JOIN (
            SELECT security_id, arg_min(sic_code, ticker_start) FILTER (sic_code IS NOT NULL) AS sic FROM master GROUP BY 1)
          USING (security_id)) WHERE {target} IS NOT NULL GROUP BY 1""",
        "sector",
    )
    q["headline_rates"] = _wilson(
        " UNION ALL ".join(
            f"SELECT '{k}' AS headline, sum({target}) AS hits, count(*) AS n FROM dc WHERE {t} AND {target} IS NOT NULL HAVING count(*) > 0"
            for k, t in _HEADLINES.items()
        ),
        "headline",
    )
    q["quantile_buckets"] = """SELECT bucket, count(*) AS n FROM (
        SELECT CASE WHEN v IS NOT NULL THEN 'vol' || (1 + (v > b[1])::INT + (v > b[2])::INT + (v > b[3])::INT + (v > b[4])::INT) END
          AS bucket
        FROM (SELECT volatility_20d AS v FROM pf)
        CROSS JOIN (SELECT quantile_cont(volatility_20d, [0.2, 0.4, 0.6, 0.8]) AS b FROM pf))
      GROUP BY 1"""
    full, recent = _full_buckets(), _recent_buckets()
    q["bucket_outcomes_full"] = _stats(
        _bucketed(full, 252, None) + " UNION ALL " + _bucketed(_severity(full, "_60d"), 60, None), "bucket"
    )
    q["bucket_outcomes_recent"] = _stats(
        _bucketed(recent, 252, RECENT_START) + " UNION ALL " + _bucketed(_severity(recent, "_60d"), 60, RECENT_START), "bucket"
    )
    q["bucket_outcomes_5d"] = _stats(_bucketed(recent, 5, None), "bucket")
    for name, h in (("one_year", 252), ("sixty_day", 60), ("one_week", 5)):
        q[f"return_histogram_{name}"] = _histogram(f"SELECT ret FROM seen WHERE h = {h}", h)
    q["bucket_histograms_full"] = _histogram(_bucketed(full, 252, None), 252, "bucket")
    q["bucket_histograms_recent"] = (
        _histogram(_bucketed(recent, 252, RECENT_START), 252, "bucket")
        + " UNION ALL "
        + _histogram(_bucketed(_severity(recent, "_60d"), 60, RECENT_START), 60, "bucket")
    )
    q["bucket_histograms_5d"] = _histogram(_bucketed(recent, 5, None), 5, "bucket")
    q["severity_returns_60d"] = _stats(
        " UNION ALL ".join(
            f"SELECT '{k}' AS bucket, s.ret FROM seen s JOIN ev e USING (event_id) WHERE s.h = 60 AND {t}"
            for k, t in _severity(full, "").items()
        ),
        "bucket",
    )
    return {name: _with(body) for name, body in q.items()}
