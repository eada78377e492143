"""SQL building blocks of the oracles: common table expressions over the panel."""

from __future__ import annotations

from ..operators.features import QUALITY_DEDUCTIONS
from ..sources.panel import SQL as PANEL

PRICE = """
pf0 AS (SELECT *, row_number() OVER w AS n, lag(adjusted_close, 1) OVER w AS l1, lag(adjusted_close, 3) OVER w AS l3, lag(adjusted_close, 7) OVER w AS l7,
          lag(adjusted_close, 13) OVER w AS l13, lag(adjusted_close, 60) OVER w AS l60,
          count(monthly_return) OVER w12 AS c12, stddev_samp(monthly_return) OVER w12 AS s12, count(monthly_return) OVER w3 AS c3, stddev_samp(monthly_return) OVER w3 AS s3,
          count(CASE WHEN monthly_return < 0 THEN 1 END) OVER w12 AS cn, stddev_samp(CASE WHEN monthly_return < 0 THEN monthly_return END) OVER w12 AS sn,
          max(adjusted_close) OVER w13 AS hi, avg(volume) OVER wv AS usual
        FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY date), w12 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
          w3 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w13 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW),
          wv AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
cm AS (SELECT p.ticker, p.date, CASE WHEN p.monthly_return IS NOT NULL AND b.monthly_return IS NOT NULL THEN p.monthly_return END AS y,
          CASE WHEN p.monthly_return IS NOT NULL AND b.monthly_return IS NOT NULL THEN b.monthly_return END AS x FROM prices p JOIN bench b ON p.date = b.date),
bt AS (SELECT ticker, date, CASE WHEN count(*) OVER w >= 12 AND count(y) OVER w >= 12 AND var_samp(x) OVER w <> 0 THEN covar_samp(y, x) OVER w / var_samp(x) OVER w END AS beta
       FROM cm WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
pf AS (SELECT f.ticker, f.date, adjusted_close, l1 / l7 - 1 AS six_month_momentum, l1 / l13 - 1 AS twelve_month_momentum, adjusted_close / l1 - 1 AS return_1m, adjusted_close / l3 - 1 AS return_3m,
          adjusted_close / l60 - 1 AS five_year_price_gain, CASE WHEN n >= 13 AND c12 >= 3 THEN s12 * sqrt(12) END AS volatility_12m, CASE WHEN n >= 4 AND c3 >= 3 THEN s3 * sqrt(12) END AS volatility_3m,
          CASE WHEN n >= 13 AND cn >= 3 THEN sn * sqrt(12) END AS downside_volatility_12m, CASE WHEN n >= 13 THEN (adjusted_close - hi) / hi END AS drawdown_from_52w_high,
          CASE WHEN n >= 13 AND usual > 0 THEN volume / usual END AS abnormal_volume, beta FROM pf0 f LEFT JOIN bt ON f.ticker = bt.ticker AND f.date = bt.date)
"""

REPORTS = """
kn AS (SELECT a.ticker, a.report_date AS known_from, f.report_date, f.fiscal_date, f.eps, f.revenue, f.net_income, f.free_cash_flow, f.roe, f.debt_to_equity, f.operating_margin, f.equity,
          row_number() OVER (PARTITION BY a.ticker, a.report_date ORDER BY f.fiscal_date DESC) AS rn, count(*) OVER (PARTITION BY a.ticker, a.report_date) AS n_known
       FROM (SELECT DISTINCT ticker, report_date FROM funds) a JOIN funds f ON f.ticker = a.ticker AND f.report_date <= a.report_date),
kw AS (SELECT *, sum(eps) OVER (PARTITION BY ticker, known_from ORDER BY rn ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s4 FROM kn),
rp AS (SELECT ticker, known_from, any_value(n_known) AS n_known, max(report_date) AS last_report,
          CASE WHEN count(eps) FILTER (rn <= 4) = 4 THEN sum(eps) FILTER (rn <= 4) END AS ttm_eps, CASE WHEN count(revenue) FILTER (rn <= 4) = 4 THEN sum(revenue) FILTER (rn <= 4) END AS ttm_revenue,
          CASE WHEN count(net_income) FILTER (rn <= 4) = 4 THEN sum(net_income) FILTER (rn <= 4) END AS ttm_net_income, CASE WHEN count(free_cash_flow) FILTER (rn <= 4) = 4 THEN sum(free_cash_flow) FILTER (rn <= 4) END AS ttm_free_cash_flow,
          max(roe) FILTER (rn = 1) AS roe, max(debt_to_equity) FILTER (rn = 1) AS debt_to_equity, max(operating_margin) FILTER (rn = 1) AS operating_margin, max(equity) FILTER (rn = 1) AS equity,
          max(eps) FILTER (rn = 1) AS e0, max(eps) FILTER (rn = 5) AS e4, max(eps) FILTER (rn = 9) AS e8, max(revenue) FILTER (rn = 1) AS r0, max(revenue) FILTER (rn = 5) AS r4, max(revenue) FILTER (rn = 9) AS r8,
          list(s4 ORDER BY rn) FILTER (rn <= n_known - 3 AND s4 > 0) AS sums, list(struct_pack(f := fiscal_date, e := eps, r := revenue) ORDER BY rn) AS q FROM kw GROUP BY ticker, known_from),
rf AS (SELECT *, (e0 - e4) / abs(e4) - (e4 - e8) / abs(e8) AS eps_growth_acceleration, CASE WHEN r4 > 0 AND r8 > 0 THEN (r0 / r4 - 1) - (r4 / r8 - 1) END AS revenue_growth_acceleration FROM rp)
"""

FEATURES = """
sp AS (SELECT s.ticker, s.sector, s.shares_outstanding_m, b.date AS feature_date FROM stocks s CROSS JOIN bench b),
sq AS (SELECT sp.ticker, sp.sector, sp.shares_outstanding_m, sp.feature_date, pf.* EXCLUDE (ticker, date) FROM sp ASOF LEFT JOIN pf ON sp.ticker = pf.ticker AND sp.feature_date >= pf.date),
sk AS (SELECT sq.*, rf.* EXCLUDE (ticker), list_filter(q, lambda v: v.f BETWEEN (feature_date - INTERVAL 66 MONTH)::DATE AND (feature_date - INTERVAL 54 MONTH)::DATE)[1:4] AS old
       FROM sq ASOF LEFT JOIN rf ON sq.ticker = rf.ticker AND sq.feature_date >= rf.known_from),
sm AS (SELECT *, CASE WHEN ttm_eps > 0 AND adjusted_close / ttm_eps <= 500 THEN adjusted_close / ttm_eps END AS current_pe_ratio, adjusted_close * shares_outstanding_m AS market_cap,
          list_sum(list_transform(old, lambda v: v.e)) AS old_eps, list_sum(list_transform(old, lambda v: v.r)) AS old_revenue, list_transform(sums[1:20], lambda s: adjusted_close / s) AS ratios FROM sk),
feat AS (SELECT feature_date, ticker, sector, adjusted_close, six_month_momentum, twelve_month_momentum, return_1m, return_3m, five_year_price_gain, volatility_12m, volatility_3m, downside_volatility_12m,
          drawdown_from_52w_high, abnormal_volume, beta, current_pe_ratio, CASE WHEN n_known >= 8 AND len(ratios) >= 4 THEN current_pe_ratio / list_aggregate(ratios, 'median') - 1 END AS pe_vs_historical_median,
          CASE WHEN len(old) > 0 AND old_eps > 0 AND ttm_eps > 0 THEN pow(ttm_eps / old_eps, 0.2::DOUBLE) - 1 END AS five_year_eps_growth,
          CASE WHEN len(old) > 0 AND old_revenue > 0 AND ttm_revenue > 0 THEN pow(ttm_revenue / old_revenue, 0.2::DOUBLE) - 1 END AS five_year_revenue_growth, roe, debt_to_equity, operating_margin, market_cap,
          ttm_free_cash_flow / market_cap AS free_cash_flow_yield, market_cap / ttm_revenue AS price_to_sales, market_cap / equity AS price_to_book, eps_growth_acceleration, revenue_growth_acceleration,
          greatest(date_diff('day', last_report, feature_date), 0) AS staleness_days FROM sm)
"""

FEATURE_NAMES = (
    "six_month_momentum twelve_month_momentum return_1m return_3m five_year_price_gain volatility_12m volatility_3m downside_volatility_12m drawdown_from_52w_high abnormal_volume beta "
    "current_pe_ratio pe_vs_historical_median five_year_eps_growth five_year_revenue_growth roe debt_to_equity operating_margin market_cap free_cash_flow_yield price_to_sales price_to_book eps_growth_acceleration revenue_growth_acceleration"
).split()

_W = "OVER (PARTITION BY feature_date, sector)"
RELATIVE = f"""
rel AS (SELECT *, CASE WHEN median(current_pe_ratio) {_W} > 0 THEN current_pe_ratio / median(current_pe_ratio) {_W} - 1 END AS sector_relative_pe,
          CASE WHEN median(price_to_sales) {_W} > 0 THEN price_to_sales / median(price_to_sales) {_W} - 1 END AS sector_relative_ps,
          twelve_month_momentum - median(twelve_month_momentum) {_W} AS sector_relative_momentum,
          CASE WHEN count(free_cash_flow_yield) {_W} >= 3 THEN free_cash_flow_yield - median(free_cash_flow_yield) {_W} END AS sector_relative_fcf_yield,
          CASE WHEN count(twelve_month_momentum) {_W} >= 3 AND stddev_samp(twelve_month_momentum) {_W} > 0 THEN (twelve_month_momentum - avg(twelve_month_momentum) {_W}) / stddev_samp(twelve_month_momentum) {_W} END AS peer_momentum_zscore,
          CASE WHEN count(current_pe_ratio) {_W} >= 3 AND stddev_samp(current_pe_ratio) {_W} > 0 THEN (current_pe_ratio - avg(current_pe_ratio) {_W}) / stddev_samp(current_pe_ratio) {_W} END AS peer_valuation_zscore FROM feat)
"""
_points = " + ".join([f"CASE WHEN {c} IS NULL THEN {k} ELSE 0 END" if c in FEATURE_NAMES else str(k) for c, k in QUALITY_DEDUCTIONS.items()])
QUALITY = f"""
dq AS (SELECT *, greatest(100.0::DOUBLE - ({_points}) - CASE WHEN staleness_days IS NULL THEN 20 WHEN staleness_days > 180 THEN 10 WHEN staleness_days > 90 THEN 5 ELSE 0 END, 0.0::DOUBLE) AS data_quality_score FROM rel)
"""


def near(key: str, at: str, alias: str, source: str, on: str) -> str:
    """The value nearest to a date within 15 days; ties go to the later date."""
    return f"""{alias} AS (SELECT k.{key}, k.{at}, arg_max(h.adjusted_close, [-abs(date_diff('day', k.{at}, h.date)), date_diff('day', DATE '1970-01-01', h.date)]) AS v
       FROM (SELECT DISTINCT {key}, {at} FROM asked) k JOIN {source} h ON {on} AND h.date BETWEEN k.{at} - 15 AND k.{at} + 15 GROUP BY 1, 2)"""


TARGETS = f"""
asked AS (SELECT feature_date, ticker, last_day(feature_date + INTERVAL 12 MONTH)::DATE AS target_date, 1 AS m FROM (SELECT s.ticker, b.date AS feature_date FROM stocks s CROSS JOIN bench b)),
{near("ticker", "feature_date", "p0", "prices", "h.ticker = k.ticker")}, {near("ticker", "target_date", "p1", "prices", "h.ticker = k.ticker")},
{near("m", "feature_date", "b0", "bench", "true")}, {near("m", "target_date", "b1", "bench", "true")},
tg0 AS (SELECT a.feature_date, a.ticker, a.target_date, p1.v / p0.v - 1 AS stock_return, b1.v / b0.v - 1 AS benchmark_return FROM asked a
       LEFT JOIN p0 ON p0.ticker = a.ticker AND p0.feature_date = a.feature_date LEFT JOIN p1 ON p1.ticker = a.ticker AND p1.target_date = a.target_date
       LEFT JOIN b0 ON b0.feature_date = a.feature_date LEFT JOIN b1 ON b1.target_date = a.target_date),
tg AS (SELECT *, stock_return - benchmark_return AS excess_return, CASE WHEN stock_return - benchmark_return IS NOT NULL THEN (stock_return - benchmark_return > 0)::INT END AS winner FROM tg0)
"""

IC_FEATURES = FEATURE_NAMES
LONG = (
    "lf AS (SELECT feature, feature_date, ticker, x, y FROM (SELECT feature_date, ticker, excess_return AS y, "
    + ", ".join(IC_FEATURES)
    + " FROM feat JOIN tg USING (feature_date, ticker)) UNPIVOT INCLUDE NULLS (x FOR feature IN ("
    + ", ".join(IC_FEATURES)
    + ")) WHERE x IS NOT NULL AND y IS NOT NULL)"
)


def rank(c: str, by: str) -> str:
    return f"(CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {by} ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0::DOUBLE END)"


def score(c: str, inverse: bool = False) -> str:
    s = f"coalesce({rank(c, 'feature_date')} / count({c}) OVER (PARTITION BY feature_date) * 100, 50.0::DOUBLE)"
    return f"(100 - {s})" if inverse else s


def mean_score(names: tuple, inverse: tuple = ()) -> str:
    use = [c for c in (*names, *inverse) if c in FEATURE_NAMES or c.startswith("sector_relative")]
    ok = {c: f"count({c}) OVER (PARTITION BY feature_date) >= 3" for c in use}
    n = " + ".join(f"({o})::INT" for o in ok.values())
    total = " + ".join(f"CASE WHEN {ok[c]} THEN {score(c, c in inverse)} ELSE 0.0::DOUBLE END" for c in use)
    return f"CASE WHEN ({n}) > 0 THEN ({total}) / ({n}) ELSE 50.0::DOUBLE END"


IC = f"""
rk AS (SELECT *, {rank("x", "feature, feature_date")} AS rx, {rank("y", "feature, feature_date")} AS ry FROM lf),
ic AS (SELECT feature, feature_date, count(*) AS n, corr(rx, ry) AS ic FROM rk GROUP BY 1, 2 HAVING count(*) >= 5 AND corr(rx, ry) IS NOT NULL AND NOT isnan(corr(rx, ry)))
"""

SCORES = f"""
sc0 AS (SELECT *, 50.0::DOUBLE AS probability_score, 50.0::DOUBLE AS excess_score, 50.0::DOUBLE AS agreement_score, 100 - {mean_score(("volatility_12m", "downside_volatility_12m", "beta"))} AS risk_score,
          {mean_score((), ("sector_relative_pe", "pe_vs_historical_median", "current_pe_ratio"))} AS valuation_score, {mean_score(("twelve_month_momentum", "six_month_momentum", "return_3m"))} AS momentum_score,
          {mean_score(("roe", "operating_margin", "free_cash_flow_yield", "five_year_eps_growth", "five_year_revenue_growth"), ("debt_to_equity",))} AS fundamental_score FROM dq),
sc1 AS (SELECT *, round((data_quality_score * 0.10::DOUBLE + probability_score * 0.35::DOUBLE + excess_score * 0.25::DOUBLE + agreement_score * 0.15::DOUBLE + risk_score * 0.10::DOUBLE + valuation_score * 0.05::DOUBLE) * 1e8)::BIGINT AS units FROM sc0),
sc AS (SELECT * EXCLUDE (units), (units // 1000000 + (2 * (units % 1000000) > 1000000 OR (2 * (units % 1000000) = 1000000 AND (units // 1000000) % 2 <> 0))::BIGINT) / 100.0::DOUBLE AS final_score FROM sc1),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature_date ORDER BY final_score DESC, ticker) AS place FROM sc WHERE data_quality_score >= 20) WHERE place <= 5)
"""

SIM = """
cal AS (SELECT date, lead(date) OVER (ORDER BY date) AS next_date, row_number() OVER (ORDER BY date) - 1 AS i FROM bench),
sm1 AS (SELECT c.date, c.next_date, avg(p.monthly_return) AS portfolio_return, count(p.monthly_return) AS n_held, any_value(c.i) AS i
        FROM pk JOIN cal c ON pk.feature_date = c.date LEFT JOIN prices p ON p.ticker = pk.ticker AND p.date = c.next_date GROUP BY 1, 2),
sim AS (SELECT s.date, s.next_date, n_held, portfolio_return, b.monthly_return AS benchmark_return, portfolio_return - b.monthly_return AS excess_return, (portfolio_return - b.monthly_return > 0)::INT AS hit
        FROM sm1 s JOIN bench b ON b.date = s.next_date WHERE i >= 24 AND portfolio_return IS NOT NULL)
"""


def query(*blocks: str, select: str) -> str:
    return "WITH " + ",\n".join(b.strip() for b in (PANEL, *blocks)) + "\n" + select


#: Means of cents often end in a 5 behind the last kept digit: both sides round these to 8 digits first, so that ties are exact.
AMOUNTS = ("adjusted_close", "market_cap")


def rounded(keys: str, doubles: list[str], source: str, digits: int = 6) -> str:
    return f"SELECT {keys}, " + ", ".join(f"round({c}::DECIMAL(38, 8), {digits})::DOUBLE AS {c}" if c in AMOUNTS else f"round({c}, {digits}) AS {c}" for c in doubles) + f" FROM {source}"
