"""Queries of simulation, risk and attribution; importing this registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import attribution, risk, simulation
from .queries import BENCH, INDEX, query
from .sources import views as v



def _sim_sql(close: bool, drift: str, alternative: bool = False) -> str:
    """The same closed form, in SQL: segments, masses, sums by date; gaps of what is held are carried."""
    seg = "coalesce(max(a.ad) FILTER (a.ad < d.business_date), max(a.ad) FILTER (a.ad <= d.business_date))" if close else "max(a.ad) FILTER (a.ad <= d.business_date)"
    mass = {
        "price": "w * product(1 + price_return) OVER s",
        "relative": "w * market_cap / first_value(cap_before) OVER s",
        "cap": "CASE WHEN w > 0 THEN market_cap ELSE 0 END",
    }[drift]
    total = (lambda x: f"sum(mb * (1 + price_return)) / sum(mb) / (1 - sum(mb * {x}) / sum(mb))") if not alternative else (lambda x: f"sum(mb * (1 + price_return)) / sum(mb) + sum(mb * {x}) / sum(mb)")
    return _TARGETS.replace("{seg}", seg) + f""",
hd AS (SELECT portfolio, segment, instrument_id, business_date, w, price_return, gross_dividend, net_dividend, {mass} AS m
       FROM sg JOIN tg ON effective_date = segment JOIN ob USING (instrument_id, business_date) WINDOW s AS (PARTITION BY portfolio, segment, instrument_id ORDER BY business_date)),
he AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY portfolio, segment, instrument_id ORDER BY business_date), w) AS mb FROM hd),
fa AS (SELECT portfolio, business_date, sum(mb * (1 + price_return)) / sum(mb) AS price, {total("gross_dividend")} AS gross_total, {total("net_dividend")} AS net_total FROM he GROUP BY 1, 2),
wt AS (SELECT *, mb / sum(mb) OVER (PARTITION BY portfolio, business_date) AS ow, m / sum(m) OVER (PARTITION BY portfolio, business_date) AS cw FROM he) """


#: Segments, targets and observations; a date without one of an instrument has returns of 0 and the last cap.
_TARGETS = """WITH ap AS (SELECT DISTINCT effective_date AS ad FROM constituents), dy AS (SELECT DISTINCT business_date FROM panel),
sg AS (SELECT d.business_date, {seg} AS segment FROM dy d, ap a GROUP BY 1),
st AS (SELECT effective_date, instrument_id, unnest(['index', 'benchmark']) AS portfolio, unnest([index_weight, benchmark_weight]) AS w FROM constituents),
tg AS (SELECT effective_date, instrument_id, portfolio, w / sum(w) OVER (PARTITION BY portfolio, effective_date) AS w FROM st),
gr AS (SELECT instrument_id, business_date FROM (SELECT instrument_id, min(business_date) AS since FROM panel GROUP BY 1) JOIN dy ON business_date >= since),
og AS (SELECT instrument_id, business_date, coalesce(price_return, 0) AS price_return, coalesce(gross_dividend, 0) AS gross_dividend, coalesce(net_dividend, 0) AS net_dividend,
       last_value(market_cap IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY business_date) AS market_cap FROM gr LEFT JOIN panel USING (instrument_id, business_date)),
ob AS (SELECT *, lag(market_cap) OVER (PARTITION BY instrument_id ORDER BY business_date) AS cap_before FROM og)"""

#: A plain loop over days: weights of the day before, moved by its returns and made to sum to 1 again.
_LOOP = "WITH RECURSIVE " + _TARGETS.replace("{seg}", "max(a.ad) FILTER (a.ad <= d.business_date)")[5:] + """,
dn AS (SELECT business_date, segment, row_number() OVER (PARTITION BY segment ORDER BY business_date) AS n FROM sg WHERE segment IS NOT NULL),
lp AS (SELECT portfolio, effective_date AS segment, instrument_id, CAST(1 AS BIGINT) AS n, w FROM tg
       UNION ALL
       SELECT l.portfolio, l.segment, l.instrument_id, l.n + 1, l.w * (1 + price_return) / sum(l.w * (1 + price_return)) OVER (PARTITION BY l.portfolio, l.segment)
       FROM lp l JOIN dn USING (segment, n) JOIN ob USING (instrument_id, business_date)),
fa AS (SELECT portfolio, business_date, 1 + sum(w * price_return) AS price, (1 + sum(w * price_return)) / (1 - sum(w * gross_dividend)) AS gross_total, (1 + sum(w * price_return)) / (1 - sum(w * net_dividend)) AS net_total
       FROM lp JOIN dn USING (segment, n) JOIN ob USING (instrument_id, business_date) GROUP BY 1, 2) """


_DAILY = (
    ", wd AS (SELECT business_date, " + ", ".join(f"max({k}) FILTER (portfolio = '{p}') AS {p}_{k}" for p in ("index", "benchmark") for k in simulation.KINDS) + " FROM fa GROUP BY 1) SELECT business_date, "
    + ", ".join(f"{p}_{k} - 1 AS {p}_{k}_return, 100 * product({p}_{k}) OVER (ORDER BY business_date) AS {p}_{k}_level" for p in ("index", "benchmark") for k in simulation.KINDS)
    + ", " + ", ".join(f"index_{k} - benchmark_{k} AS active_{k}_return" for k in simulation.KINDS) + " FROM wd"
)
_OLD_NEW = """, sq AS (SELECT segment, max(business_date) AS business_date, lead(segment) OVER (ORDER BY segment) AS nxt FROM he GROUP BY 1),
ol AS (SELECT portfolio, nxt AS applied_date, instrument_id, cw AS pre FROM wt JOIN sq USING (segment, business_date) WHERE nxt IS NOT NULL),
nw AS (SELECT DISTINCT portfolio, segment AS applied_date, instrument_id, w AS tgt FROM wt WHERE segment > (SELECT min(segment) FROM wt)),
bn AS (SELECT portfolio, applied_date, instrument_id, coalesce(pre, 0) AS pre, coalesce(tgt, 0) AS tgt FROM ol FULL JOIN nw USING (portfolio, applied_date, instrument_id)) """


def _held(spark: SparkSession, sf: str, phase=simulation.Phase.OPEN, drift=simulation.Drift.PRICE) -> DataFrame:
    return simulation.held(v.panel(spark, sf), simulation.both_portfolios(v.constituents(spark, sf)), phase, drift=drift, gaps=simulation.Gaps.CARRY)


@query("constituents", sql=_LOOP + _DAILY)
def simulation_daily(spark: SparkSession, sf: str) -> DataFrame:
    return simulation.daily(_held(spark, sf))


@query("constituents", sql=_sim_sql(True, "price", True) + _DAILY)
def simulation_daily_close(spark: SparkSession, sf: str) -> DataFrame:
    return simulation.daily(_held(spark, sf, simulation.Phase.CLOSE), simulation.Dividends.ALTERNATIVE)


@query("constituents", sql=_sim_sql(False, "relative") + _DAILY)
def simulation_daily_relative_cap(spark: SparkSession, sf: str) -> DataFrame:
    return simulation.daily(_held(spark, sf, drift=simulation.Drift.RELATIVE_CAP))


@query("constituents", sql=_sim_sql(False, "cap") + _DAILY)
def simulation_daily_cap(spark: SparkSession, sf: str) -> DataFrame:
    return simulation.daily(_held(spark, sf, drift=simulation.Drift.CAP))


@query("constituents", sql=_sim_sql(False, "price") + "SELECT business_date, instrument_id, " + ", ".join(f"coalesce(max({c}) FILTER (portfolio = '{p}'), 0) AS {p}_{s}_weight" for p in ("index", "benchmark") for s, c in (("opening", "ow"), ("closing", "cw"))) + " FROM wt GROUP BY 1, 2")
def simulation_holdings(spark: SparkSession, sf: str) -> DataFrame:
    return simulation.holdings(_held(spark, sf))


_REBALANCES = _OLD_NEW + """, tv AS (SELECT applied_date, 0.5 * sum(abs(tgt - pre)) FILTER (portfolio = 'index') AS index_turnover, 0.5 * sum(abs(tgt - pre)) FILTER (portfolio = 'benchmark') AS benchmark_turnover FROM bn GROUP BY 1),
ct AS (SELECT segment AS scheduled_effective_date, segment AS applied_date, count(DISTINCT instrument_id) AS instrument_count FROM wt GROUP BY 1)
SELECT scheduled_effective_date, applied_date, instrument_count, index_turnover, benchmark_turnover FROM ct LEFT JOIN tv USING (applied_date)"""  # fmt: skip


@query("constituents", sql=_sim_sql(False, "price") + _REBALANCES)
def simulation_rebalances(spark: SparkSession, sf: str) -> DataFrame:
    return simulation.rebalances(_held(spark, sf))


@query("constituents", sql=_sim_sql(True, "price") + _REBALANCES)
def simulation_rebalances_close(spark: SparkSession, sf: str) -> DataFrame:
    return simulation.rebalances(_held(spark, sf, simulation.Phase.CLOSE))


@query("constituents", sql=_sim_sql(False, "price") + _OLD_NEW + """, lg AS (SELECT portfolio, applied_date, instrument_id, unnest(['pre_rebalance', 'target']) AS snapshot, unnest([pre, tgt]) AS x FROM bn
 UNION ALL SELECT portfolio, segment, instrument_id, 'end_of_day', cw FROM wt WHERE business_date = segment)
SELECT applied_date, snapshot, instrument_id, coalesce(max(x) FILTER (portfolio = 'index'), 0) AS index_weight, coalesce(max(x) FILTER (portfolio = 'benchmark'), 0) AS benchmark_weight FROM lg GROUP BY 1, 2, 3""")  # fmt: skip
def simulation_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return simulation.snapshots(_held(spark, sf))


@query("constituents", sql="""WITH w AS (SELECT instrument_id, index_weight / sum(index_weight) OVER () AS w FROM constituents WHERE effective_date = (SELECT min(effective_date) FROM constituents)),
f AS (SELECT business_date, sum(w * (1 + price_return)) / sum(w) AS p, sum(w * gross_dividend) / sum(w) AS g, sum(w * net_dividend) / sum(w) AS n FROM panel JOIN w USING (instrument_id) GROUP BY 1)
SELECT business_date, p AS price, p / (1 - g) AS gross_total, p / (1 - n) AS net_total FROM f""")  # fmt: skip
def fixed_weight_returns(spark: SparkSession, sf: str) -> DataFrame:
    panel, cons = v.panel(spark, sf), v.constituents(spark, sf)
    first = F.broadcast(cons.agg(F.min("effective_date").alias("__d")))
    w = cons.join(first, F.col("effective_date") == F.col("__d")).select("instrument_id", F.col("index_weight").alias("weight"))
    return simulation.fixed_weight_returns(panel, w)


@query("constituents", sql=_sim_sql(False, "price") + """, lv AS (SELECT business_date, net_total - 1 AS r, 100 * product(net_total) OVER (ORDER BY business_date) AS l FROM fa WHERE portfolio = 'index'), fr AS (SELECT * FROM lv WHERE business_date >= DATE '1998-06-01')
SELECT business_date, r AS index_net_total_return, l * 100 * (1 + first_value(r) OVER (ORDER BY business_date)) / first_value(l) OVER (ORDER BY business_date) AS index_net_total_level FROM fr""")  # fmt: skip
def simulation_rebased(spark: SparkSession, sf: str) -> DataFrame:
    return simulation.rebased(simulation.daily(_held(spark, sf)).select("business_date", INDEX, "index_net_total_level"), "1998-06-01")


# -- risk ------------------------------------------------------------------

_COV = "WITH pn AS (SELECT * FROM panel), cv AS (SELECT a.instrument_id AS i, b.instrument_id AS j, covar_samp(a.price_return, b.price_return) AS cov, count(*) AS observations FROM pn a JOIN pn b USING (business_date) GROUP BY 1, 2) "


@query("panel", sql=_COV + "SELECT * FROM cv", dates=False)
def covariance_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    return risk.covariance(v.panel(spark, sf), "price_return")


@query("panel", sql=_COV + ", fl AS (SELECT business_date FROM pn GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT instrument_id) FROM pn)) SELECT a.instrument_id AS i, b.instrument_id AS j, covar_samp(a.price_return, b.price_return) AS cov, count(*) AS observations FROM pn a JOIN pn b USING (business_date) JOIN fl USING (business_date) GROUP BY 1, 2", dates=False)
def covariance_complete(spark: SparkSession, sf: str) -> DataFrame:
    return risk.covariance(v.panel(spark, sf), "price_return", complete=True)


@query("panel", sql=_COV + "SELECT i, j, CASE WHEN i = j THEN cov ELSE 0.7 * cov END AS cov, observations FROM cv", dates=False)
def covariance_shrunk_diagonal(spark: SparkSession, sf: str) -> DataFrame:
    return risk.shrunk(risk.covariance(v.panel(spark, sf), "price_return"), 0.3)


@query("panel", sql=_COV + "SELECT i, j, 0.7 * cov + CASE WHEN i = j THEN 0.3 * (SELECT avg(cov) FROM cv WHERE i = j) ELSE 0 END AS cov, observations FROM cv", dates=False)
def covariance_shrunk_identity(spark: SparkSession, sf: str) -> DataFrame:
    panel = v.panel(spark, sf)
    return risk.shrunk(risk.covariance(panel, "price_return"), 0.3, identity=True, diagonal=risk.variances(panel, "price_return"))


@query()
def covariance_factor_model(spark: SparkSession, sf: str) -> DataFrame:
    return risk.factor_covariance(v.panel(spark, sf).withColumn("model", F.lit("all")), "price_return", "model", holes=True)


@query("panel", sql=_COV + """, w AS (SELECT instrument_id, sum(market_cap) / (SELECT sum(market_cap) FROM pn) AS weight FROM pn GROUP BY 1), m AS (SELECT i AS instrument_id, sum(cov * w.weight) AS mv FROM cv JOIN w ON j = w.instrument_id GROUP BY 1),
d AS (SELECT instrument_id, weight, mv, sqrt(sum(weight * mv) OVER ()) AS volatility FROM w JOIN m USING (instrument_id))
SELECT instrument_id, weight, mv / volatility AS marginal_risk, weight * mv / volatility AS risk_contribution, weight * mv / volatility / volatility AS risk_contribution_ratio, volatility FROM d""", dates=False)  # fmt: skip
def risk_contributions(spark: SparkSession, sf: str) -> DataFrame:
    top = v.panel(spark, sf)
    w = top.groupBy("instrument_id").agg(F.sum("market_cap").alias("m"))
    w = w.join(F.broadcast(w.agg(F.sum("m").alias("t")))).select("instrument_id", (F.col("m") / F.col("t")).alias("weight"))
    return risk.attributed(w, risk.marginal(top, "price_return", w))


_LIQ = "WITH lq AS (SELECT effective_date, instrument_id, index_weight, market_cap / 21 AS traded, index_weight * 1e6 AS allocation_value, market_cap / 21 * 0.2 AS daily_trading_capacity FROM constituents), l2 AS (SELECT *, allocation_value / daily_trading_capacity AS days_to_trade, daily_trading_capacity * 2 / 1e6 AS capacity_weight_limit FROM lq), l3 AS (SELECT *, index_weight > capacity_weight_limit + 1e-8 AS capacity_breach FROM l2) "


def _liquidity(spark: SparkSession, sf: str) -> DataFrame:
    c = v.constituents(spark, sf).select("effective_date", "instrument_id", "index_weight", (F.col("market_cap") / 21).alias("traded"))
    return risk.liquidity(c, "traded", 1e6, 0.2, 2)


@query("constituents", sql=_LIQ + "SELECT * FROM l3")
def liquidity_capacity(spark: SparkSession, sf: str) -> DataFrame:
    return _liquidity(spark, sf)


@query("constituents", sql=_LIQ + "SELECT effective_date, count(*) FILTER (capacity_breach) AS capacity_breach_count, sum(CASE WHEN capacity_breach THEN index_weight ELSE 0 END) AS weight_in_breach, max(days_to_trade) AS maximum_days_to_trade, sum(index_weight * days_to_trade) AS weighted_average_days_to_trade FROM l3 GROUP BY 1")
def liquidity_summary(spark: SparkSession, sf: str) -> DataFrame:
    return risk.liquidity_summary(_liquidity(spark, sf))


@query("series", sql="SELECT business_date, n - 1 AS place FROM (SELECT business_date, row_number() OVER (ORDER BY business_date DESC) AS n FROM series WHERE business_date <= DATE '2000-06-01') WHERE n > 1 AND n <= 25")
def return_window(spark: SparkSession, sf: str) -> DataFrame:
    dates = risk.window_dates(v.series(spark, sf), "2000-06-01", 24, 1)
    return dates.withColumn("place", F.row_number().over(Window.orderBy(F.desc("business_date"))).cast("long"))


# -- attribution -----------------------------------------------------------

_BRINSON = """WITH nx AS (SELECT instrument_id, business_date AS effective_date, price_return AS r FROM panel),
bi AS (SELECT CAST(c.effective_date AS VARCHAR) AS period, instrument_id, industry, index_weight AS p, benchmark_weight AS b, coalesce(r, 0) AS r FROM constituents c LEFT JOIN nx USING (instrument_id, effective_date)),
g AS (SELECT period, industry, sum(p) AS portfolio_weight, sum(b) AS benchmark_weight, sum(p * r) AS portfolio_contribution, sum(b * r) AS benchmark_contribution FROM bi GROUP BY 1, 2),
h AS (SELECT *, CASE WHEN portfolio_weight > 0 THEN portfolio_contribution / portfolio_weight ELSE 0 END AS portfolio_return, CASE WHEN benchmark_weight > 0 THEN benchmark_contribution / benchmark_weight ELSE 0 END AS benchmark_return, sum(benchmark_contribution) OVER (PARTITION BY period) AS bt FROM g),
de AS (SELECT period, industry, portfolio_weight, benchmark_weight, portfolio_contribution, benchmark_contribution, portfolio_return, benchmark_return, (portfolio_weight - benchmark_weight) * (benchmark_return - bt) AS allocation, benchmark_weight * (portfolio_return - benchmark_return) AS selection,
 (portfolio_weight - benchmark_weight) * (portfolio_return - benchmark_return) AS interaction FROM h),
d2 AS (SELECT *, allocation + selection + interaction AS total_attribution, portfolio_contribution - benchmark_contribution AS active_contribution FROM de),
tt AS (SELECT period, sum(portfolio_contribution) AS portfolio_return, sum(benchmark_contribution) AS benchmark_return, sum(allocation) AS allocation, sum(selection) AS selection, sum(interaction) AS interaction, sum(total_attribution) AS total_attribution, sum(active_contribution) AS active_contribution, sum(portfolio_contribution) - sum(benchmark_contribution) AS active_return FROM d2 GROUP BY 1) """
_CARINO = _BRINSON + """, wh AS (SELECT product(1 + portfolio_return) - 1 AS pp, product(1 + benchmark_return) - 1 AS bb FROM tt),
cc AS (SELECT tt.*, (ln(1 + portfolio_return) - ln(1 + benchmark_return)) / (portfolio_return - benchmark_return) / ((ln(1 + pp) - ln(1 + bb)) / (pp - bb)) AS linking_coefficient FROM tt, wh),
ln_ AS (SELECT period, unnest(['allocation', 'selection', 'interaction']) AS component, unnest([allocation, selection, interaction]) AS period_contribution, linking_coefficient FROM cc), lk AS (SELECT *, period_contribution * linking_coefficient AS linked_contribution FROM ln_) """


def _brinson(spark: SparkSession, sf: str) -> DataFrame:
    nxt = v.panel(spark, sf).select("instrument_id", F.col("business_date").alias("effective_date"), F.col("price_return").alias("r"))
    c = v.constituents(spark, sf).join(nxt, ["instrument_id", "effective_date"], "left")
    return attribution.brinson(c.select(F.col("effective_date").cast("string").alias("period"), "instrument_id", "industry", "index_weight", "benchmark_weight", F.coalesce("r", F.lit(0.0)).alias("asset_return")))


@query("constituents", sql=_BRINSON + "SELECT * FROM d2", dates=False)
def brinson_detail(spark: SparkSession, sf: str) -> DataFrame:
    return _brinson(spark, sf)


@query("constituents", sql=_BRINSON + "SELECT * FROM tt", dates=False)
def brinson_totals(spark: SparkSession, sf: str) -> DataFrame:
    return attribution.brinson_totals(_brinson(spark, sf))


@query("constituents", sql=_CARINO + "SELECT * FROM lk", dates=False)
def carino_detail(spark: SparkSession, sf: str) -> DataFrame:
    return attribution.carino(attribution.brinson_totals(_brinson(spark, sf)))


@query("constituents", sql=_CARINO + "SELECT component, sum(linked_contribution) AS linked_contribution FROM lk GROUP BY 1 UNION ALL SELECT 'total_attribution', sum(linked_contribution) FROM lk UNION ALL SELECT 'multi_period_active_return', pp - bb FROM wh", dates=False)
def carino_totals(spark: SparkSession, sf: str) -> DataFrame:
    totals = attribution.brinson_totals(_brinson(spark, sf))
    return attribution.carino_totals(attribution.carino(totals), totals)


#: Two factors and an intercept, solved by Cramer's rule on centred sums.
_OLS = f"""WITH s AS (SELECT business_date, {INDEX} - {BENCH} AS y, quality AS x1, size AS x2 FROM series JOIN (SELECT business_date, avg(margin) - 0.05 AS quality, (avg(quantity) - 25) / 100 AS size FROM panel GROUP BY 1) USING (business_date)),
m AS (SELECT covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x2, x2) AS c, covar_pop(x1, y) AS p, covar_pop(x2, y) AS q, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM s),
k AS (SELECT (p * c - q * b) / (a * c - b * b) AS b1, (a * q - b * p) / (a * c - b * b) AS b2, my, m1, m2 FROM m), f AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM k),
d AS (SELECT business_date, y AS attributed_return, b0 AS intercept_contribution, b1 * x1 AS quality_contribution, b2 * x2 AS size_contribution, y - b0 - b1 * x1 - b2 * x2 AS residual FROM s, f) """


def _factor_model(spark: SparkSession, sf: str) -> DataFrame:
    f = v.panel(spark, sf).groupBy("business_date").agg((F.avg("margin") - 0.05).alias("quality"), ((F.avg("quantity") - 25) / 100).alias("size"))
    return attribution.factor_model(v.series(spark, sf).join(f, "business_date"), F.col(INDEX) - F.col(BENCH), ["quality", "size"])[1]


@query("series", sql=_OLS + "SELECT * FROM d")
def factor_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return _factor_model(spark, sf)


@query("series", sql=_OLS + "SELECT count(*) AS observations, sum(residual * residual) AS residual_sum_squares, sum(attributed_return) AS total_attributed_return, sum(quality_contribution) AS total_quality_contribution, sum(size_contribution) AS total_size_contribution, sum(intercept_contribution) AS total_intercept_contribution, 1 - sum(residual * residual) / (var_pop(attributed_return) * count(*)) AS r_squared FROM d", dates=False)
def factor_attribution_summary(spark: SparkSession, sf: str) -> DataFrame:
    # the sum of residuals is rounding noise around zero
    return attribution.factor_summary(_factor_model(spark, sf)).drop("total_residual")

