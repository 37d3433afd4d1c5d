"""Registered queries of the engine's own operators, each beside the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import events, performance, quality, regimes, reviews
from .sources import views as v
from .sources.oracle_views import over

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "review_metrics"


def query(*needs: str, sql: str | None = None, dates: bool | str = True) -> Callable[[Query], Query]:
    """Register a query by its function's name; ``sql`` goes on from the views it ``needs``. Dates are given as text."""

    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[F.col(c).cast("string").alias(c) if kind == "date" else F.col(c) for c, kind in df.dtypes])

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = over(*needs, then=sql, dates=dates)
        return f

    return add


INDEX, BENCH = "index_net_total_return", "benchmark_net_total_return"
#: For SQL: levels and drawdowns of the two net series.
_LEVELS = f"""WITH lv AS (SELECT *, product(1 + {INDEX}) OVER w AS li, product(1 + {BENCH}) OVER w AS lb FROM series WINDOW w AS (ORDER BY business_date)),
dd AS (SELECT *, li / max(li) OVER w - 1 AS di, lb / max(lb) OVER w - 1 AS db, li / greatest(1, max(li) OVER w) - 1 AS di1, lb / greatest(1, max(lb) OVER w) - 1 AS db1 FROM lv WINDOW w AS (ORDER BY business_date)) """


def _perf_sql(base: str) -> str:
    return _LEVELS + f""", s AS (SELECT count(*) AS observations, product(1 + {INDEX}) - 1 AS total_return, stddev_samp({INDEX}) * sqrt(252) AS annualized_volatility, min(di{base}) AS maximum_drawdown,
  product(1 + {BENCH}) - 1 AS benchmark_total_return, stddev_samp({BENCH}) * sqrt(252) AS benchmark_annualized_volatility, min(db{base}) AS benchmark_maximum_drawdown,
  stddev_samp({INDEX} - {BENCH}) * sqrt(252) AS tracking_error FROM dd),
a AS (SELECT *, power(1 + total_return, 252.0 / observations) - 1 AS annualized_return, power(1 + benchmark_total_return, 252.0 / observations) - 1 AS benchmark_annualized_return FROM s)
SELECT *, annualized_return - benchmark_annualized_return AS annualized_excess_return, (annualized_return - benchmark_annualized_return) / tracking_error AS information_ratio FROM a"""


@query("panel", sql="SELECT * FROM panel")
def market_panel(spark: SparkSession, sf: str) -> DataFrame:
    return v.panel(spark, sf)


@query("constituents", sql="SELECT * FROM constituents")
def review_constituents(spark: SparkSession, sf: str) -> DataFrame:
    return v.constituents(spark, sf)


@query("series", sql=_perf_sql(""), dates=False)
def performance_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return performance.against_benchmark(v.series(spark, sf), INDEX, BENCH)


@query("series", sql=_perf_sql("1"), dates=False)
def core_performance(spark: SparkSession, sf: str) -> DataFrame:
    return performance.core_performance(v.series(spark, sf))


@query("brands", sql="""WITH lv AS (SELECT *, product(1 + ret) OVER w AS l FROM brands WINDOW w AS (PARTITION BY series ORDER BY business_date)),
dd AS (SELECT *, l / max(l) OVER w - 1 AS d FROM lv WINDOW w AS (PARTITION BY series ORDER BY business_date)),
s AS (SELECT series, count(*) AS observations, product(1 + ret) - 1 AS total_return, stddev_samp(ret) * sqrt(252) AS annualized_volatility, min(d) AS maximum_drawdown FROM dd GROUP BY series)
SELECT *, power(1 + total_return, 252.0 / observations) - 1 AS annualized_return FROM s""", dates=False)  # fmt: skip
def return_summary(spark: SparkSession, sf: str) -> DataFrame:
    return performance.summary(v.brand_series(spark, sf), by=["series"])


@query("series", sql=_LEVELS + f"SELECT business_date, {INDEX}, li AS level, di AS drawdown FROM dd")
def drawdown_series(spark: SparkSession, sf: str) -> DataFrame:
    return performance.with_drawdown(v.series(spark, sf).select("business_date", INDEX), INDEX)


@query("series", sql=_LEVELS + f"SELECT business_date, {INDEX}, li AS level, di1 AS drawdown FROM dd")
def drawdown_from_base(spark: SparkSession, sf: str) -> DataFrame:
    return performance.with_drawdown(v.series(spark, sf).select("business_date", INDEX), INDEX, base=1.0)


def _rolling_sql(windows: list[tuple[int, int]]) -> str:
    parts = [
        f"SELECT business_date, {n} AS \"window\", stddev_samp({INDEX}) OVER w * sqrt(252) AS annualized_volatility, stddev_samp({INDEX} - {BENCH}) OVER w * sqrt(252) AS tracking_error, corr({INDEX}, {BENCH}) OVER w AS correlation, count(*) OVER w AS n, {m} AS need FROM series WINDOW w AS (ORDER BY business_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for n, m in windows
    ]
    return f"SELECT business_date, \"window\", annualized_volatility, tracking_error, correlation FROM ({' UNION ALL '.join(parts)}) WHERE n >= need"


@query("series", sql=_rolling_sql([(6, 6), (12, 12), (36, 36)]))
def rolling_risk(spark: SparkSession, sf: str) -> DataFrame:
    return performance.rolling_risk(v.series(spark, sf), INDEX, BENCH, windows=(6, 12, 36))


@query("series", sql=_rolling_sql([(21, 17), (63, 51)]))
def rolling_risk_partial(spark: SparkSession, sf: str) -> DataFrame:
    return performance.rolling_risk(v.series(spark, sf), INDEX, BENCH, windows=(21, 63, 252, 756), least=0.8)


@query("series", sql=f"""SELECT CAST(year(business_date) AS VARCHAR) AS period, count(*) AS observations, min(business_date) AS start_date, max(business_date) AS end_date,
product(1 + {INDEX}) - 1 AS index_return, product(1 + {BENCH}) - 1 AS benchmark_return, product(1 + {INDEX}) - product(1 + {BENCH}) AS active_return FROM series GROUP BY 1""")  # fmt: skip
def calendar_years(spark: SparkSession, sf: str) -> DataFrame:
    return performance.calendar_years(v.series(spark, sf), INDEX, BENCH)


@query("brands", sql="""WITH lv AS (SELECT *, product(1 + ret) OVER w AS l FROM brands WINDOW w AS (PARTITION BY series ORDER BY business_date)),
dd AS (SELECT *, l / max(l) OVER w - 1 AS d, lead(business_date) OVER w AS nxt FROM lv WINDOW w AS (PARTITION BY series ORDER BY business_date)),
st AS (SELECT *, d < -1e-15 AND coalesce(lag(d) OVER w, 0) >= -1e-15 AS starts FROM dd WINDOW w AS (PARTITION BY series ORDER BY business_date)),
ep AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER w AS episode FROM st WINDOW w AS (PARTITION BY series ORDER BY business_date)),
g AS (SELECT series, episode, min(business_date) AS start_date, arg_min(business_date, d) AS trough_date, min(d) AS maximum_drawdown, max(business_date) AS last, arg_max(coalesce(nxt, DATE '1900-01-01'), business_date) AS nxt
      FROM ep WHERE d < -1e-15 GROUP BY 1, 2),
f AS (SELECT *, nxt > DATE '1900-01-01' AS recovered, CASE WHEN nxt > DATE '1900-01-01' THEN nxt ELSE last END AS end_date FROM g)
SELECT series, episode, start_date, trough_date, end_date, maximum_drawdown, recovered,
       1 + len(list_filter(range(start_date, end_date, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS duration_business_days FROM f""")  # fmt: skip
def drawdown_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return performance.drawdown_episodes(v.brand_series(spark, sf), by=["series"])


@query("constituents", sql="""SELECT effective_date, count(*) AS instrument_count, count(*) FILTER (index_weight > 1e-8) AS portfolio_constituent_count, count(*) FILTER (benchmark_weight > 1e-8) AS benchmark_constituent_count,
sum(index_weight) AS portfolio_weight_sum, sum(benchmark_weight) AS benchmark_weight_sum, min(index_weight) AS minimum_portfolio_weight, max(index_weight) AS maximum_portfolio_weight FROM constituents GROUP BY 1""")  # fmt: skip
def review_validation(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.validation(v.constituents(spark, sf))


_TOP = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY effective_date ORDER BY index_weight DESC, instrument_id) AS rn FROM constituents) "


@query("constituents", sql=_TOP + """SELECT effective_date, count(*) FILTER (index_weight > 1e-8) AS constituent_count, max(index_weight) AS max_weight, sum(index_weight) FILTER (rn <= 10) AS top_10_weight,
sum(index_weight * index_weight) AS hhi, 1 / sum(index_weight * index_weight) AS effective_n, 0.5 * sum(abs(index_weight - benchmark_weight)) AS active_share FROM r GROUP BY 1""")  # fmt: skip
def review_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.metrics(v.constituents(spark, sf))


@query("constituents", sql=_TOP + """SELECT effective_date, count(*) FILTER (index_weight > 1e-8) AS constituent_count, max(index_weight) AS maximum_weight, sum(index_weight * index_weight) AS hhi, 1 / sum(index_weight * index_weight) AS effective_constituent_count,
sum(index_weight) FILTER (rn <= 1) AS top_1_weight, sum(index_weight) FILTER (rn <= 5) AS top_5_weight, sum(index_weight) FILTER (rn <= 10) AS top_10_weight FROM r GROUP BY 1""")  # fmt: skip
def concentration(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.concentration(v.constituents(spark, sf))


def _exposure_sql(c: str) -> str:
    return f"SELECT effective_date, coalesce(nullif(trim({c}), ''), 'Unclassified') AS {c}, sum(index_weight) AS portfolio_weight, sum(benchmark_weight) AS benchmark_weight, sum(index_weight) - sum(benchmark_weight) AS active_weight FROM constituents GROUP BY 1, 2"


@query("constituents", sql=_exposure_sql("country"))
def country_exposures(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.exposures(v.constituents(spark, sf), "country")


@query("constituents", sql=_exposure_sql("industry"))
def industry_exposures(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.exposures(v.constituents(spark, sf), "industry")


_LONG = "WITH lg AS (SELECT effective_date, industry, index_weight, benchmark_weight, unnest(['quality', 'account_balance']) AS field_name, unnest([quality, account_balance]) AS value FROM constituents), gp AS (SELECT effective_date, industry, index_weight, benchmark_weight, field_name, CASE WHEN field_name = 'account_balance' AND value < 0 THEN NULL ELSE value END AS value FROM lg) "


@query("constituents", sql=_LONG + "SELECT effective_date, industry, field_name, sum(index_weight * value) AS portfolio_exposure, sum(benchmark_weight * value) AS benchmark_exposure, sum(index_weight * value) - sum(benchmark_weight * value) AS active_exposure FROM lg GROUP BY 1, 2, 3")
def weighted_exposures(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.weighted_exposures(v.constituents(spark, sf), ["quality", "account_balance"], ["effective_date", "industry"])


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Constituents whose negative balances count as missing."""
    return v.constituents(spark, sf).withColumn("account_balance", F.when(F.col("account_balance") >= 0, F.col("account_balance")))


@query("constituents", sql=_LONG + """, g AS (SELECT effective_date, field_name, count(*) AS instrument_count, count(value) AS available_count, count(*) - count(value) AS missing_count,
  coalesce(sum(index_weight) FILTER (value IS NOT NULL), 0) AS index_weight_coverage, coalesce(sum(benchmark_weight) FILTER (value IS NOT NULL), 0) AS benchmark_weight_coverage, sum(index_weight * value) AS i, sum(benchmark_weight * value) AS b FROM gp GROUP BY 1, 2)
SELECT effective_date, field_name, instrument_count, available_count, missing_count, index_weight_coverage, benchmark_weight_coverage, CASE WHEN index_weight_coverage > 1e-8 THEN i / index_weight_coverage END AS index_exposure,
  CASE WHEN benchmark_weight_coverage > 1e-8 THEN b / benchmark_weight_coverage END AS benchmark_exposure, i / index_weight_coverage - b / benchmark_weight_coverage AS active_exposure FROM g""")  # fmt: skip
def field_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.field_statistics(_gaps(spark, sf), ["quality", "account_balance"])


@query("constituents", sql="SELECT effective_date, instrument_id, index_weight, 2 * benchmark_weight AS capacity_limit, CASE WHEN benchmark_weight > 0 THEN index_weight / (2 * benchmark_weight) END AS capacity_utilisation, index_weight > 2 * benchmark_weight + 1e-8 AS capacity_breach FROM constituents")
def capacity_utilisation(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.capacity(v.constituents(spark, sf).withColumn("limit", 2 * F.col("benchmark_weight")), "limit")


def _changes_sql(by_difference: bool) -> str:
    up, down = ("weight_change > 1e-8", "weight_change < -1e-8") if by_difference else ("current_weight > previous_weight + 1e-8", "current_weight < previous_weight - 1e-8")
    return f"""WITH dt AS (SELECT effective_date, lag(effective_date) OVER (ORDER BY effective_date) AS previous_effective_date FROM (SELECT DISTINCT effective_date FROM constituents)),
cu AS (SELECT c.effective_date, previous_effective_date, instrument_id, index_weight AS w FROM constituents c JOIN dt USING (effective_date) WHERE previous_effective_date IS NOT NULL),
pr AS (SELECT dt.effective_date, dt.previous_effective_date, instrument_id, index_weight AS w FROM constituents c JOIN dt ON c.effective_date = dt.previous_effective_date),
bo AS (SELECT effective_date, previous_effective_date, instrument_id, coalesce(pr.w, 0) AS previous_weight, coalesce(cu.w, 0) AS current_weight, coalesce(cu.w, 0) - coalesce(pr.w, 0) AS weight_change
       FROM cu FULL JOIN pr USING (effective_date, previous_effective_date, instrument_id)),
ch AS (SELECT *, CASE WHEN previous_weight <= 1e-8 AND current_weight > 1e-8 THEN 'entrant' WHEN previous_weight > 1e-8 AND current_weight <= 1e-8 THEN 'exit' WHEN {up} THEN 'weight_increase' WHEN {down} THEN 'weight_decrease' ELSE 'unchanged' END AS status FROM bo) """


@query("constituents", sql=_changes_sql(False) + "SELECT * FROM ch")
def constituent_changes(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.changes(v.constituents(spark, sf))


@query("constituents", sql=_changes_sql(True) + "SELECT *, abs(weight_change) AS absolute_weight_change, 0.5 * abs(weight_change) AS one_way_turnover_contribution FROM ch")
def explained_changes(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.explained_changes(v.constituents(spark, sf))


@query("constituents", sql=_changes_sql(False) + "SELECT effective_date, previous_effective_date, sum(abs(weight_change)) AS gross_target_weight_change, 0.5 * sum(abs(weight_change)) AS one_way_target_weight_change FROM ch GROUP BY 1, 2")
def target_weight_change(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.target_weight_change(v.constituents(spark, sf))


@query("constituents", sql=_changes_sql(False) + """SELECT effective_date, previous_effective_date, count(*) FILTER (previous_weight > 1e-8) AS previous_count, count(*) FILTER (current_weight > 1e-8) AS current_count,
count(*) FILTER (status = 'entrant') AS entrants, count(*) FILTER (status = 'exit') AS exits,
count(*) FILTER (previous_weight > 1e-8 AND current_weight > 1e-8) / count(*) FILTER (previous_weight > 1e-8 OR current_weight > 1e-8) AS membership_jaccard FROM ch GROUP BY 1, 2""")  # fmt: skip
def membership_stability(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.membership_stability(v.constituents(spark, sf))


@query("constituents", sql=_changes_sql(False) + "SELECT effective_date, instrument_id, status, abs(weight_change) AS absolute_weight_change, 0.5 * abs(weight_change) AS one_way_contribution FROM ch")
def turnover_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.turnover_decomposition(v.constituents(spark, sf))


_CONTRIBUTORS = ", co AS (SELECT *, abs(weight_change) AS absolute_weight_change, 0.5 * abs(weight_change) AS one_way_contribution, 0.5 * abs(weight_change) / sum(0.5 * abs(weight_change)) OVER (PARTITION BY effective_date) AS share_of_one_way_turnover FROM ch) "


@query("constituents", sql=_changes_sql(False) + _CONTRIBUTORS + "SELECT * FROM co")
def change_contributors(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.contributors(v.constituents(spark, sf))


@query("constituents", sql=_changes_sql(False) + _CONTRIBUTORS + "SELECT effective_date, status, count(DISTINCT instrument_id) AS instrument_count, sum(weight_change) AS net_weight_change, sum(absolute_weight_change) AS absolute_weight_change, sum(one_way_contribution) AS one_way_turnover, sum(share_of_one_way_turnover) AS share_of_one_way_turnover FROM co GROUP BY 1, 2")
def change_contributors_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.contributors_by_status(v.constituents(spark, sf))


_REASONS = "WITH rs AS (SELECT DISTINCT effective_date, instrument_id, unnest(list_filter([CASE WHEN quality > 0.05 THEN 'quality' END, CASE WHEN quantity >= 25 THEN 'size' END, CASE WHEN account_balance > 0 THEN ' balance ' END, ''], lambda x: trim(x) <> '')) AS rr FROM constituents), rt AS (SELECT effective_date, instrument_id, trim(rr) AS reason FROM rs) "


def _with_reasons(spark: SparkSession, sf: str) -> DataFrame:
    why = F.array_compact(F.array(F.when(F.col("quality") > 0.05, "quality"), F.when(F.col("quantity") >= 25, "size"), F.when(F.col("account_balance") > 0, " balance "), F.lit("")))
    return v.constituents(spark, sf, as_read=True).withColumn("selection_reason", why)


@query("constituents", sql=_REASONS + "SELECT * FROM rt")
def selection_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.selection_reasons(_with_reasons(spark, sf))[0]


@query("constituents", sql=_REASONS + "SELECT effective_date, reason, count(DISTINCT instrument_id) AS instrument_count FROM rt GROUP BY 1, 2")
def selection_reason_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.selection_reasons(_with_reasons(spark, sf))[1]


@query("constituents", sql="""WITH w0 AS (SELECT *, benchmark_weight AS a0, 0.5 + quality AS t1, quantity / 25 AS t2 FROM constituents),
w1 AS (SELECT *, a0 * t1 AS u1, a0 * t1 / sum(a0 * t1) OVER (PARTITION BY effective_date) AS a1 FROM w0), w2 AS (SELECT *, a1 * t2 AS u2, a1 * t2 / sum(a1 * t2) OVER (PARTITION BY effective_date) AS a2 FROM w1),
st AS (SELECT effective_date, instrument_id, index_weight - a2 AS residual, 1 AS sequence, 'quality_tilt' AS step, t1 AS tilt_multiplier, a0 AS previous_weight, u1 AS unnormalized_weight, a1 AS resulting_weight FROM w2
 UNION ALL SELECT effective_date, instrument_id, index_weight - a2, 2, 'size_tilt', t2, a1, u2, a2 FROM w2)
SELECT *, resulting_weight - previous_weight AS weight_change, 0.5 * abs(resulting_weight - previous_weight) AS one_way_contribution FROM st""")  # fmt: skip
def tilt_explanation(spark: SparkSession, sf: str) -> DataFrame:
    c = v.constituents(spark, sf).withColumn("quality_tilt", 0.5 + F.col("quality")).withColumn("size_tilt", F.col("quantity") / 25)
    return reviews.explain_tilts(c, ["quality_tilt", "size_tilt"])


@query("constituents", sql="""WITH gp AS (SELECT effective_date, market_cap, country, CASE WHEN account_balance >= 0 THEN account_balance END AS account_balance, benchmark_weight FROM constituents),
lg AS (SELECT effective_date, benchmark_weight AS w, unnest(['account_balance', 'country']) AS field, unnest([account_balance IS NOT NULL, country IS NOT NULL AND trim(country) <> '']) AS ok FROM gp)
SELECT effective_date, field, count(*) AS row_count, count(*) FILTER (ok) AS available_count, count(*) FILTER (NOT ok) AS missing_count, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS row_coverage, sum(CASE WHEN ok THEN w ELSE 0 END) / sum(w) AS weight_coverage FROM lg GROUP BY 1, 2""")  # fmt: skip
def data_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return quality.coverage(_gaps(spark, sf), ["account_balance", "country"], "benchmark_weight", ["effective_date"])


@query("constituents", sql="SELECT effective_date, count(*) AS rows, count(*) - count(CASE WHEN account_balance >= 0 THEN 1 END) AS missing_cells, CAST(10 AS BIGINT) AS columns, (count(*) - count(CASE WHEN account_balance >= 0 THEN 1 END)) / (count(*) * 10) AS missing_fraction FROM constituents GROUP BY 1")
def missing_cells(spark: SparkSession, sf: str) -> DataFrame:
    return quality.missing_cells(_gaps(spark, sf))


@query(sql="""SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS effective_date, CAST(date_trunc('year', o_orderdate) + INTERVAL 6 MONTH AS DATE) AS reference_date, o_orderpriority AS source, count(*) AS row_count, count(*) AS available_count, CAST(0 AS BIGINT) AS missing_count,
count(*) FILTER (CAST(o_orderdate AS DATE) > CAST(date_trunc('year', o_orderdate) + INTERVAL 6 MONTH AS DATE)) AS future_observation_count, CAST(min(o_orderdate) AS DATE) AS oldest_observation_date, CAST(max(o_orderdate) AS DATE) AS latest_observation_date,
min(date_diff('day', CAST(o_orderdate AS DATE), CAST(date_trunc('year', o_orderdate) + INTERVAL 6 MONTH AS DATE))) AS minimum_age_days, median(date_diff('day', CAST(o_orderdate AS DATE), CAST(date_trunc('year', o_orderdate) + INTERVAL 6 MONTH AS DATE))) AS median_age_days,
max(date_diff('day', CAST(o_orderdate AS DATE), CAST(date_trunc('year', o_orderdate) + INTERVAL 6 MONTH AS DATE))) AS maximum_age_days FROM orders GROUP BY 1, 2, 3""")  # fmt: skip
def data_freshness(spark: SparkSession, sf: str) -> DataFrame:
    year = F.to_date(F.date_trunc("year", "o_orderdate"))
    o = v.table(spark, sf, "orders").select(year.alias("effective_date"), F.add_months(year, 6).alias("reference_date"), F.col("o_orderpriority").alias("source"), F.to_date("o_orderdate").alias("observation_date"))
    return quality.freshness(o)


def _stages(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    lines = v.table(spark, sf, "lineitem")
    by = lambda d: d.groupBy(F.col("l_suppkey").cast("string").alias("instrument_id")).agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("value"))
    return {"all": by(lines), "returned": by(lines.where("l_returnflag = 'R'")), "filled": by(lines.where("l_returnflag = 'R' AND l_linestatus = 'F'"))}


_STAGES = """WITH s1 AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument_id, sum(l_quantity) AS quantity, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1),
s2 AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument_id, sum(l_quantity) AS quantity, sum(l_extendedprice) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
s3 AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument_id, sum(l_quantity) AS quantity, sum(l_extendedprice) AS value FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1),
""" + ",\n".join(
    f"d{i} AS (SELECT '{a}' AS previous_stage, '{b}' AS current_stage, instrument_id, l.instrument_id IS NULL AS new, r.instrument_id IS NULL AS gone, unnest(['quantity', 'value']) AS field, unnest([l.quantity, l.value]) AS previous_value, unnest([r.quantity, r.value]) AS current_value FROM s{i} l FULL JOIN s{i + 1} r USING (instrument_id))"
    for i, (a, b) in enumerate((("all", "returned"), ("returned", "filled")), 1)
) + """, de AS (SELECT previous_stage, current_stage, instrument_id, field, previous_value, current_value, current_value - previous_value AS difference, coalesce(abs(current_value - previous_value), 0) AS absolute_difference,
CASE WHEN new THEN 'added' WHEN gone THEN 'removed' WHEN abs(current_value - previous_value) > 1e-12 THEN 'changed' ELSE 'unchanged' END AS status FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2)) """


@query(sql=_STAGES + "SELECT * FROM de", dates=False)
def stage_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    return quality.compare_stages(_stages(spark, sf), ["instrument_id"], ["quantity", "value"])


@query(sql=_STAGES + "SELECT previous_stage, current_stage, field, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged, sum(absolute_difference) AS absolute_difference, max(absolute_difference) AS maximum_absolute_difference FROM de GROUP BY 1, 2, 3", dates=False)
def stage_waterfall_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.stage_summary(quality.compare_stages(_stages(spark, sf), ["instrument_id"], ["quantity", "value"]))


_TARGETS = "WITH tg AS (SELECT effective_date, industry AS target_name, sum(benchmark_weight) AS q, sum(index_weight) AS a FROM constituents GROUP BY 1, 2) "


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.exposures(v.constituents(spark, sf), "industry").select("effective_date", F.col("industry").alias("name"), F.col("benchmark_weight").alias("target"), F.col("portfolio_weight").alias("achieved"), F.when(F.col("industry") == "ASIA", "AT_LEAST").alias("direction"), F.when(F.col("industry") != "EUROPE", 0.02).alias("tolerance"))


@query("constituents", sql=_TARGETS + """, bd AS (SELECT *, CASE WHEN target_name = 'ASIA' THEN 'at_least' ELSE 'equal' END AS direction, CASE WHEN target_name <> 'EUROPE' THEN 0.02 END AS tolerance FROM tg),
b2 AS (SELECT *, q - tolerance AS lower_bound, CASE WHEN direction = 'equal' THEN q + tolerance END AS upper_bound FROM bd)
SELECT effective_date, target_name, direction, q AS requested_value, a AS achieved_value, a - q AS deviation, abs(a - q) AS absolute_deviation, tolerance, lower_bound, upper_bound,
CASE WHEN lower_bound IS NOT NULL OR upper_bound IS NOT NULL THEN (lower_bound IS NULL OR a >= lower_bound) AND (upper_bound IS NULL OR a <= upper_bound) END AS within_bounds FROM b2""")  # fmt: skip
def target_attainment(spark: SparkSession, sf: str) -> DataFrame:
    return quality.target_attainment(_targets(spark, sf))


_CONSTRAINTS = _TARGETS + """, cs AS (SELECT effective_date, target_name AS constraint_name, a AS achieved_value, q - 0.02 AS lower_bound, CASE WHEN target_name = 'ASIA' THEN NULL ELSE q + 0.02 END AS upper_bound FROM tg),
sl AS (SELECT *, achieved_value - lower_bound AS lower_slack, upper_bound - achieved_value AS upper_slack, greatest(lower_bound - achieved_value, coalesce(achieved_value - upper_bound, 0), 0) AS violation FROM cs),
cd AS (SELECT *, violation > 1e-8 AS violated, NOT violation > 1e-8 AND least(abs(lower_slack), abs(upper_slack)) <= 1e-8 AS binding FROM sl) """


def _constraints(spark: SparkSession, sf: str) -> DataFrame:
    t = _targets(spark, sf)
    high = F.when(F.col("name") != "ASIA", F.col("target") + 0.02)
    return quality.constraint_diagnostics(t.select("effective_date", "name", F.col("achieved").alias("value"), (F.col("target") - 0.02).alias("lower"), high.alias("upper")))


@query("constituents", sql=_CONSTRAINTS + "SELECT effective_date, constraint_name, achieved_value, lower_bound, upper_bound, lower_slack, upper_slack, violation, CASE WHEN violated THEN 'violated' WHEN binding THEN 'binding' ELSE 'satisfied' END AS status, binding, violated, CAST(NULL AS DOUBLE) AS dual_value FROM cd")
def constraint_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return _constraints(spark, sf)


@query("constituents", sql=_CONSTRAINTS + "SELECT effective_date, count(*) AS constraint_count, count(*) FILTER (binding) AS binding_count, count(*) FILTER (violated) AS violated_count, max(violation) AS maximum_violation FROM cd GROUP BY 1")
def constraint_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.constraint_summary(_constraints(spark, sf))


_REGIME_SERIES = f"WITH rl AS (SELECT business_date, unnest(['{INDEX}', '{BENCH}']) AS series, unnest([{INDEX}, {BENCH}]) AS r FROM series), rr AS (SELECT * FROM rl JOIN regimes USING (business_date)) "


def _regime_returns(spark: SparkSession, sf: str) -> DataFrame:
    return regimes.long_returns(v.series(spark, sf), [INDEX, BENCH])


@query("series", "regimes", sql=_REGIME_SERIES + """, lv AS (SELECT *, product(1 + r) OVER w AS l FROM rr WINDOW w AS (PARTITION BY regime, series ORDER BY business_date)), dd AS (SELECT *, l / max(l) OVER w - 1 AS d FROM lv WINDOW w AS (PARTITION BY regime, series ORDER BY business_date)),
s AS (SELECT regime, series, count(*) AS observations, avg(r) AS mean_return, median(r) AS median_return, product(1 + r) - 1 AS total_return, stddev_samp(r) * sqrt(252) AS annualized_volatility, sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0 END)) * sqrt(252) AS downside_deviation, min(d) AS maximum_drawdown, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS positive_return_ratio FROM dd GROUP BY 1, 2)
SELECT *, power(1 + total_return, 252.0 / observations) - 1 AS annualized_return FROM s""", dates=False)  # fmt: skip
def regime_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return regimes.statistics(_regime_returns(spark, sf), v.regimes(spark, sf))


@query("regimes", sql="""WITH st AS (SELECT lag(regime) OVER (ORDER BY business_date) AS f, regime AS t FROM regimes), lb AS (SELECT DISTINCT regime FROM regimes), gr AS (SELECT a.regime AS from_regime, b.regime AS to_regime FROM lb a, lb b),
ct AS (SELECT from_regime, to_regime, count(f) AS transitions FROM gr LEFT JOIN st ON f = from_regime AND t = to_regime GROUP BY 1, 2)
SELECT *, CASE WHEN sum(transitions) OVER w > 0 THEN transitions / sum(transitions) OVER w ELSE 0.0 END AS probability FROM ct WINDOW w AS (PARTITION BY from_regime)""", dates=False)  # fmt: skip
def regime_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return regimes.transitions(v.regimes(spark, sf))


def _phi(x: str) -> str:
    """The normal distribution function by its alternating series, in SQL."""
    return f"(0.5 + list_sum(list_transform(range(0, 80), lambda n: pow(-1, n) * pow({x}, 2 * n + 1) / (gamma(n + 1) * pow(2, n) * (2 * n + 1)))) / sqrt(2 * pi()))"


@query("series", "regimes", sql=_REGIME_SERIES + f""", rk AS (SELECT series, regime, rank() OVER (PARTITION BY series ORDER BY r) + (count(*) OVER (PARTITION BY series, r) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY series, r) AS t FROM rr),
g AS (SELECT series, CAST(count(*) AS DOUBLE) AS n, sum(t * t - 1.0) AS ties, sum(k) FILTER (regime = 'contraction') AS ra, count(*) FILTER (regime = 'contraction') AS na, sum(k) FILTER (regime = 'expansion') AS rb, count(*) FILTER (regime = 'expansion') AS nb FROM rk GROUP BY 1),
st AS (SELECT series, (12 / (n * (n + 1)) * (ra * ra / na + rb * rb / nb) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h, ra - na * (na + 1) / 2.0 AS u, na * nb AS ab, sqrt(na * nb / 12.0 * (n + 1 - ties / (n * (n - 1)))) AS sd FROM g),
zs AS (SELECT *, -sqrt(h) AS x, -(greatest(u, ab - u) - ab / 2.0 - 0.5) / sd AS z FROM st)
SELECT series, 'kruskal_wallis' AS test, NULL AS regime_a, NULL AS regime_b, h AS statistic, 2 * {_phi("x")} AS p_value FROM zs
UNION ALL SELECT series, 'mann_whitney_u', 'contraction', 'expansion', u, least(1, 2 * {_phi("z")}) FROM zs""", dates=False)  # fmt: skip
def regime_distribution_tests(spark: SparkSession, sf: str) -> DataFrame:
    return regimes.distribution_tests(_regime_returns(spark, sf), v.regimes(spark, sf))


_EVENT_WINDOWS = f"""WITH ps AS (SELECT business_date, {INDEX} AS ir, {BENCH} AS br, row_number() OVER (ORDER BY business_date) - 1 AS p FROM series),
al AS (SELECT event_date AS requested_event_date, (SELECT min(p) FROM ps WHERE ps.business_date >= event_date) AS pos FROM event_dates),
ok AS (SELECT * FROM al WHERE pos >= 5 AND pos + 5 < (SELECT count(*) FROM ps)),
ew AS (SELECT requested_event_date, e.business_date AS event_date, d.business_date, d.p - pos AS relative_day, d.ir AS index_return, d.br AS benchmark_return, d.ir - d.br AS abnormal_return FROM ok JOIN ps e ON e.p = pos JOIN ps d ON d.p BETWEEN pos - 5 AND pos + 5),
ec AS (SELECT *, sum(abnormal_return) OVER (PARTITION BY requested_event_date ORDER BY relative_day) AS cumulative_abnormal_return FROM ew) """


@query("series", "event_dates", sql=_EVENT_WINDOWS + "SELECT * FROM ec")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return events.windows(v.series(spark, sf), v.event_dates(spark, sf), INDEX, BENCH)


@query("series", "event_dates", sql=_EVENT_WINDOWS + """SELECT relative_day, count(*) AS event_count, avg(abnormal_return) AS mean_abnormal_return, median(abnormal_return) AS median_abnormal_return, stddev_samp(abnormal_return) AS standard_deviation, avg(cumulative_abnormal_return) AS mean_cumulative_abnormal_return,
stddev_samp(abnormal_return) / sqrt(count(*)) AS standard_error, avg(abnormal_return) / (stddev_samp(abnormal_return) / sqrt(count(*))) AS t_statistic FROM ec GROUP BY 1""", dates=False)  # fmt: skip
def event_study(spark: SparkSession, sf: str) -> DataFrame:
    return events.study(events.windows(v.series(spark, sf), v.event_dates(spark, sf), INDEX, BENCH))


@query("series", "event_dates", sql=f"""WITH ps AS (SELECT business_date, {INDEX} AS r, row_number() OVER (ORDER BY business_date) AS p FROM series), al AS (SELECT DISTINCT (SELECT min(p) FROM ps WHERE ps.business_date >= event_date) AS pos FROM event_dates),
mk AS (SELECT p, r, EXISTS (SELECT 1 FROM al WHERE abs(pos - p) <= 1) AS e FROM ps)
SELECT count(*) FILTER (e) AS event_observations, count(*) FILTER (NOT e) AS non_event_observations, coalesce(product(1 + r) FILTER (e), 1) - 1 AS event_compound_return, coalesce(product(1 + r) FILTER (NOT e), 1) - 1 AS non_event_compound_return FROM mk""", dates=False)  # fmt: skip
def event_non_event_returns(spark: SparkSession, sf: str) -> DataFrame:
    return events.event_and_other_returns(v.series(spark, sf), v.event_dates(spark, sf), INDEX, 1)
