"""Queries of report tables, recipes, plugins and event windows; importing this registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import simulation
from .plans import plugins, recipes, report
from .queries import query
from .queries_build import _Z, _scored, _select_sql
from .queries_sim import _BRINSON, _REBALANCES, _brinson, _held, _sim_sql
from .sources import views as v
from .streaming import windows


@query("constituents", sql="SELECT effective_date, reference_date, count(*) AS instrument_count, 'index' AS index_id FROM constituents GROUP BY 1, 2")
def report_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return report.schedule(v.constituents(spark, sf))


@query("constituents", sql="SELECT effective_date, instrument_id, country, industry, index_weight, benchmark_weight, index_weight - benchmark_weight AS active_weight FROM constituents WHERE effective_date = (SELECT max(effective_date) FROM constituents) AND index_weight > 0")
def report_latest_holdings(spark: SparkSession, sf: str) -> DataFrame:
    return report.latest_holdings(v.constituents(spark, sf))


@query("constituents", sql="SELECT effective_date, unnest(['country', 'industry']) AS classification, unnest([country, industry]) AS \"group\", index_weight, benchmark_weight FROM constituents".join(["SELECT effective_date, classification, \"group\", sum(index_weight) AS portfolio_weight, sum(benchmark_weight) AS benchmark_weight, sum(index_weight) - sum(benchmark_weight) AS active_weight FROM (", ") GROUP BY 1, 2, 3"]))
def report_exposures(spark: SparkSession, sf: str) -> DataFrame:
    return report.exposures(v.constituents(spark, sf))


@query("constituents", sql=_sim_sql(False, "price") + _REBALANCES.replace("SELECT scheduled_effective_date, applied_date, instrument_count, index_turnover, benchmark_turnover FROM ct", "SELECT scheduled_effective_date, applied_date, index_turnover AS one_way_turnover, 2 * index_turnover AS two_way_turnover, benchmark_turnover AS benchmark_one_way_turnover FROM ct"))
def report_turnover(spark: SparkSession, sf: str) -> DataFrame:
    return report.turnover(simulation.rebalances(_held(spark, sf)))


@query("constituents", sql=_BRINSON + "SELECT period, industry AS \"group\", unnest(['brinson.allocation', 'brinson.selection', 'brinson.interaction', 'brinson.total_attribution']) AS component, unnest([allocation, selection, interaction, total_attribution]) AS value FROM d2", dates=False)
def report_attribution(spark: SparkSession, sf: str) -> DataFrame:
    return report.attribution(_brinson(spark, sf))


@query("constituents", sql="SELECT effective_date, 'weights' AS \"check\", CASE WHEN abs(sum(index_weight) - 1) <= 1e-8 AND min(index_weight) >= -1e-8 THEN 'passed' ELSE 'failed' END AS status, sum(index_weight) AS value FROM constituents GROUP BY 1")
def report_validation(spark: SparkSession, sf: str) -> DataFrame:
    return report.validation(v.constituents(spark, sf))


@query("constituents", sql=_select_sql("rn <= greatest(1, ceil(0.3 * n))", False))
def recipe_quantile(spark: SparkSession, sf: str) -> DataFrame:
    """The quantile recipe, compiled and run from its graph."""
    out = recipes.run(recipes.quantile_recipe({"quality": 1.0}, fraction=0.3), {"universe": v.constituents(spark, sf)})["weights"]
    return out.select("effective_date", "instrument_id", "selection_score", "selected", "index_weight")


@query("constituents", sql=_Z + ", lg AS (SELECT effective_date, index_weight AS w, benchmark_weight AS b, unnest(['quality_zscore', 'account_balance_zscore']) AS field_name, unnest([quality_zscore, account_balance_zscore]) AS x FROM zz) SELECT effective_date, field_name, count(*) AS instrument_count, count(*) AS available_count, CAST(0 AS BIGINT) AS missing_count, sum(w) AS index_weight_coverage, sum(b) AS benchmark_weight_coverage, sum(w * x) / sum(w) AS index_exposure, sum(b * x) / sum(b) AS benchmark_exposure, sum(w * x) / sum(w) - sum(b * x) / sum(b) AS active_exposure FROM lg GROUP BY 1, 2")
def plugin_signal_exposure(spark: SparkSession, sf: str) -> DataFrame:
    """The signal plugin finds z-score columns by name."""
    chosen = [p for p in plugins.BUILTIN if p.name == "factor_signal_exposure"]
    return plugins.run(chosen, {"constituents": _scored(spark, sf)}).tables["factor_signal_exposure.review"]


@query(sql="SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS events, sum(value) AS value FROM events GROUP BY 1, 2", dates=False)
def event_day_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.tumbling(v.table(spark, sf, "events"))


@query(sql="WITH g AS (SELECT *, ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE AS brk FROM events), s AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events, sum(value) AS value FROM s GROUP BY user_id, n", dates=False)
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sessions(v.table(spark, sf, "events"))
