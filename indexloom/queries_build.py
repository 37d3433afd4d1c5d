"""Queries of loading rules, calendars, construction, scenarios and comparison; importing this registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import comparison, construction, scenarios
from .operators.construction import Criterion, Exposure, Limits, Tilt, Weighting
from .queries import query
from .sources import calendars, contracts, providers, rules
from .sources import views as v

_Z = """WITH zz AS (SELECT *, CASE WHEN stddev_pop(quality) OVER w = 0 THEN 0 ELSE greatest(-3.0, least(3.0, (quality - avg(quality) OVER w) / stddev_pop(quality) OVER w)) END AS quality_zscore,
CASE WHEN account_balance < 0 THEN 0.0 ELSE greatest(-3.0, least(3.0, (account_balance - avg(account_balance) FILTER (account_balance >= 0) OVER w) / stddev_pop(account_balance) FILTER (account_balance >= 0) OVER w)) END AS account_balance_zscore
FROM constituents WINDOW w AS (PARTITION BY effective_date)) """


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Constituents with z-scores of quality and balance; negative balances are missing."""
    c = v.constituents(spark, sf).withColumn("account_balance", F.when(F.col("account_balance") >= 0, F.col("account_balance")))
    return construction.standardised(c, ["quality", "account_balance"])


@query("constituents", sql=_Z + "SELECT effective_date, instrument_id, quality_zscore, account_balance_zscore FROM zz")
def standardised_factors(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("effective_date", "instrument_id", "quality_zscore", "account_balance_zscore")


def _tilt_sql(m: str) -> str:
    return _Z + f", tw AS (SELECT effective_date, instrument_id, 0.5 * quality_zscore + 0.25 * account_balance_zscore AS factor_score, benchmark_weight FROM zz) SELECT effective_date, instrument_id, factor_score, benchmark_weight * {m} / sum(benchmark_weight * {m}) OVER (PARTITION BY effective_date) AS index_weight FROM tw"


_TILTS = {"quality": 0.5, "account_balance": 0.25}


@query("constituents", sql=_tilt_sql("exp(1.5 * factor_score)"))
def factor_tilt_exponential(spark: SparkSession, sf: str) -> DataFrame:
    return construction.tilted(_scored(spark, sf), _TILTS, strength=1.5).select("effective_date", "instrument_id", "factor_score", "index_weight")


@query("constituents", sql=_tilt_sql("greatest(1 + 0.8 * factor_score, 0)"))
def factor_tilt_proportional(spark: SparkSession, sf: str) -> DataFrame:
    return construction.tilted(_scored(spark, sf), _TILTS, Tilt.PROPORTIONAL, 0.8).select("effective_date", "instrument_id", "factor_score", "index_weight")


#: The normal distribution function by its alternating series.
_PHI = "(0.5 + list_sum(list_transform(range(0, 60), lambda n: pow(-1, n) * pow(factor_score, 2 * n + 1) / (gamma(n + 1) * pow(2, n) * (2 * n + 1)))) / sqrt(2 * pi()))"


@query("constituents", sql=_tilt_sql(f"pow({_PHI}, 2)"))
def factor_tilt_power(spark: SparkSession, sf: str) -> DataFrame:
    return construction.tilted(_scored(spark, sf), _TILTS, Tilt.POWER, 2.0).select("effective_date", "instrument_id", "factor_score", "index_weight")


@query()
def factor_tilt_projected(spark: SparkSession, sf: str) -> DataFrame:
    """A tilt brought within capacity, an upper bound and sector limits, review by review."""
    t = construction.tilted(_scored(spark, sf), _TILTS)
    return construction.projected(t, Limits(maximum=0.5, capacity=3.0, groups={"industry": 0.02})).select("effective_date", "instrument_id", "index_weight", "solver_status")


def _select_sql(inside: str, within: bool, equal: bool = False) -> str:
    part = "effective_date, industry" if within else "effective_date"
    w = "1" if equal else "bw"
    total = f"sum(bw) OVER (PARTITION BY {part})" if within else "1"
    return _Z + f""", sc AS (SELECT effective_date, instrument_id, industry, benchmark_weight / sum(benchmark_weight) OVER (PARTITION BY effective_date) AS bw, quality_zscore AS selection_score FROM zz),
rk AS (SELECT *, row_number() OVER o AS rn, count(*) OVER (PARTITION BY {part}) AS n, sum(bw) OVER (PARTITION BY {part}) AS gw, coalesce(sum(bw) OVER (PARTITION BY {part} ORDER BY selection_score DESC, instrument_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sc WINDOW o AS (PARTITION BY {part} ORDER BY selection_score DESC, instrument_id)),
se AS (SELECT *, {inside} AS selected FROM rk)
SELECT effective_date, instrument_id, selection_score, selected, CASE WHEN selected THEN {w} / sum(CASE WHEN selected THEN {w} END) OVER (PARTITION BY {part}) * {total} ELSE 0 END AS index_weight FROM se"""


_COUNT, _COVER = "rn <= greatest(1, ceil(0.3 * n))", "rn = 1 OR before < 0.3 * gw"
_SELECTED = ("effective_date", "instrument_id", "selection_score", "selected", "index_weight")


@query("constituents", sql=_select_sql(_COUNT, False))
def quantile_by_count(spark: SparkSession, sf: str) -> DataFrame:
    return construction.selected(_scored(spark, sf), {"quality": 1.0}, 0.3).select(*_SELECTED)


@query("constituents", sql=_select_sql(_COVER, False))
def quantile_by_weight(spark: SparkSession, sf: str) -> DataFrame:
    return construction.selected(_scored(spark, sf), {"quality": 1.0}, 0.3, Criterion.WEIGHT_COVERAGE).select(*_SELECTED)


@query("constituents", sql=_select_sql(_COUNT, True, True))
def quantile_within_industry(spark: SparkSession, sf: str) -> DataFrame:
    return construction.selected(_scored(spark, sf), {"quality": 1.0}, 0.3, within="industry", weighting=Weighting.EQUAL).select(*_SELECTED)


@query("constituents", sql="SELECT effective_date, sum(CASE WHEN index_weight > 0 THEN index_weight * ln(index_weight / benchmark_weight) ELSE 0 END) AS relative_entropy FROM constituents GROUP BY 1")
def relative_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return construction.relative_entropy(v.constituents(spark, sf))


@query()
def minimum_variance_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Least-variance weights of each review's names that have 15 of the 24 months before it, so that any two share six."""
    refs = v.constituents(spark, sf).drop("index_weight")
    past = v.panel(spark, sf).select("instrument_id", "business_date", "price_return").join(refs.select("effective_date", "reference_date", "instrument_id"), "instrument_id")
    past = past.where((F.col("business_date") <= F.col("reference_date")) & (F.col("business_date") > F.add_months("reference_date", -24)))
    known = past.groupBy("effective_date", "instrument_id").agg(F.count("price_return").alias("n")).where("n >= 15").drop("n")
    past, top = past.join(known, ["effective_date", "instrument_id"]), refs.join(known, ["effective_date", "instrument_id"])
    top = top.withColumn("benchmark_weight", F.col("benchmark_weight") / F.sum("benchmark_weight").over(Window.partitionBy("effective_date")))
    return construction.least_variance(top, past, "price_return", Limits(maximum=0.15, groups={"industry": 0.1})).select("effective_date", "instrument_id", "index_weight", "solver_status")


@query()
def entropy_exposure_weights(spark: SparkSession, sf: str) -> DataFrame:
    targets = [Exposure("quality_zscore", 0.3), Exposure("account_balance_zscore", 0.1)]
    return construction.entropy_targets(_scored(spark, sf), targets).select("effective_date", "instrument_id", "index_weight", "solver_status")


@query()
def entropy_exposure_bounded(spark: SparkSession, sf: str) -> DataFrame:
    targets = [Exposure("quality_zscore", 0.2, "at_least")]
    return construction.entropy_targets(_scored(spark, sf), targets, Limits(capacity=2.0), "hard_then_elastic").select("effective_date", "instrument_id", "index_weight", "solver_status")


# -- loading ---------------------------------------------------------------

_EXCLUDED = """WITH ex AS (SELECT effective_date, instrument_id, benchmark_weight, list_filter([CASE WHEN industry = 'ASIA' THEN 'region' END, CASE WHEN NOT quantity >= 20 THEN 'small' END], lambda x: x IS NOT NULL) AS r FROM constituents),
ew AS (SELECT *, len(r) > 0 AS excluded, CASE WHEN len(r) > 0 THEN 0 ELSE benchmark_weight END AS w FROM ex) """


@query("constituents", sql=_EXCLUDED + "SELECT effective_date, instrument_id, excluded, coalesce(array_to_string(r, '+'), '') AS exclusion_reason, w / sum(w) OVER (PARTITION BY effective_date) AS index_weight FROM ew")
def exclusions(spark: SparkSession, sf: str) -> DataFrame:
    c = v.constituents(spark, sf).drop("index_weight").withColumn("large", F.when(F.col("quantity") >= 20, "yes"))
    rule = rules.composed(rules.universe_defaults, rules.exclude([rules.Exclusion("industry", ("ASIA",), "region"), rules.Exclusion("large", ("yes",), "small", only_include=True)]))
    return rule(c).select("effective_date", "instrument_id", "excluded", F.array_join("exclusion_reason", "+").alias("exclusion_reason"), "index_weight")


@query("panel", sql="SELECT *, price_return + gross_dividend AS gross_total_return, price_return + net_dividend AS net_total_return FROM panel WHERE business_date <= DATE '2000-12-31'")
def total_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rules.total_returns(contracts.validate_market_data(v.panel(spark, sf)), "2000-12-31")


@query("constituents", sql="""WITH ob AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument_id, CAST(l_shipdate AS DATE) AS observation_date, max(l_quantity) AS quantity_seen FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
rf AS (SELECT DISTINCT effective_date, reference_date FROM constituents), la AS (SELECT effective_date, instrument_id, max(observation_date) AS observation_date, arg_max(quantity_seen, observation_date) AS quantity_seen FROM ob JOIN rf ON observation_date <= reference_date GROUP BY 1, 2)
SELECT effective_date, instrument_id, la.observation_date, la.quantity_seen FROM constituents LEFT JOIN la USING (effective_date, instrument_id)""")  # fmt: skip
def third_party_as_of(spark: SparkSession, sf: str) -> DataFrame:
    ob = v.table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").cast("string").alias("instrument_id"), F.to_date("l_shipdate").alias("observation_date")).agg(F.max("l_quantity").alias("quantity_seen"))
    return rules.add_third_party(ob, ["quantity_seen"])(v.constituents(spark, sf)).select("effective_date", "instrument_id", "observation_date", "quantity_seen")


@query("constituents", sql="""WITH im AS (SELECT CAST(l_suppkey AS VARCHAR) AS instrument_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS as_of, sum(l_quantity) AS quarter_quantity FROM lineitem GROUP BY 1, 2),
lt AS (SELECT effective_date, max(as_of) AS as_of FROM (SELECT DISTINCT effective_date, reference_date FROM constituents) JOIN (SELECT DISTINCT as_of FROM im) ON as_of <= reference_date GROUP BY 1)
SELECT c.effective_date, c.instrument_id, quarter_quantity FROM constituents c LEFT JOIN lt USING (effective_date) LEFT JOIN im ON im.as_of = lt.as_of AND im.instrument_id = c.instrument_id""")  # fmt: skip
def imported_as_of(spark: SparkSession, sf: str) -> DataFrame:
    im = v.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("instrument_id"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("as_of")).agg(F.sum("l_quantity").alias("quarter_quantity"))
    return rules.imported(im, ["quarter_quantity"], "as_of")(v.constituents(spark, sf)).select("effective_date", "instrument_id", "quarter_quantity")


@query(sql="SELECT CAST(s_suppkey AS VARCHAR) AS instrument_id, bool_or(coalesce(r_name = 'ASIA', false)) AS asia, bool_or(s_acctbal > 0) AS solvent FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", dates=False)
def memberships(spark: SparkSession, sf: str) -> DataFrame:
    i = v.instruments(spark, sf)
    m = i.where("industry = 'ASIA'").select(F.lit("asia").alias("index_id"), "instrument_id", F.lit(True).alias("is_member")).unionByName(i.select(F.lit("solvent").alias("index_id"), "instrument_id", (F.col("account_balance") > 0).alias("is_member")))
    return rules.add_memberships(m, ["asia", "solvent"])(i.select("instrument_id"))


@query(sql="SELECT p_partkey, p_type, (SELECT arg_max(x.n, length(x.p)) FROM (VALUES ('ECONOMY', 'cheap'), ('ECONOMY ', 'cheap'), ('S', 'plain'), ('STANDARD', 'standard'), ('PROMO', 'promo')) x(p, n) WHERE starts_with(upper(p_type), x.p)) AS profile FROM part", dates=False)
def longest_prefix_profiles(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.createDataFrame([("economy", "cheap"), ("economy ", "cheap"), ("s", "plain"), ("standard", "standard"), ("promo", "promo")], "prefix string, profile string")
    return providers.longest_prefix(v.table(spark, sf, "part").select("p_partkey", "p_type"), p, "p_type").select("p_partkey", "p_type", "profile")


_DAYS = "WITH dy AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE isodow(o_orderdate) < 6) "


def _days(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "orders").where(F.weekday("o_orderdate") < 5).select(F.to_date("o_orderdate").alias("business_date")).distinct()


@query(sql=_DAYS + """, an AS (SELECT CAST(unnest(range(DATE '1996-01-01', DATE '2000-12-31', INTERVAL 1 DAY)) AS DATE) AS a), qe AS (SELECT a FROM an WHERE a = last_day(a) AND month(a) % 3 = 0),
rn AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM dy), la AS (SELECT a, max(n) AS n FROM qe JOIN rn ON d <= a GROUP BY 1)
SELECT DISTINCT e.d AS effective_date, r.d AS reference_date FROM la JOIN rn e ON e.n = la.n JOIN rn r ON r.n = la.n - 5 WHERE e.d BETWEEN DATE '1996-01-01' AND DATE '2000-12-30'""", dates="all")  # fmt: skip
def quarterly_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return calendars.schedule(_days(spark, sf), calendars.Frequency.QUARTERLY, "1996-01-01", "2000-12-30", 5)


@query("constituents", sql="SELECT effective_date, reference_date, lag(effective_date) OVER w AS previous_effective_date, lead(effective_date) OVER w AS next_effective_date, lag(reference_date) OVER w AS previous_reference_date, lead(reference_date) OVER w AS next_reference_date FROM (SELECT DISTINCT effective_date, reference_date FROM constituents) WINDOW w AS (ORDER BY effective_date)", dates="all")
def schedule_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return calendars.with_neighbours(v.constituents(spark, sf).select("effective_date", "reference_date").distinct())


@query(sql="WITH ef AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS effective_date FROM orders WHERE o_totalprice > 490000), pe AS (SELECT effective_date, year(effective_date) * 12 + month(effective_date) - 1 AS period FROM ef) SELECT effective_date, CAST(period AS BIGINT) AS period, count(*) OVER (PARTITION BY period) AS reviews_in_period, coalesce(greatest(period - lag(period) OVER (ORDER BY effective_date) - 1, 0), 0) AS missing_periods FROM pe")
def frequency_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    o = v.table(spark, sf, "orders").where("o_totalprice > 490000").select(F.to_date("o_orderdate").alias("effective_date"))
    return calendars.frequency_diagnostics(o, calendars.Frequency.MONTHLY)


@query(sql=_DAYS + ", wd AS (SELECT CAST(unnest(range(DATE '1996-01-01', DATE '1997-01-01', INTERVAL 1 DAY)) AS DATE) AS d), w5 AS (SELECT d FROM wd WHERE isodow(d) < 6), dx AS (SELECT d FROM dy WHERE d < DATE '1998-01-01') SELECT d AS business_date, 'missing' AS problem FROM (SELECT d FROM w5 EXCEPT SELECT d FROM dx) UNION ALL SELECT d, 'unexpected' FROM (SELECT d FROM dx EXCEPT SELECT d FROM w5)")
def business_date_coverage(spark: SparkSession, sf: str) -> DataFrame:
    have = _days(spark, sf).where("business_date < DATE '1998-01-01'")
    return contracts.date_coverage(have, calendars.weekdays(spark, "1996-01-01", "1996-12-31"))


@query("panel", sql="SELECT * FROM panel WHERE business_date = (SELECT max(business_date) FROM panel WHERE business_date < DATE '1999-07-01')")
def latest_cross_section(spark: SparkSession, sf: str) -> DataFrame:
    return rules.latest_before(v.panel(spark, sf), "1999-07-01")


# -- scenarios and comparison ----------------------------------------------

_SCENARIO = scenarios.Scenario("stress", (
    scenarios.Shock("quality", scenarios.Operation.ADD, 0.01, where={"industry": ("ASIA", "EUROPE")}),
    scenarios.Shock("quality", scenarios.Operation.MULTIPLY, 2.0, instruments=("1", "2", "3")),
    scenarios.Shock("market_cap", scenarios.Operation.REPLACE, 0.0, where={"country": ("FRANCE",)}, allow_empty=True),
))
_SHOCKED = "WITH s1 AS (SELECT *, industry IN ('ASIA', 'EUROPE') AS h0, instrument_id IN ('1', '2', '3') AS h1, country = 'FRANCE' AS h2, quality AS q0, CASE WHEN industry IN ('ASIA', 'EUROPE') THEN quality + 0.01 ELSE quality END AS q1 FROM constituents), s2 AS (SELECT *, CASE WHEN h1 THEN q1 * 2 ELSE q1 END AS q2, CASE WHEN h2 THEN 0 ELSE market_cap END AS m2 FROM s1) "


@query("constituents", sql=_SHOCKED + "SELECT effective_date, instrument_id, q2 AS quality, m2 AS market_cap FROM s2")
def scenario_shocks(spark: SparkSession, sf: str) -> DataFrame:
    return scenarios.apply(v.constituents(spark, sf), _SCENARIO).select("effective_date", "instrument_id", "quality", "market_cap")


@query("constituents", sql=_SHOCKED + "SELECT 'stress' AS scenario, 0 AS shock_order, 'quality' AS field, 'add' AS operation, count(*) FILTER (h0) AS selected_count, avg(q0) FILTER (h0) AS before_mean, avg(q1) FILTER (h0) AS after_mean FROM s2 UNION ALL SELECT 'stress', 1, 'quality', 'multiply', count(*) FILTER (h1), avg(q1) FILTER (h1), avg(q2) FILTER (h1) FROM s2 UNION ALL SELECT 'stress', 2, 'market_cap', 'replace', count(*) FILTER (h2), avg(market_cap) FILTER (h2), avg(m2) FILTER (h2) FROM s2", dates=False)
def scenario_audit(spark: SparkSession, sf: str) -> DataFrame:
    return scenarios.audit(v.constituents(spark, sf), _SCENARIO)


_UNIFORM = "((CAST('0x' || substr(md5('17|{k}|quality|' || CAST(effective_date AS VARCHAR) || '|' || instrument_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)"


@query("constituents", sql=f"SELECT effective_date, instrument_id, quality * (1 + 0.1 * sqrt(-2 * ln({_UNIFORM.format(k=0)})) * cos(2 * pi() * {_UNIFORM.format(k=1)})) AS quality FROM constituents")
def noisy_factors(spark: SparkSession, sf: str) -> DataFrame:
    c = v.constituents(spark, sf).select("effective_date", "instrument_id", "quality")
    return scenarios.noisy(c, ["quality"], 0.1, 17, ["effective_date", "instrument_id"], relative=True)


def _candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The index against a tilted one without its first review, and the benchmark itself."""
    c = v.constituents(spark, sf)
    tilted = c.where("effective_date > DATE '1996-06-01'").withColumn("__r", F.col("index_weight") * (0.5 + F.col("quality")))
    tilted = tilted.withColumn("index_weight", F.col("__r") / F.sum("__r").over(Window.partitionBy("effective_date"))).drop("__r")
    return c, {"tilted": tilted, "benchmark": c.withColumn("index_weight", F.col("benchmark_weight"))}


_CAND = """WITH tr AS (SELECT *, index_weight * (0.5 + quality) AS r FROM constituents WHERE effective_date > DATE '1996-06-01'),
ca AS (SELECT 'tilted' AS candidate, effective_date, instrument_id, industry, benchmark_weight, r / sum(r) OVER (PARTITION BY effective_date) AS w FROM tr UNION ALL SELECT 'benchmark', effective_date, instrument_id, industry, benchmark_weight, benchmark_weight FROM constituents),
cd AS (SELECT DISTINCT candidate, effective_date FROM ca JOIN (SELECT DISTINCT effective_date FROM constituents) USING (effective_date)),
bl AS (SELECT candidate, effective_date, instrument_id, index_weight AS baseline_weight FROM constituents JOIN cd USING (effective_date)), cl AS (SELECT candidate, effective_date, instrument_id, w AS candidate_weight FROM ca),
wc AS (SELECT candidate, effective_date, instrument_id, coalesce(baseline_weight, 0) AS baseline_weight, coalesce(candidate_weight, 0) AS candidate_weight, coalesce(candidate_weight, 0) - coalesce(baseline_weight, 0) AS weight_difference FROM bl FULL JOIN cl USING (candidate, effective_date, instrument_id)),
ws AS (SELECT *, abs(weight_difference) AS absolute_weight_difference, CASE WHEN baseline_weight <= 1e-8 AND candidate_weight > 1e-8 THEN 'entrant' WHEN baseline_weight > 1e-8 AND candidate_weight <= 1e-8 THEN 'exit' WHEN candidate_weight > baseline_weight + 1e-8 THEN 'weight_increase' WHEN candidate_weight < baseline_weight - 1e-8 THEN 'weight_decrease' ELSE 'unchanged' END AS status FROM wc) """


@query("constituents", sql=_CAND + "SELECT * FROM ws")
def comparison_weights(spark: SparkSession, sf: str) -> DataFrame:
    base, cands = _candidates(spark, sf)
    return comparison.weights(base, comparison.stacked(cands))


@query("constituents", sql=_CAND + "SELECT candidate, effective_date, 0.5 * sum(absolute_weight_difference) AS one_way_weight_difference, max(absolute_weight_difference) AS maximum_weight_difference, count(*) FILTER (status = 'entrant') AS entrants, count(*) FILTER (status = 'exit') AS exits, count(*) FILTER (status <> 'unchanged') AS changed FROM ws GROUP BY 1, 2")
def comparison_overview(spark: SparkSession, sf: str) -> DataFrame:
    base, cands = _candidates(spark, sf)
    return comparison.overview(comparison.weights(base, comparison.stacked(cands)))


@query("constituents", sql=_CAND + "SELECT n.candidate, b.effective_date, true AS in_baseline, c.effective_date IS NOT NULL AS in_candidate FROM (SELECT DISTINCT effective_date FROM constituents) b CROSS JOIN (SELECT DISTINCT candidate FROM ca) n LEFT JOIN (SELECT DISTINCT candidate, effective_date FROM ca) c ON c.candidate = n.candidate AND c.effective_date = b.effective_date")
def comparison_coverage(spark: SparkSession, sf: str) -> DataFrame:
    base, cands = _candidates(spark, sf)
    return comparison.coverage(base, comparison.stacked(cands))


@query("constituents", sql=_CAND + ", be AS (SELECT n.candidate, effective_date, industry, sum(index_weight) AS baseline_value FROM constituents CROSS JOIN (SELECT DISTINCT candidate FROM ca) n GROUP BY 1, 2, 3), ce AS (SELECT candidate, effective_date, industry, sum(w) AS candidate_value FROM ca GROUP BY 1, 2, 3) SELECT candidate, effective_date, industry, coalesce(baseline_value, 0) AS baseline_value, coalesce(candidate_value, 0) AS candidate_value, coalesce(candidate_value, 0) - coalesce(baseline_value, 0) AS difference FROM be FULL JOIN ce USING (candidate, effective_date, industry)")
def comparison_exposures(spark: SparkSession, sf: str) -> DataFrame:
    base, cands = _candidates(spark, sf)
    return comparison.exposure_differences(base, comparison.stacked(cands), "industry")


@query("constituents", sql=_CAND + """, bm AS (SELECT effective_date, max(index_weight) AS max_weight, sum(index_weight * index_weight) AS hhi, 0.5 * sum(abs(index_weight - benchmark_weight)) AS active_share FROM constituents GROUP BY 1), cm AS (SELECT candidate, effective_date, max(w) AS max_weight, sum(w * w) AS hhi, 0.5 * sum(abs(w - benchmark_weight)) AS active_share FROM ca GROUP BY 1, 2),
pj AS (SELECT candidate, effective_date, unnest(['max_weight', 'hhi', 'active_share']) AS metric, unnest([bm.max_weight, bm.hhi, bm.active_share]) AS baseline_value, unnest([cm.max_weight, cm.hhi, cm.active_share]) AS candidate_value FROM bm JOIN cm USING (effective_date)) SELECT *, candidate_value - baseline_value AS difference FROM pj""")  # fmt: skip
def comparison_metrics(spark: SparkSession, sf: str) -> DataFrame:
    base, cands = _candidates(spark, sf)
    return comparison.review_metric_differences(base, cands).where(F.col("metric").isin("max_weight", "hhi", "active_share"))

