"""Queries of providers, loading rules, contracts, stores, caches, runs and solver checks; importing this registers them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import comparison, construction, events, performance, quality, reviews, scenarios, simulation
from .operators.construction import Exposure, Limits
from .plans import caches, recipes, report, runs, segments, store
from .queries import BENCH, INDEX, _rolling_sql, query
from .queries_build import _Z, _scored
from .queries_sim import _DAILY, _LOOP, _sim_sql
from .sources import calendars, contracts, providers, rules
from .sources import views as v

# -- providers ---------------------------------------------------------------

_YEARS = "DATE '1996-02-01' AND DATE '1997-11-30'"


def _lake(spark: SparkSession, sf: str) -> providers.Registry:
    """The derived tables behind a provider of each capability."""
    i, c, p = v.instruments(spark, sf), v.constituents(spark, sf), v.panel(spark, sf)
    quarters = p.select("instrument_id", F.last_day(F.date_trunc("quarter", "business_date")).alias("as_of"), "quantity").groupBy("instrument_id", "as_of").agg(F.max("quantity").alias("quarter_quantity"))
    members = i.select(F.lower("industry").alias("index_id"), "instrument_id", F.lit(True).alias("is_member"))
    third = p.select(F.lit("margin").alias("data_type"), "instrument_id", F.col("business_date").alias("observation_date"), "margin")
    lake = providers.TableProvider({
        "universe": c.withColumn("universe_id", F.lit("all")), "calendar": p.select("business_date").distinct(), "market_data": p,
        "membership": members, "reference_data": quarters, "third_party": third,
    })
    registry = providers.Registry()
    for capability in providers.CAPABILITIES:
        registry.register("lake", capability, lake)
    return registry


@query("constituents", sql="SELECT effective_date, reference_date, instrument_id, benchmark_weight FROM constituents WHERE reference_date = DATE '1996-12-01' AND effective_date = DATE '1997-01-01'")
def provider_universe(spark: SparkSession, sf: str) -> DataFrame:
    u = _lake(spark, sf).resolve("lake", "universe").load_universe("all", "1996-12-01", "1997-01-01")
    return u.select("effective_date", "reference_date", "instrument_id", "benchmark_weight")


@query("constituents", sql="SELECT effective_date, instrument_id, index_weight FROM constituents WHERE effective_date BETWEEN DATE '1995-06-01' AND DATE '1998-01-01'")
def provider_history(spark: SparkSession, sf: str) -> DataFrame:
    return _lake(spark, sf).resolve("lake", "history").load_constituent_history("all", "1995-06-01", "1998-01-01").select("effective_date", "instrument_id", "index_weight")


@query("panel", sql=f"SELECT DISTINCT business_date FROM panel WHERE business_date BETWEEN {_YEARS}", dates="all")
def provider_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return _lake(spark, sf).resolve("lake", "calendar").business_days("monthly", "1996-02-01", "1997-11-30")


@query("panel", "instruments", sql=f"SELECT p.* FROM panel p WHERE business_date BETWEEN {_YEARS} AND instrument_id IN (SELECT instrument_id FROM instruments WHERE industry = 'ASIA')")
def provider_market_data(spark: SparkSession, sf: str) -> DataFrame:
    asia = v.instruments(spark, sf).where("industry = 'ASIA'")
    return _lake(spark, sf).resolve("lake", "market_data").load_daily_market_data(asia, "1996-02-01", "1997-11-30")


@query("instruments", sql="SELECT 'asia' AS index_id, instrument_id, true AS is_member FROM instruments WHERE industry = 'ASIA'", dates=False)
def provider_membership(spark: SparkSession, sf: str) -> DataFrame:
    return _lake(spark, sf).resolve("lake", "membership").load_membership("asia", "1996-01-01", "1997-01-01")


@query("panel", "instruments", sql="SELECT instrument_id, arg_max(q, as_of) AS quarter_quantity FROM (SELECT instrument_id, last_day(date_trunc('quarter', business_date)) AS as_of, max(quantity) AS q FROM panel GROUP BY 1, 2) WHERE as_of <= DATE '1997-03-15' AND instrument_id IN (SELECT instrument_id FROM instruments WHERE account_balance > 0) GROUP BY 1", dates=False)
def provider_reference_data(spark: SparkSession, sf: str) -> DataFrame:
    """Facts as they were known on the reference date: nothing later is seen."""
    solvent = v.instruments(spark, sf).where("account_balance > 0")
    return _lake(spark, sf).resolve("lake", "reference_data").load_reference_data(solvent, "1997-03-15", ["quarter_quantity"])


@query("panel", sql="SELECT instrument_id, business_date AS observation_date, margin FROM panel")
def provider_third_party(spark: SparkSession, sf: str) -> DataFrame:
    return _lake(spark, sf).resolve("lake", "third_party").load_third_party_data("margin", v.instruments(spark, sf), ["margin"], "1997-03-15")


@query(sql="SELECT CAST(n_nationkey AS INTEGER) AS n_nationkey, n_name, CAST(n_regionkey AS INTEGER) AS n_regionkey FROM nation", dates=False)
def provider_csv(spark: SparkSession, sf: str) -> DataFrame:
    """A table written as CSV and read by the provider of files."""
    path = f"{store.temporary(spark).root}/nations.csv"
    v.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(path)
    return providers.FileProvider(spark).read(path)


@query(sql="SELECT 'file' AS capability, true AS same_bytes, true AS has_digest FROM region LIMIT 1", dates=False)
def provider_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of a file's bytes is the same for a copy elsewhere."""
    found = [providers.FileProvider(spark).describe_snapshot("file", {"file_path": f"{sf}/region.parquet"}) for _ in range(2)]
    return spark.createDataFrame([(found[0]["capability"], found[0] == found[1], len(found[0]["sha256"][0]) == 64)], "capability string, same_bytes boolean, has_digest boolean")


# -- loading rules -------------------------------------------------------------


@query("constituents", sql="SELECT effective_date, instrument_id, benchmark_weight AS index_weight, false AS excluded, 0 AS reasons FROM constituents")
def rule_defaults(spark: SparkSession, sf: str) -> DataFrame:
    d = rules.universe_defaults(v.constituents(spark, sf).drop("index_weight"))
    return d.select("effective_date", "instrument_id", "index_weight", "excluded", F.size("exclusion_reason").alias("reasons"))


_FACTS = "WITH fa AS (SELECT instrument_id, avg(quantity) AS mean_quantity FROM panel WHERE business_date < DATE '1997-01-01' GROUP BY 1) "


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return v.panel(spark, sf).where("business_date < DATE '1997-01-01'").groupBy("instrument_id").agg(F.avg("quantity").alias("mean_quantity"))


@query("constituents", sql=_FACTS + "SELECT effective_date, instrument_id, mean_quantity FROM constituents LEFT JOIN fa USING (instrument_id)")
def rule_facts(spark: SparkSession, sf: str) -> DataFrame:
    return v.constituents(spark, sf).transform(rules.add_facts(_facts(spark, sf))).select("effective_date", "instrument_id", "mean_quantity")


@query("constituents", sql="SELECT DISTINCT instrument_id FROM panel WHERE instrument_id NOT IN (SELECT instrument_id FROM constituents WHERE effective_date = DATE '1997-01-01')", dates=False)
def rule_unknown_instruments(spark: SparkSession, sf: str) -> DataFrame:
    return rules.unknown_instruments(v.constituents(spark, sf).where("effective_date = DATE '1997-01-01'"), v.panel(spark, sf))


@query("constituents", sql="""WITH ex AS (SELECT effective_date, instrument_id, benchmark_weight, coalesce(industry = 'ASIA', false) AS out, total FROM constituents JOIN (SELECT instrument_id, avg(quantity) AS total FROM panel GROUP BY 1) USING (instrument_id))
SELECT effective_date, instrument_id, CASE WHEN out THEN 0 ELSE benchmark_weight END / sum(CASE WHEN out THEN 0 ELSE benchmark_weight END) OVER (PARTITION BY effective_date) AS index_weight, total AS mean_quantity FROM ex""")  # fmt: skip
def rules_composed(spark: SparkSession, sf: str) -> DataFrame:
    """Defaults, facts and exclusions as one rule, in order."""
    facts = v.panel(spark, sf).groupBy("instrument_id").agg(F.avg("quantity").alias("mean_quantity"))
    rule = rules.composed(rules.universe_defaults, rules.add_facts(facts), rules.exclude([rules.Exclusion("industry", ("ASIA",), "region")]))
    return rule(v.constituents(spark, sf).drop("index_weight")).select("effective_date", "instrument_id", "index_weight", "mean_quantity")


def _excluded(spark: SparkSession, sf: str) -> DataFrame:
    c = rules.universe_defaults(v.constituents(spark, sf))
    return c.withColumn("excluded", F.col("country") == "FRANCE").withColumn("exclusion_reason", F.when(F.col("excluded"), F.array(F.lit("country"))).otherwise(F.array().cast("array<string>")))


@query("constituents", sql="SELECT effective_date, instrument_id, index_weight, 'country' AS reason FROM constituents WHERE country = 'FRANCE' AND index_weight > 1e-8")
def exclusion_violations(spark: SparkSession, sf: str) -> DataFrame:
    return rules.exclusion_violations(_excluded(spark, sf)).select("effective_date", "instrument_id", "index_weight", F.array_join("exclusion_reason", "+").alias("reason"))


@query("constituents", sql="SELECT effective_date, instrument_id, country FROM constituents WHERE country <> 'FRANCE'")
def visible_columns(spark: SparkSession, sf: str) -> DataFrame:
    return rules.visible(_excluded(spark, sf), ["effective_date", "instrument_id", "country"])


@query("constituents", sql="SELECT effective_date, instrument_id, CASE WHEN country = 'FRANCE' THEN NULL WHEN industry = 'ASIA' THEN quality * 2 ELSE quality END AS quality, CASE WHEN industry = 'ASIA' OR country = 'FRANCE' THEN 'new' END AS note FROM constituents")
def upserted_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Values of some keys replaced, by null too, and a column added."""
    c = v.constituents(spark, sf).select("effective_date", "instrument_id", "country", "industry", "quality")
    update = c.where("industry = 'ASIA' OR country = 'FRANCE'").select("effective_date", "instrument_id", F.when(F.col("country") != "FRANCE", F.col("quality") * 2).alias("quality"), F.lit("new").alias("note"))
    return rules.upserted(c, update, ["quality", "note"]).select("effective_date", "instrument_id", "quality", "note")


# -- contracts -------------------------------------------------------------------


@query("constituents", sql="""WITH us AS (SELECT *, CASE WHEN industry = 'ASIA' THEN NULL ELSE instrument_id END AS id, CASE WHEN country = 'FRANCE' THEN 1.5 ELSE 0.5 END AS ff, CASE WHEN country = 'CHINA' THEN 0 ELSE 1 END AS fx, CASE WHEN country = 'BRAZIL' THEN -1.0 ELSE quantity END AS shares FROM constituents)
SELECT unnest(['empty', 'null ids', 'repeated ids', 'shares not finite or negative', 'price not finite or negative', 'market_cap not finite or negative', 'benchmark_weight not finite or negative', 'free_float not finite or negative', 'fx_rate not finite or negative', 'free_float above 1', 'fx_rate not positive', 'benchmark does not sum to 1', 'not one date pair', 'reference after effective', 'null dates']) AS problem,
 unnest([0, count(*) FILTER (id IS NULL), 0, count(*) FILTER (shares < 0), 0, 0, 0, 0, 0, count(*) FILTER (ff > 1), count(*) FILTER (fx <= 0), count(DISTINCT effective_date), 0, 0, 0]) AS "count" FROM us""", dates=False)  # fmt: skip
def contract_universe(spark: SparkSession, sf: str) -> DataFrame:
    """A universe with planted faults, counted rule by rule."""
    c = v.constituents(spark, sf)
    at = lambda country, bad, good: F.when(F.col("country") == country, F.lit(bad)).otherwise(good)
    u = c.withColumns({
        "instrument_id": F.when(F.col("industry") != "ASIA", F.col("instrument_id")), "name": F.lit("n"), "currency": F.lit("USD"), "base_currency": F.lit("USD"), "shares": at("BRAZIL", -1.0, F.col("quantity")),
        "price": F.lit(1.0), "free_float": at("FRANCE", 1.5, F.lit(0.5)), "fx_rate": at("CHINA", 0.0, F.lit(1.0)), "benchmark_weight": F.col("benchmark_weight") / 2,
    })
    contracts.require_columns(u, contracts.UNIVERSE, "universe")
    return contracts.universe_errors(u)


@query("panel", sql="SELECT unnest(['null keys', 'repeated keys', 'after the cutoff']) AS problem, unnest([0, count(*) FILTER (business_date < DATE '1996-06-01'), count(*) FILTER (business_date > DATE '1998-01-01')]) AS \"count\" FROM panel", dates=False)
def contract_market_data(spark: SparkSession, sf: str) -> DataFrame:
    p = v.panel(spark, sf)
    return contracts.market_data_errors(p.unionByName(p.where("business_date < DATE '1996-06-01'")), "1998-01-01")


@query("constituents", sql="WITH sc AS (SELECT DISTINCT effective_date, CASE WHEN year(effective_date) = 1998 THEN effective_date + INTERVAL 1 DAY ELSE reference_date END AS reference_date FROM constituents) SELECT unnest(['null dates', 'repeated', 'reference after effective']) AS problem, unnest([0, 1, count(*) FILTER (reference_date > effective_date)]) AS \"count\" FROM sc", dates=False)
def contract_schedule(spark: SparkSession, sf: str) -> DataFrame:
    s = v.constituents(spark, sf).select("effective_date", F.when(F.year("effective_date") == 1998, F.date_add("effective_date", 1)).otherwise(F.col("reference_date")).alias("reference_date")).distinct()
    return contracts.schedule_errors(s.unionByName(s.orderBy("effective_date").limit(1)))


@query("constituents", sql="SELECT unnest(['not finite or negative', 'groups that do not sum to 1']) AS problem, unnest([count(*) FILTER (country = 'FRANCE' AND index_weight > 0), count(DISTINCT effective_date) FILTER (country = 'FRANCE' AND index_weight > 0)]) AS \"count\" FROM constituents", dates=False)
def contract_weights(spark: SparkSession, sf: str) -> DataFrame:
    c = v.constituents(spark, sf)
    return contracts.weight_errors(c.withColumn("index_weight", F.when(F.col("country") == "FRANCE", -F.col("index_weight")).otherwise(F.col("index_weight"))))


@query("constituents", "instruments", sql="SELECT count(*) AS held, count(*) FILTER (o.instrument_id IS NULL) AS missing FROM (SELECT instrument_id FROM constituents WHERE effective_date = DATE '1997-01-01') h LEFT JOIN (SELECT instrument_id FROM panel WHERE business_date = DATE '1997-03-01') o USING (instrument_id)", dates=False)
def held_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Names held on a date, and those of them without an observation on another."""
    held = v.constituents(spark, sf).where("effective_date = DATE '1997-01-01'").select("instrument_id")
    seen = v.panel(spark, sf).where("business_date = DATE '1997-03-01'").select("instrument_id", F.lit(1).alias("seen"))
    return held.join(seen, "instrument_id", "left").agg(F.count("*").alias("held"), F.count_if(F.col("seen").isNull()).alias("missing"))


# -- calendars -------------------------------------------------------------------


@query(sql="SELECT greatest(DATE '1996-01-17', m) AS start_date, least(DATE '1998-03-09', last_day(m)) AS end_date FROM (SELECT CAST(unnest(range(DATE '1996-01-01', DATE '1998-03-31', INTERVAL 1 MONTH)) AS DATE) AS m)", dates="all")
def month_partitions(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(calendars.month_partitions("1996-01-17", "1998-03-09"), "start_date string, end_date string")


@query("constituents", sql="SELECT DISTINCT effective_date, reference_date FROM constituents", dates="all")
def schedules_concatenated(spark: SparkSession, sf: str) -> DataFrame:
    s = v.constituents(spark, sf).select("effective_date", "reference_date").distinct()
    return calendars.concatenated(s.where("effective_date < DATE '1997-06-01'"), s.where("effective_date > DATE '1995-06-01'"))


@query("constituents", sql="SELECT DISTINCT effective_date FROM constituents", dates="all")
def schedule_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """A schedule that passes as annual."""
    return calendars.validate_frequency(v.constituents(spark, sf).select("effective_date").distinct(), calendars.Frequency.ANNUAL, gaps_ok=False)


# -- stores, caches and runs --------------------------------------------------------


@query("constituents", sql="SELECT effective_date, instrument_id, index_weight FROM constituents")
def store_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A table saved, bound, resolved and loaded again with its digest checked."""
    s = store.temporary(spark)
    s.bind("weights", "k", "w", s.save(v.constituents(spark, sf).select("effective_date", "instrument_id", "index_weight"), ["effective_date", "instrument_id"]))
    found = s.resolve("weights", "k", "w")
    assert found is not None
    return s.load(found)


_BOUND = "SELECT 'weights' AS stage, 'all' AS name, 'approved' AS status, count(*) AS \"rows\" FROM constituents UNION ALL SELECT 'weights', 'copy', 'draft', count(*) FROM constituents UNION ALL SELECT 'old', 'late', 'invalidated', count(*) FROM constituents WHERE effective_date > DATE '1997-06-01'"


def _bound(spark: SparkSession, sf: str) -> store.Store:
    s, c = store.temporary(spark), v.constituents(spark, sf).select("effective_date", "instrument_id", "index_weight")
    whole, late = s.save(c), s.save(c.where("effective_date > DATE '1997-06-01'"))
    for stage, name, reference in (("weights", "all", whole), ("weights", "copy", s.save(c.orderBy("index_weight"))), ("old", "late", late)):
        s.bind(stage, name, name, reference)
    s.set_status("weights", "all", "approved")
    s.invalidate("old")
    return s


@query("constituents", sql=_BOUND, dates=False)
def store_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Bindings and their states after changes; equal tables are one object."""
    return _bound(spark, sf).catalog().select("stage", "name", "status", "rows")


@query("constituents", sql=_BOUND.replace("approved", "draft").replace("invalidated", "draft"), dates=False)
def store_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog made again from what lies beside the tables."""
    s = _bound(spark, sf)
    s.rebuild_catalog()
    return s.catalog().select("stage", "name", "status", "rows")


@query(sql="SELECT 2 AS objects, 1 AS pruned, 0 AS damaged, 'weights' AS latest_stage", dates=False)
def store_maintenance(spark: SparkSession, sf: str) -> DataFrame:
    """Objects, those that no valid binding names, and what verification finds after these are gone."""
    s = _bound(spark, sf)
    objects, gone = len(s._objects()), s.prune(dry_run=False, older_than=0)
    s._append(s.catalog().where("status <> 'invalidated'"))
    damaged = [p for p in s.verify() if p not in gone]
    latest = s.latest("weights")
    return spark.createDataFrame([(objects, len(gone), len(damaged), latest["stage"] if latest else "")], "objects int, pruned int, damaged int, latest_stage string")


@query("panel", sql="SELECT business_date, instrument_id, price_return FROM panel WHERE business_date BETWEEN DATE '1995-03-01' AND DATE '1996-08-31'")
def cached_market_data(spark: SparkSession, sf: str) -> DataFrame:
    """A range of which some months are stored already: the rest is asked for once, and nothing twice."""
    p = v.panel(spark, sf).select("business_date", "instrument_id", "price_return")
    load = lambda a, z: p.where(F.col("business_date").between(F.lit(a).cast("date"), F.lit(z).cast("date")))
    cache = caches.SourceCache(store.temporary(spark), "market_data", {"provider": "lake"}, load)
    cache.load("1995-06-10", "1995-09-20")
    out = cache.load("1995-03-01", "1996-08-31")
    cache.load("1995-04-02", "1996-01-31")
    if cache.requests != [("1995-06-01", "1995-09-30"), ("1995-03-01", "1995-05-31"), ("1995-10-01", "1996-08-31")]:
        raise AssertionError(f"asked for {cache.requests}")
    return out


@query(sql="WITH dy AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS business_date FROM orders WHERE isodow(o_orderdate) < 6) SELECT business_date FROM dy WHERE business_date BETWEEN DATE '1996-01-10' AND DATE '1996-05-05'", dates="all")
def cached_business_days(spark: SparkSession, sf: str) -> DataFrame:
    days = v.table(spark, sf, "orders").where(F.weekday("o_orderdate") < 5).select(F.to_date("o_orderdate").alias("business_date")).distinct()
    cache = caches.BusinessDayCache(store.temporary(spark), "orders", lambda a, z: days.where(F.col("business_date").between(F.lit(a).cast("date"), F.lit(z).cast("date"))))
    cache.load("1996-02-01", "1996-03-31")
    return cache.load("1996-01-10", "1996-05-05").select("business_date")


def _recorded(spark: SparkSession, sf: str) -> tuple[runs.Runs, list[str]]:
    c = v.constituents(spark, sf).select("effective_date", "instrument_id", "index_weight")
    held = runs.Runs(store.temporary(spark))
    ids = [held.record({"name": "a"}, {"weights": c, "late": c.where("effective_date > DATE '1997-06-01'")}), held.record({"name": "a"}, {"weights": c}), held.record({"name": "b"}, {"weights": c.where("index_weight > 0")})]
    return held, ids


@query("constituents", sql="SELECT 'a' AS definition, 2 AS runs, 'weights' AS \"table\", 2 AS runs_with_table, 2 * count(*) AS \"rows\" FROM constituents UNION ALL SELECT 'a', 2, 'late', 1, count(*) FROM constituents WHERE effective_date > DATE '1997-06-01' UNION ALL SELECT 'b', 1, 'weights', 1, count(*) FROM constituents WHERE index_weight > 0", dates=False)
def run_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Which tables the runs of each definition have."""
    held, _ = _recorded(spark, sf)
    names = spark.createDataFrame([(recipes.digest({"name": n}), n) for n in "ab"], "fingerprint string, definition string")
    return held.coverage().join(names, "fingerprint").drop("fingerprint")


@query("constituents", sql="SELECT effective_date, instrument_id, index_weight FROM constituents")
def run_rehydrated(spark: SparkSession, sf: str) -> DataFrame:
    """The weights of the newest run of a definition, read from where they are stored."""
    held, ids = _recorded(spark, sf)
    found = held.latest({"name": "a"})
    assert found == ids[1] and held.latest() == ids[2]
    return held.rehydrate(found).tables["weights"]


@query("constituents", sql="SELECT 'late' AS \"table\", count(*) AS \"rows\", 3 AS \"columns\" FROM constituents WHERE effective_date > DATE '1997-06-01' UNION ALL SELECT 'weights', count(*), 3 FROM constituents", dates=False)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    held, ids = _recorded(spark, sf)
    return runs.summary(held.rehydrate(ids[0])).drop("run_id")


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return v.panel(spark, sf), simulation.both_portfolios(v.constituents(spark, sf))


@query("constituents", sql=_LOOP + _DAILY)
def simulation_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """A run stopped in mid-segment and resumed from its stored checkpoint: the two parts are the whole run."""
    panel, weights = _parts(spark, sf)
    how = {"gaps": simulation.Gaps.CARRY}
    s = store.temporary(spark)
    first = panel.where("business_date <= DATE '1998-05-01'")
    h = simulation.held(first, weights.where("effective_date <= DATE '1998-05-01'"), **how)
    before = simulation.daily(h)
    s.bind("checkpoint", "k", "state", s.save(simulation.checkpoint(h, before, "1998-05-01")))
    state = s.load(s.resolve("checkpoint", "k", "state"))
    return simulation.combined([before, simulation.resumed(state, panel, weights, **how)])


@query("constituents", sql=_LOOP + _DAILY)
def simulation_warm(spark: SparkSession, sf: str) -> DataFrame:
    """A longer run whose first segments another run has stored: those are read, the rest is computed.

    Both runs read one stored copy of their inputs: made again, sums could differ in their last digits, and segments would not be known again.
    """
    s, how = store.temporary(spark), {"drift": "price"}
    panel, weights = (s.load(s.save(d), verify=False) for d in _parts(spark, sf))
    short = simulation.held(panel.where("business_date < DATE '1998-01-01'"), weights.where("effective_date < DATE '1998-01-01'"), gaps=simulation.Gaps.CARRY)
    _, cold = segments.daily(s, short, how)
    whole = simulation.held(panel, weights, gaps=simulation.Gaps.CARRY)
    out, warm = segments.daily(s, whole, how)
    again, last = segments.daily(s, whole, how)
    if cold.reused or warm.reused != cold.computed or last.computed:
        raise AssertionError(f"{cold}, {warm}, {last}")
    return again


@query("constituents", sql="SELECT (SELECT max(effective_date) FROM constituents WHERE effective_date <= DATE '1999-06-15' AND effective_date < (SELECT max(effective_date) FROM constituents WHERE effective_date <= DATE '1999-06-15')) AS seed_date", dates="all")
def simulation_seed(spark: SparkSession, sf: str) -> DataFrame:
    return simulation.seed_start(v.constituents(spark, sf), "1999-06-15")


_REPLAY = _sim_sql(False, "price").replace("FROM constituents)", "FROM constituents WHERE effective_date >= DATE '1998-01-01')", 2)


@query("constituents", sql=_REPLAY + """, lv AS (SELECT business_date, net_total - 1 AS r, 100 * product(net_total) OVER (ORDER BY business_date) AS l FROM fa WHERE portfolio = 'index'), fr AS (SELECT * FROM lv WHERE business_date >= DATE '1999-06-15')
SELECT business_date, r AS index_net_total_return, l * 100 * (1 + first_value(r) OVER (ORDER BY business_date)) / first_value(l) OVER (ORDER BY business_date) AS index_net_total_level FROM fr""")  # fmt: skip
def simulation_replayed(spark: SparkSession, sf: str) -> DataFrame:
    """A run that starts in mid-period: replayed from the second-latest review before it, then cut and rebased."""
    panel, weights = _parts(spark, sf)
    seed = simulation.seed_start(weights, "1999-06-15").first()["seed_date"]
    d = simulation.daily(simulation.held(panel, weights.where(F.col("effective_date") >= F.lit(seed)), gaps=simulation.Gaps.CARRY))
    return simulation.replayed(d.select("business_date", "index_net_total_return", "index_net_total_level"), "1999-06-15")


# -- construction checks ---------------------------------------------------------


@query("constituents", sql=_Z + "SELECT effective_date, count(*) AS names, true AS sums_to_one, true AS meets_targets, true AS is_tilt FROM zz GROUP BY 1")
def entropy_optimality(spark: SparkSession, sf: str) -> DataFrame:
    """Least-entropy weights have a certificate: their logarithm over the benchmark's is linear in the exposures, and targets are met."""
    targets = [Exposure("quality_zscore", 0.3), Exposure("account_balance_zscore", 0.1)]
    d = construction.entropy_targets(_scored(spark, sf), targets)
    x1, x2, w = F.col("quality_zscore"), F.col("account_balance_zscore"), F.col("index_weight")
    y = F.ln(w / F.col("benchmark_weight"))
    g = d.groupBy("effective_date").agg(
        F.count("*").alias("names"), F.sum(w).alias("s"), F.sum(w * x1).alias("e1"), F.sum(w * x2).alias("e2"), F.covar_pop(x1, x1).alias("a"), F.covar_pop(x1, x2).alias("b"), F.covar_pop(x2, x2).alias("c"),
        F.covar_pop(x1, y).alias("p"), F.covar_pop(x2, y).alias("q"), F.var_pop(y).alias("v"),
    )
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    b1, b2 = (F.col("p") * F.col("c") - F.col("q") * F.col("b")) / det, (F.col("a") * F.col("q") - F.col("b") * F.col("p")) / det
    left = F.abs(F.col("v") - b1 * F.col("p") - b2 * F.col("q"))
    met = (F.abs(F.col("e1") - 0.3) < 1e-7) & (F.abs(F.col("e2") - 0.1) < 1e-7)
    return g.select("effective_date", "names", (F.abs(F.col("s") - 1) < 1e-9).alias("sums_to_one"), met.alias("meets_targets"), (left < 1e-9 * F.greatest("v", F.lit(1.0))).alias("is_tilt"))


@query("constituents", sql="SELECT effective_date, count(*) AS names, 0 AS above_capacity, 0 AS above_maximum, true AS sums_to_one FROM constituents GROUP BY 1")
def projection_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Projected weights keep every limit."""
    limits = Limits(maximum=0.5, capacity=3.0, groups={"industry": 0.02})
    d = construction.projected(v.constituents(spark, sf), limits)
    w, b = F.col("index_weight"), F.col("benchmark_weight")
    return d.groupBy("effective_date").agg(F.count("*").alias("names"), F.count_if(w > 3 * b + 1e-7).alias("above_capacity"), F.count_if(w > 0.5 + 1e-7).alias("above_maximum"), (F.abs(F.sum(w) - 1) < 1e-7).alias("sums_to_one"))


@query("constituents", sql="SELECT effective_date, instrument_id, least(0.2, 2.5 * benchmark_weight, market_cap * 0.2 / 1e6) AS upper FROM constituents")
def weight_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Upper bounds of each weight from a maximum, a multiple of the benchmark and what can be traded."""
    return construction.bounds(v.constituents(spark, sf), Limits(maximum=0.2, capacity=2.5, liquid="market_cap", portfolio_value=1e6, participation=0.2)).select("effective_date", "instrument_id", "upper")


@query("constituents", sql="""WITH cv AS (SELECT effective_date, 'asia' AS constraint_name, sum(CASE WHEN industry = 'ASIA' THEN index_weight ELSE 0 END) AS "value", 0.1 AS "lower", 0.2 AS "upper" FROM constituents GROUP BY 1 UNION ALL SELECT effective_date, 'budget', sum(index_weight), 1.0, 1.0 FROM constituents GROUP BY 1)
SELECT *, "value" - "lower" AS lower_slack, "upper" - "value" AS upper_slack, CASE WHEN greatest("lower" - "value", "value" - "upper", 0) > 1e-7 THEN 'violated' WHEN least("value" - "lower", "upper" - "value") <= 1e-7 THEN 'binding' ELSE 'satisfied' END AS status FROM cv""")  # fmt: skip
def constraint_report(spark: SparkSession, sf: str) -> DataFrame:
    c = v.constituents(spark, sf)
    i = v.instruments(spark, sf)
    coefficients = i.select(F.lit("asia").alias("constraint_name"), "instrument_id", (F.col("industry") == "ASIA").cast("double").alias("coefficient")).unionByName(i.select(F.lit("budget").alias("constraint_name"), "instrument_id", F.lit(1.0).alias("coefficient")))
    bounds = spark.createDataFrame([("asia", 0.1, 0.2), ("budget", 1.0, 1.0)], "constraint_name string, lower double, upper double")
    return construction.constraint_report(c, coefficients, bounds).drop("violation")


# -- scenarios, comparison, reports ------------------------------------------------


@query("constituents", sql="SELECT effective_date, 'base' AS scenario, sum(index_weight * quality) AS exposure FROM constituents GROUP BY 1 UNION ALL SELECT effective_date, 'asia_up', sum(index_weight * CASE WHEN industry = 'ASIA' THEN quality + 0.01 ELSE quality END) FROM constituents GROUP BY 1 UNION ALL SELECT effective_date, 'double', sum(index_weight * quality * 2) FROM constituents GROUP BY 1")
def scenario_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """An evaluator over the base and each scenario, as one plan."""
    made = [scenarios.Scenario("asia_up", (scenarios.Shock("quality", scenarios.Operation.ADD, 0.01, where={"industry": ("ASIA",)}),)), scenarios.Scenario("double", (scenarios.Shock("quality", scenarios.Operation.MULTIPLY, 2.0),))]
    return scenarios.evaluate(v.constituents(spark, sf), made, lambda d: d.groupBy("effective_date").agg(F.sum(F.col("index_weight") * F.col("quality")).alias("exposure")))


@query("instruments", sql="SELECT count(*) AS draws, true AS all_known, count(*) AS numbers FROM instruments", dates=False)
def bootstrap_draws(spark: SparkSession, sf: str) -> DataFrame:
    """As many draws as rows, each of a row that there is, numbered without gaps."""
    i = v.instruments(spark, sf)
    d = scenarios.bootstrap(i, 5)
    known = d.join(i.select(F.col("instrument_id"), F.lit(True).alias("there")), "instrument_id", "left")
    return known.agg(F.count("*").alias("draws"), F.bool_and(F.coalesce("there", F.lit(False))).alias("all_known"), F.count_distinct("draw").alias("numbers"))


@query(sql="SELECT 'ok' AS name, CAST(count(*) AS VARCHAR) AS outcome FROM region UNION ALL SELECT 'broken', 'ValueError: planned' FROM nation WHERE n_nationkey = 0", dates=False)
def run_batch(spark: SparkSession, sf: str) -> DataFrame:
    def fail() -> object:
        raise ValueError("planned")

    out = scenarios.run_batch([("ok", lambda: v.table(spark, sf, "region").count()), ("broken", fail)], continue_on_error=True)
    return spark.createDataFrame([(o.name, o.error or str(o.result)) for o in out], "name string, outcome string")


_META = [{"currency": "USD", "calendar_id": "monthly", "provider": "lake"}, {"currency": "USD", "calendar_id": "monthly", "provider": "files"}]


@query(sql="SELECT unnest(['calendar_id', 'currency', 'provider']) AS field, unnest(['monthly', 'USD', 'lake']) AS baseline_value, unnest(['monthly', 'USD', 'files']) AS candidate_value, unnest([true, true, false]) AS is_equal, 'b' AS candidate", dates=False)
def comparison_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(comparison.compatibility(_META[0], {"b": _META[1]}), "candidate string, field string, baseline_value string, candidate_value string, is_equal boolean")


@query(sql="SELECT 'b' AS candidate, unnest(['limits.maximum', 'tilts.size']) AS parameter, unnest(['0.1', 'null']) AS baseline_value, unnest(['0.2', '1']) AS candidate_value", dates=False)
def comparison_parameters(spark: SparkSession, sf: str) -> DataFrame:
    rows = comparison.parameter_differences({"limits": {"maximum": 0.1, "minimum": 0}}, {"b": {"limits": {"maximum": 0.2, "minimum": 0}, "tilts": {"size": 1}}})
    return spark.createDataFrame([{k: x if k in ("candidate", "parameter") else json.dumps(x) for k, x in r.items()} for r in rows], "candidate string, parameter string, baseline_value string, candidate_value string")


_TURN = "WITH tu AS (SELECT effective_date, 0.5 * sum(abs(index_weight - benchmark_weight)) AS base FROM constituents GROUP BY 1) "


@query("constituents", sql=_TURN + "SELECT 'half' AS candidate, effective_date, 'one_way_turnover' AS metric, base AS baseline_value, base / 2 AS candidate_value, base / 2 - base AS difference FROM tu")
def comparison_turnover(spark: SparkSession, sf: str) -> DataFrame:
    base = v.constituents(spark, sf).groupBy("effective_date").agg((0.5 * F.sum(F.abs(F.col("index_weight") - F.col("benchmark_weight")))).alias("one_way_turnover"))
    return comparison.metric_differences(base, comparison.stacked({"half": base.withColumn("one_way_turnover", F.col("one_way_turnover") / 2)}), ["effective_date"], ["one_way_turnover"])


@query("series", sql="SELECT *, index_price_return - benchmark_price_return AS active_price_return, index_gross_total_return - benchmark_gross_total_return AS active_gross_total_return, index_net_total_return - benchmark_net_total_return AS active_net_total_return FROM series")
def report_performance(spark: SparkSession, sf: str) -> DataFrame:
    return report.performance(v.series(spark, sf))


@query("constituents", sql="SELECT effective_date, instrument_id, CAST((row_number() OVER (ORDER BY effective_date, instrument_id) - 1) // 250 AS INTEGER) AS sheet FROM constituents")
def report_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """The sheet that each row of a long table goes to."""
    return report.chunked(v.constituents(spark, sf).select("effective_date", "instrument_id"), ["effective_date", "instrument_id"], 250)


@query(sql="SELECT unnest(['limits.maximum', 'name', 'tilts.quality']) AS parameter, unnest(['0.1', '\"x\"', '0.5']) AS \"value\"", dates=False)
def report_parameters(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(report.flattened({"name": "x", "limits": {"maximum": 0.1}, "tilts": {"quality": 0.5}, "connection": "hidden"}), "parameter string, value string")


@query("constituents", sql="SELECT unnest(['index', 'first_review', 'last_review', 'reviews', 'instruments', 'latest_holdings']) AS field, unnest(['demo', CAST(min(effective_date) AS VARCHAR), CAST(max(effective_date) AS VARCHAR), CAST(count(DISTINCT effective_date) AS VARCHAR), CAST(count(DISTINCT instrument_id) AS VARCHAR), CAST(count(*) FILTER (index_weight > 0 AND effective_date = (SELECT max(effective_date) FROM constituents)) AS VARCHAR)]) AS \"value\" FROM constituents", dates=False)
def report_overview(spark: SparkSession, sf: str) -> DataFrame:
    return report.overview(v.constituents(spark, sf), "demo")


@query(sql="SELECT unnest(['lake', 'lake']) AS provider, unnest(['market_data', 'universe']) AS capability, unnest([1, 2]) AS requests", dates=False)
def report_sources(spark: SparkSession, sf: str) -> DataFrame:
    """What was asked of which provider."""
    seen = providers.Provenance()
    for day in ("1996-01-01", "1997-01-01"):
        seen.record("lake", "universe", effective_date=day, password="p")
    seen.record("lake", "market_data", start="1996-01-01")
    return report.data_sources(spark, seen)


@query(sql="SELECT unnest(['standardised', 'weights']) AS node, unnest(['universe', 'standardised']) AS input, unnest([NULL, 'standardised']) AS made_by", dates=False)
def recipe_graph(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(recipes.factor_tilt_recipe({"quality": 0.5}).graph(), "node string, input string, made_by string")


@query(sql="SELECT unnest([0, 1]) AS place, unnest(['standardised', 'weights']) AS node", dates=False)
def recipe_order(spark: SparkSession, sf: str) -> DataFrame:
    r = recipes.factor_tilt_recipe({"quality": 0.5})
    backwards = recipes.Recipe("r", r.nodes[::-1])
    return spark.createDataFrame([(k, n.name) for k, n in enumerate(backwards.order(["universe"]))], "place int, node string")


@query("constituents", sql=_Z + ", tw AS (SELECT effective_date, instrument_id, benchmark_weight * exp(0.5 * quality_zscore) AS t FROM zz) SELECT effective_date, instrument_id, t / sum(t) OVER (PARTITION BY effective_date) AS index_weight FROM tw")
def recipe_factor_tilt(spark: SparkSession, sf: str) -> DataFrame:
    u = v.constituents(spark, sf).drop("index_weight")
    return recipes.run(recipes.factor_tilt_recipe({"quality": 0.5}), {"universe": u})["weights"].select("effective_date", "instrument_id", "index_weight")


@query("constituents", sql="""WITH RECURSIVE rv AS (SELECT effective_date, row_number() OVER (ORDER BY effective_date) AS n FROM (SELECT DISTINCT effective_date FROM constituents) LIMIT 4),
bw AS (SELECT n, instrument_id, benchmark_weight FROM constituents JOIN rv USING (effective_date)), ev AS (SELECT n, instrument_id, benchmark_weight AS w FROM bw WHERE n = 1 UNION ALL
 SELECT b.n, b.instrument_id, (0.5 * b.benchmark_weight + 0.5 * coalesce(e.w, 0)) / sum(0.5 * b.benchmark_weight + 0.5 * coalesce(e.w, 0)) OVER (PARTITION BY b.n) FROM (SELECT DISTINCT n FROM ev) p JOIN bw b ON b.n = p.n + 1 LEFT JOIN ev e ON e.instrument_id = b.instrument_id AND e.n = p.n)
SELECT effective_date, instrument_id, w AS index_weight FROM ev JOIN rv USING (n)""")  # fmt: skip
def weights_on_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Four reviews, each halfway from the weights of the one before; every review's weights are stored."""
    c = v.constituents(spark, sf).select("effective_date", "instrument_id", "benchmark_weight")
    dates = [r[0] for r in c.select("effective_date").distinct().orderBy("effective_date").limit(4).collect()]

    def halfway(universe: DataFrame, previous: DataFrame) -> DataFrame:
        d = universe.join(previous.select("instrument_id", F.col("index_weight").alias("__w")), "instrument_id", "left")
        d = d.withColumn("__t", 0.5 * F.col("benchmark_weight") + 0.5 * F.coalesce("__w", F.lit(0.0)))
        return d.withColumn("index_weight", F.col("__t") / F.sum("__t").over(Window.partitionBy("effective_date"))).drop("__w", "__t")

    recipe = recipes.Recipe("halfway", (recipes.Node("weights", halfway, ("universe", "previous_weights")),))
    s = store.temporary(spark)
    empty = c.where(F.col("effective_date") == F.lit(dates[0])).withColumn("index_weight", F.col("benchmark_weight"))
    out = recipes.each_review(recipe, [(str(d), {"universe": c.where(F.col("effective_date") == F.lit(d))}) for d in dates], empty=empty, save=lambda date, df: s.load(s.save(df), verify=False))
    return comparison.stacked(out).select("effective_date", "instrument_id", "index_weight")


# -- reviews and diagnostics ---------------------------------------------------------


@query("constituents", sql="SELECT effective_date, instrument_id, index_weight AS weight FROM constituents WHERE index_weight > 0")
def review_weights(spark: SparkSession, sf: str) -> DataFrame:
    return reviews.normalised_weights(v.constituents(spark, sf).withColumn("instrument_id", F.concat(F.lit(" "), "instrument_id")))


@query("constituents", sql="SELECT effective_date, instrument_id, index_weight AS weight, quality, quantity FROM constituents WHERE index_weight > 0")
def review_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Held names, one to one with explicit inputs."""
    c = v.constituents(spark, sf)
    return reviews.with_inputs(c, c.select("effective_date", "instrument_id", "quality", "quantity"), ["quality", "quantity"])


@query("constituents", sql="SELECT effective_date, sum(CASE WHEN abs(coalesce(p, -1) - coalesce(r, -1)) > 1e-8 THEN 1 ELSE 0 END) AS different FROM (SELECT effective_date, instrument_id, index_weight AS p FROM constituents) a FULL JOIN (SELECT effective_date, instrument_id, CASE WHEN country = 'FRANCE' THEN index_weight + 0.01 ELSE index_weight END AS r FROM constituents WHERE country <> 'CHINA') b USING (effective_date, instrument_id) GROUP BY 1")
def review_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How many weights of a result differ from those of its context, missing ones too."""
    c = v.constituents(spark, sf)
    other = c.where("country <> 'CHINA'").withColumn("index_weight", F.col("index_weight") + F.when(F.col("country") == "FRANCE", 0.01).otherwise(0.0))
    return reviews.disagreement(c, other)


@query("constituents", sql="SELECT effective_date, reference_date, 'seen_date' AS source, CAST(reference_date - INTERVAL 3 DAY AS DATE) AS observation_date FROM constituents")
def freshness_records(spark: SparkSession, sf: str) -> DataFrame:
    c = v.constituents(spark, sf).select("effective_date", "reference_date", F.date_sub("reference_date", 3).alias("seen_date"))
    return quality.freshness_records(c)


@query(sql="SELECT unnest(['a.targets', 'b[0].targets']) AS path, unnest(['x', 'y']) AS name, unnest([1.0, 2.0]) AS \"value\"", dates=False)
def nested_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    found = reviews.nested_rows({"a": {"targets": [{"name": "x", "value": 1.0}], "other": 1}, "b": [{"targets": [{"name": "y", "value": 2.0}]}]}, ["targets"])
    return spark.createDataFrame(found, "path string, name string, value double")


@query(sql="SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'token=[redacted]' ELSE 'plain' END AS note, '[redacted]' AS api_key FROM supplier", dates=False)
def redacted_cells(spark: SparkSession, sf: str) -> DataFrame:
    s = v.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("token="), "s_name")).otherwise("plain").alias("note"), F.col("s_name").alias("api_key"))
    return quality.redact(s)


@query("constituents", sql="SELECT effective_date, coalesce(max(CASE WHEN year(effective_date) % 2 = 0 THEN sum_w END), max(half)) AS turnover FROM (SELECT effective_date, sum(abs(index_weight - benchmark_weight)) AS sum_w, 0.5 * sum(abs(index_weight - benchmark_weight)) AS half FROM constituents GROUP BY 1) GROUP BY 1")
def carried_turnover(spark: SparkSession, sf: str) -> DataFrame:
    """Turnover under whichever of its names a table has it."""
    t = v.constituents(spark, sf).groupBy("effective_date").agg(F.sum(F.abs(F.col("index_weight") - F.col("benchmark_weight"))).alias("s"))
    t = t.select("effective_date", F.when(F.year("effective_date") % 2 == 0, F.col("s")).alias("one_way_turnover"), (F.col("s") / 2).alias("index_turnover"))
    return quality.carried_turnover(t)




# -- daily series and alignments -------------------------------------------------------


@query(sql=f"WITH series AS (SELECT CAST(o_orderdate AS DATE) AS business_date, avg(o_totalprice) / 1e7 - 0.015 AS {INDEX}, max(o_totalprice) / 1e7 - 0.03 AS {BENCH} FROM orders GROUP BY 1) " + _rolling_sql([(21, 21), (63, 63), (252, 252)]))
def rolling_risk_daily(spark: SparkSession, sf: str) -> DataFrame:
    """A month, a quarter and a year of a daily series."""
    o = v.table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("business_date"))
    daily = o.agg((F.avg("o_totalprice") / 1e7 - 0.015).alias(INDEX), (F.max("o_totalprice") / 1e7 - 0.03).alias(BENCH))
    return performance.rolling_risk(daily, INDEX, BENCH)


@query("series", "event_dates", sql="""WITH ps AS (SELECT business_date, row_number() OVER (ORDER BY business_date) - 1 AS p FROM series),
ev AS (SELECT event_date FROM event_dates UNION SELECT business_date FROM ps WHERE p % 10 = 0)
SELECT 'exact' AS alignment, event_date AS requested_event_date, (SELECT max(p) FROM ps WHERE business_date = event_date) AS "position" FROM ev
UNION ALL SELECT 'next', event_date, (SELECT min(p) FROM ps WHERE business_date >= event_date) FROM ev UNION ALL SELECT 'previous', event_date, (SELECT max(p) FROM ps WHERE business_date <= event_date) FROM ev""")  # fmt: skip
def event_alignments(spark: SparkSession, sf: str) -> DataFrame:
    """Where each event falls in a calendar, by each alignment; null where there is no such date."""
    days = events.positions(v.series(spark, sf).select("business_date"))
    asked = v.event_dates(spark, sf).unionByName(days.where("position % 10 = 0").select(F.col("business_date").alias("event_date"))).distinct()
    return comparison.stacked({a: events.aligned_events(asked, days, a) for a in (events.EXACT, events.NEXT, events.PREVIOUS)}).withColumnRenamed("candidate", "alignment")
