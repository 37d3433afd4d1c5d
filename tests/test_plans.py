import datetime as dt

import pytest
from pyspark.sql import functions as F

from indexloom.operators import scenarios
from indexloom.plans import plugins, recipes, report, store
from indexloom.plans.recipes import Node, Recipe, RecipeError
from indexloom.sources import calendars, contracts, providers, rules
from indexloom.sources import views as v
from indexloom.streaming import windows


@pytest.fixture
def table(spark):
    return spark.createDataFrame([("A", 1.0), ("B", 2.0)], "instrument_id string, x double")


def test_recipe_order_and_errors(table):
    r = Recipe("r", (Node("c", lambda b: b.withColumn("z", F.lit(1)), ("b",)), Node("b", lambda a: a.withColumn("y", F.lit(2)), ("a",))))
    assert [n.name for n in r.order(["a"])] == ["b", "c"]
    assert set(recipes.run(r, {"a": table})["c"].columns) == {"instrument_id", "x", "y", "z"}
    with pytest.raises(RecipeError, match="unknown"):
        r.order()
    with pytest.raises(RecipeError, match="circle"):
        Recipe("r", (Node("a", None, ("b",)), Node("b", None, ("a",)))).order()


def test_recipe_cache_runs_shared_stage_once(table):
    made = []
    node = lambda k: Node("f", lambda a, k: made.append(k) or a, ("a",), configuration={"k": k}, scope=recipes.Scope.CONTENT)
    cache = recipes.MemoryCache()
    for k in (1, 1, 2):
        recipes.run(Recipe("r", (node(k),)), {"a": table}, cache, {"a": "1"})
    assert made == [1, 2]


def test_store(spark, table, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    made = []
    make = lambda: made.append(1) or table
    with pytest.raises(LookupError):
        s.cached("stage", {"a": 1}, "t", make, store.Mode.READ_ONLY)
    for mode in (store.Mode.REUSE, store.Mode.REUSE, store.Mode.READ_ONLY):
        assert s.cached("stage", {"a": 1}, "t", make, mode).count() == 2
    assert len(made) == 1
    ref = s.save(table.orderBy(F.desc("x")))
    assert ref == s.save(table) and s.verify() == []
    s.invalidate("stage")
    assert s.latest("stage") is None and s.prune() == [] and s.prune(older_than=0) == [ref.path]  # a young one may be about to be bound
    s.prune(dry_run=False, older_than=0)
    assert s.prune(older_than=0) == []


def test_covering_ranges():
    held = [("2026-01-01", "2026-01-31"), ("2026-01-10", "2026-02-20"), ("2026-02-21", "2026-03-31")]
    assert len(store.covering(held, "2026-01-05", "2026-03-01")) == 3
    assert store.covering(held, "2026-01-05", "2026-04-01") is None
    assert calendars.month_partitions("2026-01-20", "2026-03-02") == [("2026-01-20", "2026-01-31"), ("2026-02-01", "2026-02-28"), ("2026-03-01", "2026-03-02")]


def test_bundle(spark, table, tmp_path):
    path = f"file://{tmp_path}/bundle"
    m = report.write_bundle(spark, path, {"t": table.withColumn("tags", F.array(F.lit("a")))}, {"name": "x"})
    assert m["tables"]["t"]["rows"] == 2 and spark.read.parquet(f"{path}/tables/t").count() == 2
    with pytest.raises(FileExistsError):
        report.write_bundle(spark, path, {"t": table})
    assert "<td>A" in report.dashboard({"t": table})


def test_plugins(spark, sf):
    c = v.constituents(spark, sf)
    r = plugins.run(plugins.profile("standard_research"), {"constituents": c, "daily": v.series(spark, sf)})
    assert {"core.metrics", "performance.summary", "weight_change_contributors.summary", "drawdown_episodes.episodes"} <= set(r.tables)
    assert any("multi_period_attribution" in w for w in r.warnings)
    with pytest.raises(plugins.MissingInput):
        plugins.run(plugins.profile("standard_research"), {"constituents": c}, plugins.Settings(missing=plugins.Missing.FAIL))


def test_providers(spark, table, tmp_path):
    reg = providers.Registry()
    reg.register("lake", "market_data", providers.TableProvider({}))
    with pytest.raises(providers.MissingProvider):
        reg.resolve("lake", "universe")
    with pytest.raises(ValueError):
        reg.register("lake", "market_data", None)
    (tmp_path / "a.csv").write_text("instrument_id,x\nA,1\n")
    files = providers.FileProvider(spark)
    assert files.read(str(tmp_path / "a.csv")).count() == 1
    assert len(files.describe_snapshot("file", {"file_path": str(tmp_path / "a.csv")})["sha256"][0]) == 64
    with pytest.raises(RuntimeError, match="not configured"):
        providers.snowflake().query("SELECT 1")
    profiles = providers.ProfileRegistry()
    profiles.register("EU", 1, prefix=True)
    profiles.register("EU_", 2, prefix=True)
    profiles.register("eu_x", 3)
    assert [profiles.resolve(x) for x in ("eux", "EU_1", "EU_X")] == [1, 2, 3]
    market = spark.createDataFrame([("A", dt.date(2026, 1, 1)), ("B", dt.date(2026, 1, 2))], "instrument_id string, business_date date")
    assert providers.TableProvider({"market_data": market}).load_daily_market_data(table.where("instrument_id = 'B'"), "2026-01-01", "2026-01-31").count() == 1


def test_contracts(spark):
    good = [("A", "n", "US", "x", "USD", "USD", 1.0, 1.0, 1.0, 0.4, 1.0, 1.0), ("B", "n", "US", "x", "USD", "USD", 1.0, 1.0, 1.0, 0.6, 0.5, 1.0)]
    names = "instrument_id string, name string, country string, industry string, currency string, base_currency string, shares double, price double, market_cap double, benchmark_weight double, free_float double, fx_rate double"
    dated = lambda rows: spark.createDataFrame(rows, names).withColumn("reference_date", F.lit("2026-06-05").cast("date")).withColumn("effective_date", F.lit("2026-06-22").cast("date"))
    contracts.validate_universe(dated(good))
    for bad in ([good[0]], [good[0], good[0][:9] + (0.6, 2.0, 1.0)], []):
        with pytest.raises(contracts.ContractError):
            contracts.validate_universe(dated(bad))
    w = spark.createDataFrame([("r", 0.5), ("r", 0.6)], "effective_date string, index_weight double")
    with pytest.raises(contracts.ContractError):
        contracts.validate_weights(w)


def test_rules(spark):
    c = spark.createDataFrame([("r", "A", 0.5, "x"), ("r", "B", 0.5, None)], "effective_date string, instrument_id string, benchmark_weight double, industry string")
    out = rules.composed(rules.universe_defaults, rules.exclude([rules.Exclusion("industry", ("x",), "only x", only_include=True)]))(c)
    assert [(r["index_weight"], r["exclusion_reason"]) for r in out.orderBy("instrument_id").collect()] == [(1.0, []), (0.0, ["only x"])]
    assert rules.visible(out).count() == 1 and rules.exclusion_violations(out).count() == 0
    u = spark.createDataFrame([("r", "A", None)], "effective_date string, instrument_id string, industry string")
    assert rules.upserted(c, u, ["industry"]).where("instrument_id = 'A' AND industry IS NULL").count() == 1
    with pytest.raises(Exception, match="unknown keys"):
        rules.upserted(c, u.withColumn("instrument_id", F.lit("Z")), ["industry"]).collect()
    with pytest.raises(Exception, match="repeat"):
        rules.add_facts(c.union(c).select("instrument_id", "industry"))(c).collect()


def test_scenarios(spark):
    c = spark.createDataFrame([("A", "US", 1.0), ("B", "US", 2.0), ("C", "CA", 3.0)], "instrument_id string, country string, signal double")
    s = scenarios.Scenario("s", (scenarios.Shock("signal", scenarios.Operation.ADD, 1.0, where={"country": ("US",)}), scenarios.Shock("signal", scenarios.Operation.MULTIPLY, 10.0, instruments=("A",)), scenarios.Shock("signal", scenarios.Operation.REPLACE, 0.0, instruments=("Z",))))
    assert [r["signal"] for r in scenarios.apply(c, s).orderBy("instrument_id").collect()] == [20.0, 3.0, 3.0]
    with pytest.raises(ValueError):
        scenarios.require_hits(scenarios.audit(c, s), s)
    a = scenarios.noisy(c, ["signal"], 0.1, 17).orderBy("instrument_id").collect()
    assert a == scenarios.noisy(c.repartition(3), ["signal"], 0.1, 17).orderBy("instrument_id").collect()
    assert scenarios.drawn(c, 1, 10).count() == 10 and scenarios.bootstrap(c, 1).count() == c.count()
    done = scenarios.run_batch([("a", lambda: 1), ("b", lambda: 1 / 0)], continue_on_error=True)
    assert done[0].result == 1 and "ZeroDivision" in done[1].error


def test_streamed_levels(spark, tmp_path):
    schema = "index_id string, business_date date, `return` double"
    src = str(tmp_path / "in")
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    write([("i", dt.date(2026, 1, 1), 0.1)])
    stream = windows.levels(spark.readStream.schema(schema).parquet(src))
    q = stream.writeStream.format("memory").queryName("levels").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
        write([("i", dt.date(2026, 1, 2), 0.1), ("i", dt.date(2026, 1, 1), 0.5)])
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r["level"] for r in spark.table("levels").orderBy("business_date").collect()] == pytest.approx([110.0, 121.0])
