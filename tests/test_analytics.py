import datetime as dt

import numpy as np
import pytest

from indexloom.operators import attribution, events, performance, quality, regimes, reviews, risk

DAY = dt.date(2026, 6, 22)


def test_review_goldens(spark):
    d1, d2 = dt.date(2026, 1, 1), dt.date(2026, 4, 1)
    rows = [(d1, "A", 0.5, 0.4, "US", "Technology"), (d1, "B", 0.3, 0.35, "US", " "), (d1, "C", 0.2, 0.25, None, "Health"), (d2, "A", 0.1, 0.4, "US", "Technology"), (d2, "B", 0.3, 0.35, "US", "x"), (d2, "D", 0.6, 0.25, "CA", "Health")]
    c = spark.createDataFrame(rows, "effective_date date, instrument_id string, index_weight double, benchmark_weight double, country string, industry string")
    m = {r["effective_date"]: r for r in reviews.metrics(c).collect()}
    assert m[d1]["hhi"] == pytest.approx(0.38) and m[d1]["effective_n"] == pytest.approx(1 / 0.38) and m[d1]["active_share"] == pytest.approx(0.10)
    us = reviews.exposures(c, "country").where("country = 'US'").orderBy("effective_date").first()
    assert (us["portfolio_weight"], us["benchmark_weight"], us["active_weight"]) == pytest.approx((0.8, 0.75, 0.05))
    assert reviews.exposures(c, "industry").where("industry = 'Unclassified'").count() == 1
    assert reviews.exposures(c, "sector").select("sector").distinct().first()[0] == "Unclassified"
    t = reviews.target_weight_change(c).first()
    assert (t["gross_target_weight_change"], t["one_way_target_weight_change"]) == pytest.approx((1.2, 0.6))
    s = reviews.membership_stability(c).first()
    assert (s["entrants"], s["exits"], s["membership_jaccard"]) == (1, 1, 0.5)


def test_drawdown_conventions(spark):
    d = spark.createDataFrame([(DAY + dt.timedelta(days=k), r) for k, r in enumerate((-0.1, 0.05, -0.2))], "business_date date, `return` double")
    plain = [r["drawdown"] for r in performance.with_drawdown(d).orderBy("business_date").collect()]
    based = [r["drawdown"] for r in performance.with_drawdown(d, base=1.0).orderBy("business_date").collect()]
    assert plain == pytest.approx([0.0, 0.0, -0.2]) and based[0] == pytest.approx(-0.1)


def test_episodes(spark):
    returns = (0.1, -0.2, 0.3, -0.1, -0.1)
    d = spark.createDataFrame([(DAY + dt.timedelta(days=k), r) for k, r in enumerate(returns)], "business_date date, `return` double")
    e = performance.drawdown_episodes(d).orderBy("start_date").collect()
    assert [(r["start_date"].day, r["trough_date"].day, r["end_date"].day, r["recovered"], r["duration_business_days"]) for r in e] == [(23, 23, 24, True, 2), (25, 26, 26, False, 2)]


def test_returns_are_checked(spark):
    d = spark.createDataFrame([(DAY, -1.5)], "business_date date, r double")
    with pytest.raises(ValueError):
        performance.require_returns(d, "r", ["business_date"])


def test_brinson_golden(spark):
    rows = [("p", "A", "x", 0.4, 0.3, 0.10), ("p", "B", "x", 0.1, 0.2, 0.0), ("p", "C", None, 0.2, 0.3, 0.02), ("p", "D", None, 0.3, 0.2, 0.04)]
    f = spark.createDataFrame(rows, "period string, instrument_id string, industry string, index_weight double, benchmark_weight double, asset_return double")
    totals = attribution.brinson_totals(attribution.brinson(f))
    t = totals.first()
    assert t["portfolio_return"] == pytest.approx(0.056) and t["benchmark_return"] == pytest.approx(0.044)
    assert t["total_attribution"] == pytest.approx(t["active_return"])
    attribution.require_reconciled(totals)
    two = totals.union(totals.withColumn("period", totals["period"].substr(1, 0)))
    linked = {r["component"]: r["linked_contribution"] for r in attribution.carino_totals(attribution.carino(two), two).collect()}
    assert linked["total_attribution"] == pytest.approx(linked["multi_period_active_return"])


@pytest.mark.parametrize("ridge", [0.0, 0.5])
def test_factor_model(spark, ridge):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    y = 1e-4 + 0.4 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(size=40) * 1e-3
    d = spark.createDataFrame([(DAY + dt.timedelta(days=k), float(y[k]), float(x[k, 0]), float(x[k, 1])) for k in range(40)], "business_date date, y double, quality double, value double")
    found, daily = attribution.factor_model(d, "y", ["quality", "value"], ridge=ridge)
    a = np.column_stack([np.ones(40), x])
    want = np.linalg.solve(a.T @ a + ridge * np.diag([0, 1, 1]), a.T @ y)
    assert list(found.values()) == pytest.approx(want, abs=1e-10)
    s = attribution.factor_summary(daily).first()
    assert s["r_squared"] == pytest.approx(1 - ((y - a @ want) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_risk(spark):
    m = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.16]])
    cov = spark.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate("ABC") for j, b in enumerate("ABC")], "i string, j string, cov double")
    w = spark.createDataFrame([("A", 0.5), ("B", 0.3), ("C", 0.2)], "instrument_id string, weight double")
    v = np.array([0.5, 0.3, 0.2])
    out = {r["instrument_id"]: r for r in risk.contributions(w, cov).collect()}
    assert sum(r["risk_contribution"] for r in out.values()) == pytest.approx(np.sqrt(v @ m @ v))
    assert sum(r["risk_contribution_ratio"] for r in out.values()) == pytest.approx(1)
    bad = np.array([[1.0, 2.0], [2.0, 1.0]])
    assert np.linalg.eigvalsh(risk.positive(bad, 1e-8)).min() >= -1e-12


def test_liquidity_golden(spark):
    d = spark.createDataFrame([("A", 0.5, 5e6), ("B", 0.3, 2e6), ("C", 0.2, 2.5e5)], "instrument_id string, index_weight double, adv double")
    out = {r["instrument_id"]: r["capacity_breach"] for r in risk.liquidity(d, "adv", 1e7, 0.2, 2).collect()}
    assert out["C"] and out["A"]


def test_event_alignment(spark):
    days = [dt.date(2026, 1, d) for d in (5, 6, 8, 9)]
    cal = events.positions(spark.createDataFrame([(d,) for d in days], "business_date date"))
    e = spark.createDataFrame([(dt.date(2026, 1, d),) for d in (4, 6, 7, 10)], "event_date date")
    at = lambda how: {r[0].day: r[1] for r in events.aligned_events(e, cal, how).collect()}
    assert at("exact") == {4: None, 6: 1, 7: None, 10: None}
    assert at("next") == {4: 0, 6: 1, 7: 2, 10: None}
    assert at("previous") == {4: None, 6: 1, 7: 1, 10: 3}


def test_rank_tests(spark):
    """Against exact ranks worked out here."""
    a, b = [0.1, 0.2, 0.2, 0.5], [0.15, 0.3, 0.4, 0.6, 0.7]
    r = spark.createDataFrame([(DAY + dt.timedelta(days=k), "s", x) for k, x in enumerate(a + b)], "business_date date, series string, `return` double")
    g = spark.createDataFrame([(DAY + dt.timedelta(days=k), "a" if k < len(a) else "b") for k in range(len(a + b))], "business_date date, regime string")
    t = {x["test"]: x for x in regimes.distribution_tests(r, g).collect()}
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert t["mann_whitney_u"]["statistic"] == pytest.approx(u)
    assert 0 < t["mann_whitney_u"]["p_value"] <= 1 and 0 < t["kruskal_wallis"]["p_value"] < 1


def test_quality(spark):
    d = spark.createDataFrame([("A", 1.0, " ", 0.5), ("B", None, "x", 0.3), ("C", 3.0, "y", 0.2)], "instrument_id string, v double, s string, w double")
    c = {r["field"]: r for r in quality.coverage(d, ["v", "s"], "w").collect()}
    assert c["v"]["weight_coverage"] == pytest.approx(0.7) and c["s"]["missing_count"] == 1
    assert quality.content_digest(d) == quality.content_digest(d.orderBy("v")) != quality.content_digest(d.limit(2))
    s = spark.createDataFrame([("user", "password=abc; x")], "api_key string, note string")
    assert quality.redact(s).first()["note"] == "password=[redacted]; x" and quality.redact(s).first()["api_key"] == "[redacted]"
