"""The closed form against a plain day loop, and fixed cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from indexloom.operators import simulation as sim
from indexloom.operators.simulation import Dividends, Drift, Phase, Timing

D0 = dt.date(2026, 1, 1)


def market(names=4, days=14, gap=None):
    out = []
    for k in range(days):
        for i in range(names):
            cap = 100 * (i + 1) * (1 + 0.01 * math.sin(k * (i + 1)))
            out.append((chr(65 + i), D0 + dt.timedelta(days=k), 0.02 * math.sin(k + 2 * i), 2e-4 * i, 1.5e-4 * i, cap))
    return out


def loop(rows, reviews, phase, drift, dividends):
    """Day by day, with carried weights."""
    obs = {(i, d): (r, g, n, c) for i, d, r, g, n, c in rows}
    days = sorted({d for _, d, *_ in rows})
    at = {}
    for day, w in sorted(reviews.items()):
        at[min(d for d in days if d >= day)] = {k: x / sum(w.values()) for k, x in w.items()}
    w, out, turns, target = None, [], {}, None
    start = min(at)
    for n, d in enumerate(days):
        if d < start:
            continue
        if d in at and (phase == Phase.OPEN or w is None):
            turns[d] = None if w is None else 0.5 * sum(abs(at[d].get(k, 0) - w.get(k, 0)) for k in {*w, *at[d]})
            w = dict(at[d])
        p = sum(x * (1 + obs[k, d][0]) for k, x in w.items())
        g, net = (sum(x * obs[k, d][j] for k, x in w.items()) for j in (1, 2))
        total = (lambda y: p / (1 - y)) if dividends == Dividends.STANDARD else (lambda y: p + y)
        out.append((d, p, total(g), total(net)))
        if drift == Drift.PRICE:
            w = {k: x * (1 + obs[k, d][0]) for k, x in w.items()}
        elif drift == Drift.RELATIVE_CAP:
            w = {k: x * obs[k, d][3] / obs[k, days[n - 1]][3] for k, x in w.items()}
        else:
            w = {k: obs[k, d][3] if x > 0 else 0 for k, x in w.items()}
        s = sum(w.values())
        w = {k: x / s for k, x in w.items()}
        if d in at and phase == Phase.CLOSE and d != start:
            turns[d] = 0.5 * sum(abs(at[d].get(k, 0) - w.get(k, 0)) for k in {*w, *at[d]})
            w = dict(at[d])
    return out, turns


REVIEWS = {D0 + dt.timedelta(days=1): {"A": 1.0, "B": 2.0, "C": 3.0}, D0 + dt.timedelta(days=5): {"B": 1.0, "C": 1.0, "D": 2.0}, D0 + dt.timedelta(days=6): {"A": 1.0, "D": 1.0}, D0 + dt.timedelta(days=10): {"A": 0.0, "B": 1.0, "C": 4.0}}


@pytest.mark.parametrize("phase", list(Phase))
@pytest.mark.parametrize("drift", list(Drift))
@pytest.mark.parametrize("dividends", list(Dividends))
def test_closed_form_equals_day_loop(spark, phase, drift, dividends):
    rows = market()
    panel = spark.createDataFrame(rows, "instrument_id string, business_date date, price_return double, gross_dividend double, net_dividend double, market_cap double")
    w = [("index", d, i, x) for d, ws in REVIEWS.items() for i, x in ws.items()]
    weights = spark.createDataFrame(w, "portfolio string, effective_date date, instrument_id string, weight double")
    h = sim.checked(sim.held(panel, weights, phase, drift=drift))
    got = [tuple(r)[1:] for r in sim.factors(h, dividends).orderBy("business_date").collect()]
    want, turns = loop(rows, REVIEWS, phase, drift, dividends)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], abs=1e-13)
    found = {r["applied_date"]: r["index_turnover"] for r in sim.rebalances(h).collect()}
    assert found == pytest.approx(turns, abs=1e-12)


def test_treatments(spark):
    day = dt.date(2026, 6, 5)
    panel = spark.createDataFrame([("A", day, 0.02, 0.004, 0.003, 1.0), ("B", day, -0.01, 0.004, 0.003, 1.0)], "instrument_id string, business_date date, price_return double, gross_dividend double, net_dividend double, market_cap double")
    w = spark.createDataFrame([("A", 0.4), ("B", 0.6)], "instrument_id string, weight double")
    standard = sim.fixed_weight_returns(panel, w).first()
    assert standard["price"] - 1 == pytest.approx(0.002)
    assert standard["gross_total"] == pytest.approx(1.002 / (1 - 0.004))
    assert sim.fixed_weight_returns(panel, w, Dividends.ALTERNATIVE).first()["gross_total"] - 1 == pytest.approx(0.006)


def test_applications(spark):
    days = spark.createDataFrame([(dt.date(2026, 1, d),) for d in (5, 6, 7, 9)], "business_date date")
    reviews = lambda *d: spark.createDataFrame([(dt.date(2026, 1, x),) for x in d], "effective_date date")
    found = {r["effective_date"].day: r["applied_date"].day for r in sim.applications(reviews(1, 3, 8, 20), days).collect()}
    assert found == {3: 5, 8: 9}
    assert sim.applications(reviews(6, 8), days, Timing.EXACT).count() == 1
    with pytest.raises(Exception, match="two reviews"):
        sim.applications(reviews(8, 9), days).collect()


def test_missing_observation_is_an_error(spark):
    rows = [r for r in market() if not (r[0] == "B" and r[1] == D0 + dt.timedelta(days=3))]
    panel = spark.createDataFrame(rows, "instrument_id string, business_date date, price_return double, gross_dividend double, net_dividend double, market_cap double")
    weights = spark.createDataFrame([("index", D0, "B", 1.0)], "portfolio string, effective_date date, instrument_id string, weight double")
    with pytest.raises(ValueError, match="missing"):
        sim.checked(sim.held(panel, weights))


def test_levels_rebase(spark):
    d = spark.createDataFrame([(dt.date(2026, 1, k), 0.01 * k) for k in range(1, 6)], "business_date date, index_net_total_return double")
    from pyspark.sql import Window

    d = d.withColumn("index_net_total_level", 100 * F.product(1 + F.col("index_net_total_return")).over(Window.orderBy("business_date")))
    r = [x["index_net_total_level"] for x in sim.rebased(d, dt.date(2026, 1, 3)).orderBy("business_date").collect()]
    assert r == pytest.approx([103.0, 103 * 1.04, 103 * 1.04 * 1.05])
