import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from indexloom.operators import construction, risk, solvers
from indexloom.operators.construction import Criterion, Exposure, Limits, Tilt
from indexloom.operators.solvers import Infeasible, Linear


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.001, 1), min_size=2, max_size=12), st.floats(0.3, 1))
def test_simplex_projections(prior, most):
    b = np.array(prior) / sum(prior)
    low, high = np.zeros(len(b)), np.full(len(b), max(most, 1.01 / len(b)))
    for w in (solvers.capped(b, low, high), solvers.nearest(b, low, high)):
        assert w.sum() == pytest.approx(1, abs=1e-9) and (w >= -1e-12).all() and (w <= high + 1e-12).all()


def test_projection_is_nearest():
    rng = np.random.default_rng(0)
    t, high = rng.random(8), np.full(8, 0.2)
    w = solvers.nearest(t, np.zeros(8), high)
    for _ in range(500):
        v = solvers.nearest(rng.random(8), np.zeros(8), high)
        assert ((v - t) ** 2).sum() >= ((w - t) ** 2).sum() - 1e-12


def test_minimum_variance_limits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 12))
    cov, b = np.cov(x, rowvar=False), np.full(12, 1 / 12)
    box = np.zeros(12), np.full(12, 0.3)
    free = solvers.minimum_variance(cov, *box)
    inverse = np.linalg.solve(cov, np.ones(12))
    if (inverse >= 0).all() and (inverse / inverse.sum() <= 0.3).all():
        assert free.weights == pytest.approx(inverse / inverse.sum(), abs=1e-7)
    te = solvers.minimum_variance(cov, *box, benchmark=b, tracking_error=0.01).weights
    assert np.sqrt((te - b) @ cov @ (te - b)) <= 0.01 + 1e-7
    to = solvers.minimum_variance(cov, *box, reference=b, turnover=0.05).weights
    assert 0.5 * abs(to - b).sum() <= 0.05 + 1e-7
    rows = [Linear("g", (np.arange(12) < 4) * 1.0, 0.5, 0.6)]
    assert solvers.minimum_variance(cov, *box, rows).weights[:4].sum() >= 0.5 - 1e-7


def test_entropy_forms_agree():
    rng = np.random.default_rng(2)
    e, b = rng.normal(size=(20, 2)), rng.random(20)
    b /= b.sum()
    want = np.array([0.2, -0.1])
    a = solvers.kl_dual(e, b, want)
    assert e.T @ a.weights == pytest.approx(want, abs=1e-7)
    rows = [Linear(str(k), e[:, k], want[k], want[k]) for k in range(2)]
    assert solvers.kl_project(b, np.zeros(20), np.ones(20), rows).weights == pytest.approx(a.weights, abs=1e-6)
    soft = solvers.kl_dual(e, b, want, 50.0).weights
    assert solvers.kl_elastic(e, b, want, np.zeros(20), np.ones(20), penalty=50.0).weights == pytest.approx(soft, abs=1e-5)
    with pytest.raises(Infeasible):
        solvers.kl_dual(e, b, np.array([50.0, 0.0]))


def test_feasibility():
    assert solvers.relaxation(np.zeros(3), np.full(3, 0.5), [Linear("x", np.array([1.0, 0, 0]), 0.8, 1)])["x"] == pytest.approx(0.3, abs=1e-4)
    assert solvers.relaxation(np.zeros(3), np.ones(3), [Linear("x", np.array([1.0, 0, 0]), 0.8, 1)])["x"] == 0
    with pytest.raises(Infeasible):
        solvers.capped(np.ones(3) / 3, np.zeros(3), np.full(3, 0.2))


@pytest.fixture
def universe(spark):
    data = [("r1", k, w, q, g) for k, w, q, g in (("A", 0.1, 1.0, "x"), ("B", 0.4, None, "x"), ("C", 0.3, 3.0, "y"), ("D", 0.2, 5.0, None))] + [("r2", "A", 1.0, 2.0, "x")]
    return spark.createDataFrame(data, "effective_date string, instrument_id string, benchmark_weight double, quality double, industry string")


def test_standardised(universe):
    z = {(r["effective_date"], r["instrument_id"]): r["quality_zscore"] for r in construction.standardised(universe, ["quality"], missing=-1.0).collect()}
    assert z["r1", "B"] == -1.0 and z["r2", "A"] == 0.0
    assert z["r1", "A"] == pytest.approx(-2 / np.std([1, 3, 5]))


def test_power_tilt(universe):
    z = construction.standardised(universe, ["quality"])
    w = {r["instrument_id"]: r["index_weight"] for r in construction.tilted(z, {"quality": 1.0}, Tilt.POWER, 2.0).where("effective_date = 'r1'").collect()}
    assert sum(w.values()) == pytest.approx(1)
    assert w["B"] / w["C"] == pytest.approx(0.4 / 0.3)  # both at a score of zero


def test_selection(universe):
    z = construction.standardised(universe, ["quality"])
    one = construction.selected(z, {"quality": 1.0}, 0.25).where("effective_date = 'r1' AND selected").collect()
    assert [r["instrument_id"] for r in one] == ["D"]
    cover = construction.selected(z, {"quality": 1.0}, 0.4, Criterion.WEIGHT_COVERAGE).where("effective_date = 'r1' AND selected").collect()
    assert sorted(r["instrument_id"] for r in cover) == ["B", "D"]  # D is 0.2, B crosses 0.4; ties go to the smaller id
    inside = construction.selected(z, {"quality": 1.0}, 0.5, within="industry").where("effective_date = 'r1'").collect()
    w = {r["instrument_id"]: r["index_weight"] for r in inside}
    assert w == pytest.approx({"A": 0.0, "B": 0.5, "C": 0.3, "D": 0.2})


def test_infeasible_review_has_no_weights(universe):
    out = construction.projected(universe.withColumnRenamed("benchmark_weight", "benchmark_weight").selectExpr("*", "benchmark_weight AS index_weight"), Limits(maximum=0.5)).collect()
    status = {r["effective_date"]: r["solver_status"] for r in out}
    assert status["r1"] == "solved" and status["r2"].startswith("infeasible")


def test_entropy_targets(universe):
    z = construction.standardised(universe, ["quality"]).where("effective_date = 'r1'")
    rows = construction.entropy_targets(z, [Exposure("quality_zscore", 0.4)]).collect()
    assert sum(r["index_weight"] * r["quality_zscore"] for r in rows) == pytest.approx(0.4, abs=1e-6)
    far = construction.entropy_targets(z, [Exposure("quality_zscore", 40.0)], mode="hard_then_elastic").collect()
    assert all(r["solver_status"] == "solved" for r in far)


def peak_mb(f):
    """What ``f`` gives, and the MB it held at once."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_bounded_entropy_of_many_names():
    """Memory grows with names, not with their square: 5,000 names squared are 200 MB."""
    rng = np.random.default_rng(5)
    b, z = rng.random(5_000), rng.normal(size=5_000)
    b /= b.sum()
    found, mb = peak_mb(lambda: solvers.kl_project(b, np.zeros(5_000), 2 * b, [Linear("z", z, 0.2)]))
    assert mb < 20 and found.weights @ z >= 0.2 - 1e-7 and (found.weights <= 2 * b + 1e-9).all() and found.violation <= 1e-7
    assert solvers.violation(np.array([0.5, 0.7]), np.zeros(2), np.array([1.0, 0.6]), [Linear("r", np.array([1.0, 0.0]), 0.9)]) == pytest.approx(0.4)


def test_projection_equals_splitting():
    """The dual's weights are those of operator splitting, with groups and a factor row, infeasible ones included."""
    rng = np.random.default_rng(6)
    kinds = set()
    for k in range(30):
        n = int(rng.integers(5, 40))
        g, b, z = rng.integers(0, 4, n), rng.random(n) ** 2, rng.normal(size=n)
        b /= b.sum()
        t = b * np.exp(rng.normal(size=n))
        t /= t.sum()
        room = (0.0, 0.02, 0.1)[k % 3]
        rows = [Linear(f"g{v}", (g == v) * 1.0, b[g == v].sum() - room, b[g == v].sum() + room) for v in np.unique(g)] + [Linear("z", z, z @ b + (0.0, 0.1, 3.0)[k // 10])]
        low, high = np.zeros(n), np.minimum(0.6, 3 * b)
        try:
            a, lower, upper = solvers._rows(n, low, high, rows, 1.0)
            want = solvers.verified(*solvers.quadratic(np.eye(n), -t, a, lower, upper), low, high, rows).weights
        except Infeasible:
            want = None
        kinds.add(want is None)
        if want is None:
            with pytest.raises(Infeasible):
                solvers.closest(t, low, high, rows)
        else:
            assert solvers.closest(t, low, high, rows).weights == pytest.approx(want, abs=1e-7)
    assert kinds == {True, False}


def sectors(n, room):
    rng = np.random.default_rng(7)
    g, b = rng.integers(0, 5, n), rng.random(n)
    b /= b.sum()
    t = b * np.exp(0.3 * rng.normal(size=n) + 0.5 * (g == 1))
    return t / t.sum(), b, [Linear(f"g{v}", (g == v) * 1.0, b[g == v].sum() - room, b[g == v].sum() + room) for v in range(5)]


def test_projection_of_many_names():
    """No dense table of names: 3,000 squared are 72 MB."""
    t, b, rows = sectors(3_000, 0.02)
    found, mb = peak_mb(lambda: solvers.closest(t, np.zeros(3_000), np.minimum(0.5, 3 * b), rows))
    assert mb < 10 and found.violation < 1e-12


def test_projection_limits_of_many_names():
    """Limits hold to rounding among many names, and impossible ones are found without a dense table."""
    t, b, rows = sectors(3_000, 0.0)
    w = solvers.closest(t, np.zeros(3_000), np.minimum(0.5, 3 * b), rows).weights
    assert (w <= 3 * b + 1e-12).all() and w.sum() == pytest.approx(1, abs=1e-12) and max(abs(r.coefficients @ w - r.upper) for r in rows) < 1e-12

    def impossible():
        with pytest.raises(Infeasible):
            solvers.closest(t, np.zeros(3_000), np.minimum(0.5, 3 * b), [Linear("g", rows[0].coefficients, 0.99)])

    assert peak_mb(impossible)[1] < 10


def returns(n, t, gaps, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.03, (n, t)) + rng.normal(0, 0.01, t)
    x[rng.random((n, t)) < gaps] = np.nan
    return x


@pytest.mark.parametrize(("n", "t", "gaps"), [(60, 24, 0.1), (60, 24, 0.0), (200, 24, 0.02), (30, 8, 0.0), (40, 60, 0.0), (5, 24, 0.0)])
def test_least_variance_is_the_dense_one(n, t, gaps):
    """Factored covariances are the pairwise ones, and their weights those of the dense solver."""
    x, ridge = returns(n, t, gaps, n + t), 1e-8
    cov = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            cov[i, j] = np.cov(x[i][both], x[j][both])[0, 1]
    cov = (cov + cov.T) / 2 + ridge * np.eye(n)
    cov -= min(np.linalg.eigvalsh(cov).min(), 0) * np.eye(n)
    found = solvers.pairwise(x).positive(ridge)
    assert found @ np.eye(n) == pytest.approx(cov, abs=1e-13 * np.abs(cov).max())
    rng = np.random.default_rng(0)
    g, low, high = rng.integers(0, 3, n), np.zeros(n), np.full(n, 0.5)
    high[0], low[1] = 0.0, 0.01
    rows = [Linear(f"g{k}", (g == k) * 1.0, (g == k).mean() - 0.05, (g == k).mean() + 0.05) for k in range(3)] + [Linear("x", rng.normal(size=n), 0.02, 0.02), Linear("y", rng.normal(size=n), -0.3)]
    if n == 5:
        rows = []
    want = solvers.minimum_variance(cov, low, high, rows).weights
    got = solvers.least_variance(found, low, high, rows).weights
    assert got == pytest.approx(want, abs=1e-7) and got @ cov @ got <= want @ cov @ want * (1 + 1e-9)


def test_least_variance_of_many_names():
    """3,000 names without a dense table (72 MB): limits hold, and no feasible move lowers the variance."""
    x, n = returns(3_000, 24, 0.001, 1), 3_000
    _, b, rows = sectors(n, 0.02)
    cov = solvers.pairwise(x).positive(1e-8)
    low, high = np.zeros(n), np.full(n, 0.15)
    found, mb = peak_mb(lambda: solvers.least_variance(cov, low, high, rows))
    assert mb < 30 and found.violation < 1e-12
    slope = cov @ found.weights
    for g in rows:  # within a class, what is held has the least slope
        inside = g.coefficients == 1
        held = inside & (found.weights > 1e-10)
        assert slope[held].max() - slope[inside].min() <= 1e-9 * np.abs(slope).max()


def test_least_variance_that_cannot_be():
    x = returns(6, 8, 0.0, 2)
    cov = solvers.pairwise(x).positive(1e-8)
    with pytest.raises(Infeasible):
        solvers.least_variance(cov, np.zeros(6), np.full(6, 0.1))
    with pytest.raises(Infeasible):
        solvers.least_variance(cov, np.zeros(6), np.ones(6), [Linear("x", np.ones(6), 2.0)])
    x[0, :4], x[1, 4:] = np.nan, np.nan
    with pytest.raises(Infeasible):
        solvers.pairwise(x)


def test_least_variance_by_review(spark):
    """The operator gives the weights of the one that is given covariances; odd rows of the panel take no part."""
    dates = [f"2020-{m:02d}-01" for m in range(1, 13)]
    x = returns(12, 12, 0.1, 4)
    panel = [(e, f"i{k}", d, float(x[k, t])) for e in ("2021-01-01", "2022-01-01") for k in range(12) for t, d in enumerate(dates) if x[k, t] == x[k, t]]
    panel += [("2021-01-01", "i0", None, 0.5), ("2021-01-01", None, dates[0], 0.5), ("2021-01-01", "i1", "2020-12-15", None), ("2021-01-01", "i1", "2020-12-16", float("nan"))]
    p = spark.createDataFrame(panel, "effective_date string, instrument_id string, d string, r double").selectExpr("effective_date", "instrument_id", "to_date(d) AS business_date", "r")
    df = spark.createDataFrame([(e, f"i{k}", 1.0, "AB"[k % 2]) for e in ("2021-01-01", "2022-01-01") for k in range(12)], "effective_date string, instrument_id string, benchmark_weight double, industry string")
    limits = Limits(maximum=0.3, groups={"industry": 0.1})
    got = {(r["effective_date"], r["instrument_id"]): r for r in construction.least_variance(df, p, "r", limits).collect()}
    want = construction.minimum_variance(df, risk.covariance(p, "r", ["effective_date"]), limits).collect()
    assert len(got) == len(want) == 24 and {r["solver_status"] for r in got.values()} == {"solved"}
    assert [got[r["effective_date"], r["instrument_id"]]["index_weight"] for r in want] == pytest.approx([r["index_weight"] for r in want], abs=1e-8)
