"""Problems, objectives and solvers by name: a problem goes to the solver it asks for, or not at all."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd

from . import solvers
from .solvers import Infeasible, Linear, Solution


class Unsupported(ValueError):
    """The solver that was asked for cannot solve this kind of problem; no other is tried."""


class Objective(Protocol):
    """``kind`` names what a solver must be able to do; value and gradient are of the weights."""

    kind: str

    def value(self, w: np.ndarray) -> float: ...

    def gradient(self, w: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class LinearObjective:
    coefficients: np.ndarray
    kind: str = "linear"

    def value(self, w: np.ndarray) -> float:
        return float(self.coefficients @ w)

    def gradient(self, w: np.ndarray) -> np.ndarray:
        return self.coefficients


@dataclass(frozen=True)
class QuadraticObjective:
    """``w'Pw / 2 + q'w``."""

    p: np.ndarray
    q: np.ndarray
    kind: str = "quadratic"

    def value(self, w: np.ndarray) -> float:
        return float(w @ self.p @ w / 2 + self.q @ w)

    def gradient(self, w: np.ndarray) -> np.ndarray:
        return self.p @ w + self.q


@dataclass(frozen=True)
class CallableObjective:
    """A user's function of the weights; without its gradient, differences stand in."""

    function: Callable[[np.ndarray], float]
    slope: Callable[[np.ndarray], np.ndarray] | None = None
    kind: str = "callable"

    def value(self, w: np.ndarray) -> float:
        return float(self.function(w))

    def gradient(self, w: np.ndarray) -> np.ndarray:
        if self.slope is not None:
            return np.asarray(self.slope(w), float)
        h = 1e-6
        return np.array([(self.function(w + h * e) - self.function(w - h * e)) / (2 * h) for e in np.eye(len(w))])


@dataclass(frozen=True)
class Problem:
    """Least ``objective`` with bounds, a sum and linear rows."""

    objective: Objective
    lower: np.ndarray
    upper: np.ndarray
    linear: Sequence[Linear] = ()
    total: float = 1.0
    start: np.ndarray | None = None


class Solver(Protocol):
    name: str
    kinds: frozenset[str]

    def solve(self, problem: Problem) -> Solution: ...


@dataclass(frozen=True)
class Splitting:
    """Linear and convex quadratic objectives by operator splitting."""

    name: str = "splitting"
    kinds: frozenset[str] = frozenset({"linear", "quadratic"})

    def solve(self, problem: Problem) -> Solution:
        n = len(problem.lower)
        o = problem.objective
        p, q = (o.p, o.q) if isinstance(o, QuadraticObjective) else (np.zeros((n, n)), o.coefficients)
        size = max(np.abs(p).max(initial=0), np.abs(q).max(initial=0)) or 1.0
        a, low, high = solvers._rows(n, problem.lower, problem.upper, list(problem.linear), problem.total)
        w, k = solvers.quadratic(p / size, q / size, a, low, high)
        return solvers.verified(w, k, problem.lower, problem.upper, list(problem.linear), problem.total, objective=o.value(w))


@dataclass(frozen=True)
class ProjectedGradient:
    """Any smooth objective: steps down its gradient, each projected on what is allowed, until weights rest."""

    name: str = "projected_gradient"
    kinds: frozenset[str] = frozenset({"linear", "quadratic", "callable"})
    rounds: int = 2_000
    tolerance: float = 1e-9

    def solve(self, problem: Problem) -> Solution:
        o, rows = problem.objective, list(problem.linear)
        nearest = lambda v: solvers.closest(v, problem.lower, problem.upper, rows, problem.total).weights
        w = nearest(problem.start if problem.start is not None else np.full(len(problem.lower), problem.total / len(problem.lower)))
        step, k = 1.0, 0
        for k in range(1, self.rounds + 1):
            g, f = o.gradient(w), o.value(w)
            new = nearest(w - step * g)
            while o.value(new) > f + g @ (new - w) + ((new - w) ** 2).sum() / (2 * step) + 1e-15 and step > 1e-12:
                step /= 2
                new = nearest(w - step * g)
            moved, w = np.abs(new - w).max(), new
            if moved <= self.tolerance:
                break
            step *= 1.5
        return solvers.verified(w, k, problem.lower, problem.upper, rows, problem.total, objective=o.value(w))


class PortfolioSolver(Protocol):
    """A plain function of a review's rows to their weights."""

    def __call__(self, constituents: pd.DataFrame) -> np.ndarray: ...


@dataclass(frozen=True)
class Adapter:
    """A plain solver of arrays as a solver of problems."""

    function: Callable[[Problem], np.ndarray]
    name: str = "portfolio_solver"
    kinds: frozenset[str] = frozenset({"callable"})

    def solve(self, problem: Problem) -> Solution:
        return solvers.verified(np.asarray(self.function(problem), float), 1, problem.lower, problem.upper, list(problem.linear), problem.total)


@dataclass
class Router:
    """Solvers by name. Each problem names its solver: an unknown one, or one that cannot do its kind, is an error."""

    solvers: dict[str, Solver] = field(default_factory=lambda: {s.name: s for s in (Splitting(), ProjectedGradient())})

    def register(self, solver: Solver, replace: bool = False) -> None:
        if solver.name in self.solvers and not replace:
            raise ValueError(f"{solver.name} is registered")
        self.solvers[solver.name] = solver

    def capabilities(self) -> dict[str, frozenset[str]]:
        return {n: s.kinds for n, s in self.solvers.items()}

    def solve(self, problem: Problem, solver: str, check: bool = True) -> Solution:
        if solver not in self.solvers:
            raise Unsupported(f"no solver {solver}; known: {sorted(self.solvers)}")
        chosen = self.solvers[solver]
        if problem.objective.kind not in chosen.kinds:
            raise Unsupported(f"{solver} does not solve {problem.objective.kind} objectives")
        if check:
            off = least_relaxation(problem.lower, problem.upper, problem.linear, problem.total)
            if sum(off.values()) > 1e-6:
                raise Infeasible(f"rows must give way: { {k: round(v, 9) for k, v in off.items() if v} }")
        return chosen.solve(problem)


def least_relaxation(lower: np.ndarray, upper: np.ndarray, linear: Sequence[Linear], total: float = 1.0) -> dict[str, float]:
    """How much each row gives way where all rows together give way the least, in sum, for any weights to exist."""
    if lower.sum() > total + 1e-9 or upper.sum() < total - 1e-9:
        raise Infeasible("bounds cannot add up to the total")
    n, m = len(lower), len(linear)
    if not m:
        return {}
    rows = np.zeros((1 + m, n + 2 * m))
    rows[0, :n] = 1
    for i, c in enumerate(linear):
        rows[1 + i, :n] = c.coefficients
        rows[1 + i, n + i], rows[1 + i, n + m + i] = 1, -1
    a = np.vstack([np.eye(n + 2 * m), rows])
    low = np.concatenate([lower, np.zeros(2 * m), [total], [c.lower for c in linear]])
    high = np.concatenate([upper, np.full(2 * m, np.inf), [total], [c.upper for c in linear]])
    x, _ = solvers.quadratic(np.zeros((n + 2 * m,) * 2), np.concatenate([np.zeros(n), np.ones(2 * m)]), a, low, high, tolerance=1e-9)
    given = x[n : n + m] + x[n + m :]
    return {c.name: float(s) if s > 1e-6 else 0.0 for c, s in zip(linear, given)}


def solve_nonlinear(objective: Callable[[np.ndarray], float], start: np.ndarray, lower: np.ndarray, upper: np.ndarray, linear: Sequence[Linear] = (), gradient: Callable[[np.ndarray], np.ndarray] | None = None, total: float = 1.0) -> Solution:
    """A user's objective in one call."""
    return Router().solve(Problem(CallableObjective(objective, gradient), lower, upper, linear, total, start), "projected_gradient")


class CovarianceEstimator(Protocol):
    """Returns (dates by names) to a covariance matrix."""

    def estimate(self, returns: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class SampleCovariance:
    def estimate(self, returns: np.ndarray) -> np.ndarray:
        return np.atleast_2d(np.cov(returns[~np.isnan(returns).any(1)], rowvar=False, ddof=1))


@dataclass(frozen=True)
class ShrunkCovariance:
    """Towards its diagonal by ``intensity``."""

    intensity: float = 0.2

    def estimate(self, returns: np.ndarray) -> np.ndarray:
        s = SampleCovariance().estimate(returns)
        return (1 - self.intensity) * s + self.intensity * np.diag(np.diag(s))


def estimated(panel, column: str, by: str, estimator: CovarianceEstimator):
    """``(<by>, i, j, cov)`` by any estimator, one group's matrix a task."""
    kind = dict(panel.dtypes)[by]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="business_date", columns="instrument_id", values=column).sort_index()
        names, m = [str(c) for c in x.columns], estimator.estimate(x.to_numpy(float))
        return pd.DataFrame({"i": np.repeat(names, len(names)), "j": names * len(names), "cov": m.ravel(), by: pdf[by].iloc[0]})

    return panel.select(by, "business_date", "instrument_id", column).groupBy(by).applyInPandas(fit, f"i string, j string, cov double, `{by}` {kind}")


@dataclass(frozen=True)
class Catalogue:
    """Named factories of research parts: ``create`` makes one from its parameters."""

    factories: Mapping[str, Callable]

    def create(self, name: str, **parameters):
        if name not in self.factories:
            raise LookupError(f"no factory {name}; known: {sorted(self.factories)}")
        return self.factories[name](**parameters)
