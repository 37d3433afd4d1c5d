"""Analytics plugins: named functions that make tables from tables, run in the order of their needs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from enum import StrEnum
from typing import Any

from pyspark.sql import DataFrame

from ..operators import attribution, performance, quality, reviews


class Missing(StrEnum):
    WARN = "warn_and_skip"
    FAIL = "fail"


class MissingInput(LookupError):
    """A table that a plugin needs is not there."""


class ReturnSeries(StrEnum):
    PRICE = "price"
    GROSS = "gross_total"
    NET = "net_total"

    @property
    def columns(self) -> tuple[str, str]:
        return f"index_{self}_return", f"benchmark_{self}_return"


@dataclass(frozen=True)
class Settings:
    series: ReturnSeries = ReturnSeries.NET
    year: int = 252
    tolerance: float = 1e-8
    missing: Missing = Missing.WARN


@dataclass(frozen=True)
class Plugin:
    """``make(tables, settings, **parameters)`` gives the tables in ``provides``, as ``plugin.table``."""

    name: str
    make: Callable[..., Mapping[str, DataFrame]]
    requires: frozenset[str] = frozenset()
    provides: frozenset[str] = frozenset()
    version: str = "1"


@dataclass
class Result:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def run(plugins: Sequence[Plugin], inputs: Mapping[str, DataFrame], settings: Settings | None = None, parameters: Mapping[str, Mapping[str, Any]] | None = None) -> Result:
    """Plugins as soon as what they need is there. What cannot run is skipped with a warning, or fails."""
    settings = settings or Settings()
    have, result, left = dict(inputs), Result(), list(plugins)
    while left:
        ready = next((p for p in left if p.requires <= set(have)), None)
        if ready is None:
            break
        left.remove(ready)
        try:
            made = ready.make(have, settings, **(parameters or {}).get(ready.name, {}))
        except MissingInput as e:
            if settings.missing == Missing.FAIL:
                raise
            result.warnings.append(f"{ready.name}: {e}")
            continue
        made = {f"{ready.name}.{k}": d for k, d in made.items()}
        result.tables |= made
        have |= made
    for p in left:
        lacking = sorted(p.requires - set(have))
        if settings.missing == Missing.FAIL:
            raise MissingInput(f"{p.name} lacks {lacking}")
        result.warnings.append(f"{p.name} lacks {lacking}")
    return result


def _core(t, s):
    c = t["constituents"]
    return {"validation": reviews.validation(c, s.tolerance), "metrics": reviews.metrics(c, s.tolerance), "country_exposures": reviews.exposures(c, "country"), "industry_exposures": reviews.exposures(c, "industry"), "target_weight_change": reviews.target_weight_change(c)}


def _needs(df: DataFrame, columns: Sequence[str]) -> None:
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise MissingInput(f"columns {gone}")


def _performance(t, s):
    i, b = s.series.columns
    _needs(t["daily"], (i, b))
    return {"summary": performance.against_benchmark(t["daily"], i, b, year=s.year)}


def _years(t, s):
    return {"annual": performance.calendar_years(t["daily"], *s.series.columns)}


def _rolling(t, s, windows=(21, 63, 252, 756)):
    return {"windows": performance.rolling_risk(t["daily"], *s.series.columns, windows=windows, year=s.year, least=0.8)}


def _episodes(t, s):
    return {"episodes": performance.drawdown_episodes(t["daily"].select("business_date", s.series.columns[0]), s.series.columns[0])}


def _changes(t, s):
    return {"detail": reviews.changes(t["constituents"], s.tolerance), "membership_stability": reviews.membership_stability(t["constituents"], s.tolerance)}


def _contributors(t, s):
    return {"detail": reviews.contributors(t["constituents"], s.tolerance), "summary": reviews.contributors_by_status(t["constituents"], s.tolerance)}


def _decomposition(t, s):
    return {"detail": reviews.turnover_decomposition(t["constituents"], s.tolerance)}


def _reasons(t, s):
    _needs(t["constituents"], ("selection_reason",))
    detail, summary = reviews.selection_reasons(t["constituents"])
    return {"detail": detail, "summary": summary}


def signal_columns(df: DataFrame) -> list[str]:
    """Fields found by name: factor, signal, score and z-score columns."""
    return [c for c, k in df.dtypes if k in ("double", "float") and (c == "factor_score" or c.endswith(("_factor", "_signal", "_score", "_zscore")))]


def _signals(t, s, fields=None):
    fields = fields or signal_columns(t["constituents"])
    if not fields:
        raise MissingInput("no factor or signal columns")
    return {"review": reviews.field_statistics(t["constituents"], fields, tolerance=s.tolerance)}


def _capacity(t, s, limit="capacity_weight_limit"):
    _needs(t["constituents"], (limit,))
    return {"capacity": reviews.capacity(t["constituents"], limit, s.tolerance), "coverage": reviews.field_statistics(t["constituents"], [limit], tolerance=s.tolerance)}


def _coverage(t, s):
    return {"reviews": quality.missing_cells(t["constituents"])}


def _freshness(t, s):
    records = t["constituents"]
    dates = [c for c in records.columns if c.endswith("_date") and c not in ("effective_date", "reference_date")]
    if not dates:
        raise MissingInput("no observation dates")
    return {"sources": quality.freshness(quality.freshness_records(records, dates))}


def _targets(t, s):
    return {"targets": quality.target_attainment(t["targets"])}


def _constraints(t, s):
    d = quality.constraint_diagnostics(t["constraints"], s.tolerance)
    return {"detail": d, "summary": quality.constraint_summary(d)}


def _attribution(t, s):
    detail = attribution.brinson(t["attribution"])
    totals = attribution.brinson_totals(detail)
    linked = attribution.carino(totals)
    return {"detail": detail, "totals": totals, "linked": linked, "linked_totals": attribution.carino_totals(linked, totals)}


_C, _D = frozenset({"constituents"}), frozenset({"daily"})
BUILTIN = (
    Plugin("core", _core, _C), Plugin("performance", _performance, _D), Plugin("calendar_period_performance", _years, _D), Plugin("rolling_risk", _rolling, _D), Plugin("drawdown_episodes", _episodes, _D),
    Plugin("constituent_change", _changes, _C), Plugin("weight_change_contributors", _contributors, frozenset({"constituents", "constituent_change.detail"})), Plugin("turnover_decomposition", _decomposition, frozenset({"constituents", "constituent_change.detail"})),
    Plugin("selection_reasons", _reasons, _C), Plugin("factor_signal_exposure", _signals, _C), Plugin("liquidity_capacity_coverage", _capacity, _C), Plugin("data_coverage", _coverage, _C), Plugin("data_freshness", _freshness, _C),
    Plugin("target_attainment", _targets, frozenset({"targets"})), Plugin("constraint_diagnostics", _constraints, frozenset({"constraints"})), Plugin("multi_period_attribution", _attribution, frozenset({"attribution"})),
)
PROFILES = {"legacy_parity": ("core",), "standard_research": tuple(p.name for p in BUILTIN)}


def profile(name: str) -> list[Plugin]:
    return [p for p in BUILTIN if p.name in PROFILES[name]]


class Features:
    """Functions by name, for callers that pick analytics from configuration."""

    def __init__(self) -> None:
        from ..operators import events, regimes, risk

        self._held: dict[str, Callable] = {
            "performance": performance.against_benchmark, "rolling_risk": performance.rolling_risk, "drawdowns": performance.with_drawdown, "brinson": attribution.brinson, "factor_attribution": attribution.factor_model,
            "weighted_exposures": reviews.weighted_exposures, "concentration": reviews.concentration, "risk_contributions": risk.contributions, "liquidity": risk.liquidity, "weight_changes": reviews.explained_changes,
            "weight_construction": reviews.explain_tilts, "coverage": quality.coverage, "freshness": quality.freshness, "regimes": regimes.statistics, "event_study": events.windows, "reconciliation": quality.compare_stages,
        }

    def register(self, name: str, function: Callable) -> None:
        if name in self._held:
            raise ValueError(f"feature {name} is registered")
        self._held[name] = function

    def run(self, name: str, *args: Any, **how: Any) -> Any:
        if name not in self._held:
            raise LookupError(f"unknown feature {name}; known: {sorted(self._held)}")
        return self._held[name](*args, **how)
