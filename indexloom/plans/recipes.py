"""Recipes: graphs of stages over lazy DataFrames, with digests for reuse, and adapters to them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from enum import StrEnum
from typing import Any, Protocol

from pyspark.sql import DataFrame

from ..sources.rules import Rule


class Scope(StrEnum):
    CONTENT = "content"
    RECIPE = "recipe"
    RUN = "run"
    DISABLED = "disabled"


class PriorState(StrEnum):
    REQUIRED = "required"
    OPTIONAL = "optional"
    EMPTY_INITIAL = "empty_initial"


class RecipeError(ValueError):
    pass


class Stage(Protocol):
    """Makes named tables of named tables."""

    def run(self, inputs: Mapping[str, DataFrame]) -> Mapping[str, DataFrame]: ...


def digest(value: Any) -> str:
    """SHA-256 of canonical JSON; what JSON lacks goes by its text."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


@dataclass(frozen=True)
class Node:
    """A function of tables in a graph.

    ``inputs``: names of other nodes' outputs or of what the run is given;
    ``outputs``: what it makes. Its digest covers kind, version,
    configuration and the digests of its inputs.
    """

    name: str
    function: Callable[..., DataFrame | Mapping[str, DataFrame]]
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    configuration: Mapping[str, Any] = field(default_factory=dict)
    version: str = "1"
    scope: Scope = Scope.DISABLED
    deterministic: bool = True

    @property
    def makes(self) -> tuple[str, ...]:
        return self.outputs or (self.name,)

    def run(self, inputs: Mapping[str, DataFrame]) -> Mapping[str, DataFrame]:
        made = self.function(*[inputs[i] for i in self.inputs], **self.configuration)
        made = {self.makes[0]: made} if isinstance(made, DataFrame) else dict(made)
        if set(made) != set(self.makes):
            raise RecipeError(f"{self.name} made {sorted(made)}, not {sorted(self.makes)}")
        return made


@dataclass(frozen=True)
class Recipe:
    name: str
    nodes: tuple[Node, ...]

    def order(self, given: Sequence[str] = ()) -> list[Node]:
        """Nodes after those they need, else as listed; unknown inputs, repeated outputs and circles are errors."""
        maker: dict[str, Node] = {}
        for n in self.nodes:
            for o in n.makes:
                if o in maker or o in given:
                    raise RecipeError(f"{o} is made twice")
                maker[o] = n
        done, out, open_ = set(given), [], list(self.nodes)
        while open_:
            ready = next((n for n in open_ if set(n.inputs) <= done), None)
            if ready is None:
                unknown = sorted({i for n in open_ for i in n.inputs} - done - set(maker))
                raise RecipeError(f"unknown inputs: {unknown}" if unknown else f"circle among {[n.name for n in open_]}")
            open_.remove(ready)
            out.append(ready)
            done |= set(ready.makes)
        return out

    def digests(self, given: Mapping[str, str] | None = None) -> dict[str, str]:
        known = dict(given or {})
        for n in self.order(list(known)):
            d = digest([n.name, n.version, dict(n.configuration), [known[i] for i in n.inputs]])
            known |= {o: digest([d, o]) for o in n.makes}
        return known

    def graph(self) -> list[dict]:
        """Edges as rows: ``node, input, made_by``."""
        maker = {o: n.name for n in self.nodes for o in n.makes}
        return [{"node": n.name, "input": i, "made_by": maker.get(i)} for n in self.nodes for i in n.inputs]


class Cache(Protocol):
    def load(self, key: str) -> DataFrame | None: ...

    def save(self, key: str, df: DataFrame) -> DataFrame: ...


class MemoryCache:
    """Plans kept by digest within a session: nothing is computed twice over, nothing is stored."""

    def __init__(self) -> None:
        self._held: dict[str, DataFrame] = {}

    def load(self, key: str) -> DataFrame | None:
        return self._held.get(key)

    def save(self, key: str, df: DataFrame) -> DataFrame:
        return self._held.setdefault(key, df)


def run(recipe: Recipe, given: Mapping[str, DataFrame] | None = None, cache: Cache | None = None, given_digests: Mapping[str, str] | None = None, wanted: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Every table of the recipe, lazily; only nodes that ``wanted`` tables need are run.

    Deterministic nodes with a cache scope are looked up by digest, which
    needs digests of the given tables they build on.
    """
    tables = dict(given or {})
    nodes = recipe.order(list(tables))
    if wanted is not None:
        need, keep = set(wanted), set()
        for n in reversed(nodes):
            if need & set(n.makes):
                keep.add(n.name)
                need |= set(n.inputs)
        nodes = [n for n in nodes if n.name in keep]
    keys = recipe.digests(given_digests) if given_digests is not None and set(given_digests) >= set(tables) else {}
    for n in nodes:
        cached = cache is not None and n.scope != Scope.DISABLED and n.deterministic and all(o in keys for o in n.makes)
        found = {o: cache.load(keys[o]) for o in n.makes} if cached else {}
        if cached and all(d is not None for d in found.values()):
            tables |= found
            continue
        made = n.run(tables)
        tables |= {o: cache.save(keys[o], d) for o, d in made.items()} if cached else made
    return tables


def rule_node(name: str, rule: Rule, source: str) -> Node:
    """A loading rule as a node."""
    return Node(name, lambda df: rule(df), (source,))


class Stages:
    """Factories of nodes by kind, so that recipes can be written as configuration."""

    def __init__(self) -> None:
        self._kinds: dict[str, Callable[..., Node]] = {}

    def register(self, kind: str, factory: Callable[..., Node]) -> None:
        if kind in self._kinds:
            raise RecipeError(f"kind {kind} is registered")
        self._kinds[kind] = factory

    def build(self, name: str, specification: Sequence[Mapping[str, Any]]) -> Recipe:
        nodes = []
        for s in specification:
            s = dict(s)
            if s["kind"] not in self._kinds:
                raise RecipeError(f"unknown kind {s['kind']}; known: {sorted(self._kinds)}")
            nodes.append(self._kinds[s.pop("kind")](**s))
        return Recipe(name, tuple(nodes))


def factor_tilt_recipe(tilts: Mapping[str, float], **how: Any) -> Recipe:
    """universe -> standardised -> weights."""
    from ..operators.construction import standardised, tilted

    return Recipe("factor_tilt", (
        Node("standardised", lambda u, fields: standardised(u, fields), ("universe",), configuration={"fields": sorted(tilts)}, scope=Scope.CONTENT),
        Node("weights", lambda s, tilts, **k: tilted(s, tilts, **k), ("standardised",), configuration={"tilts": dict(tilts), **how}, scope=Scope.RECIPE),
    ))


def quantile_recipe(signals: Mapping[str, float], **how: Any) -> Recipe:
    """universe -> standardised -> weights of the best names."""
    from ..operators.construction import selected, standardised

    return Recipe("quantile_selection", (
        Node("standardised", lambda u, fields: standardised(u, fields), ("universe",), configuration={"fields": sorted(signals)}, scope=Scope.CONTENT),
        Node("weights", lambda s, signals, **k: selected(s, signals, **k), ("standardised",), configuration={"signals": dict(signals), **how}, scope=Scope.RECIPE),
    ))


def minimum_variance_recipe(limits: Any, column: str = "price_return", **how: Any) -> Recipe:
    """universe and market data -> covariance -> weights."""
    from ..operators.construction import minimum_variance
    from ..operators.risk import covariance

    return Recipe("minimum_variance", (
        Node("covariance", lambda m, column: covariance(m, column, ["effective_date"]), ("market_data",), configuration={"column": column}, scope=Scope.CONTENT),
        Node("weights", lambda u, c, **k: minimum_variance(u, c, limits, **k), ("universe", "covariance"), configuration=how, scope=Scope.RECIPE),
    ))


def each_review(recipe: Recipe, reviews: Sequence[tuple[str, Mapping[str, DataFrame]]], prior: PriorState = PriorState.OPTIONAL, empty: DataFrame | None = None, save: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """A recipe run review by review for methods that build on the weights before: each gets ``previous_weights``.

    Each review's weights are saved (by default in the session's checkpoint
    folder) and read again, so that no plan holds the reviews before it.
    """
    save = save or (lambda date, df: df.checkpoint())
    out: dict[str, DataFrame] = {}
    last = empty
    for date, given in reviews:
        if last is None and prior == PriorState.REQUIRED:
            raise RecipeError(f"{date} has no weights before it")
        more = {} if last is None else {"previous_weights": last}
        out[date] = last = save(date, run(recipe, {**given, **more}, wanted=["weights"])["weights"])
    return out
