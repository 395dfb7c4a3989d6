"""What a domain brings: settings, predicates, and builders, looked up by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame

from ..operators.models import Policy
from ..operators.plays import Rules


class FeatureBuilder(Protocol):
    """Point-in-time features of (contest, cutoff) targets, and the cutoffs for training."""

    def build(self, targets: DataFrame) -> DataFrame: ...

    def training_cutoff(self, kickoff: Column) -> Column: ...


@dataclass(frozen=True)
class Domain:
    """Settings of one kind of contest. Columns are made by functions, since they need a session."""

    name: str
    duration_minutes: int = 270
    zone: str = "America/New_York"
    elo: tuple[float, float, float] = (36.0, 45.0, 0.25)
    ridge: float = 8.0
    shrink: float = 0.6
    rules: Rules = Rules()
    policy: Policy = Policy()
    metrics: tuple[str, ...] = ("price_pp", "disc_rate", "return_rate", "tax_f")
    subgroups: Callable[[], dict[str, Column]] = dict
    context_of: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def changed(self, **settings) -> Domain:
        return replace(self, **settings)


DOMAINS: dict[str, Domain] = {}


def register(domain: Domain) -> Domain:
    DOMAINS[domain.name] = domain
    return domain


def domain(name: str) -> Domain:
    try:
        return DOMAINS[name]
    except KeyError:
        raise KeyError(f"no domain {name!r}; there are {sorted(DOMAINS)}") from None


def _suppliers() -> dict[str, Column]:
    from .grading import subgroups

    return subgroups()


register(Domain("suppliers", subgroups=_suppliers, context_of={"neutral": ("neutral",), "conference": ("conf_game",)}))
register(Domain("suppliers_short", duration_minutes=240, elo=(24.0, 30.0, 1 / 3), shrink=0.5, subgroups=_suppliers))
