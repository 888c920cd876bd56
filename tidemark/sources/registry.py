"""Providers by role, on the driver: a small configuration, not data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Provider:
    name: str
    datasets: frozenset[str]
    regions: frozenset[str]
    read: Callable
    fixture: bool = False


@dataclass
class Registry:
    roles: dict[str, Provider] = field(default_factory=dict)

    def bind(self, role: str, provider: Provider, needs: set[str] = frozenset()) -> None:
        if missing := set(needs) - provider.datasets:
            raise ValueError(f"{provider.name} lacks {sorted(missing)}")
        self.roles[role] = provider

    def resolve(self, role: str) -> Provider:
        if role not in self.roles:
            raise KeyError(f"no provider for {role}")
        return self.roles[role]

    def assert_production_safe(self) -> None:
        if bad := sorted(r for r, p in self.roles.items() if p.fixture):
            raise ValueError(f"fixture providers in production: {bad}")
