"""Where strategies come from: documents in code, in a folder of a store, and several of these in order."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any, Protocol

from barloom.plans.strategy import Strategy, load, parse
from barloom.sources.store import Store


class Provider(Protocol):
    """Makes strategies by name; ``None`` where it doesn't know one."""

    def create(self, name: str, overrides: dict[str, Any] | None = None) -> Strategy | None: ...

    def listed(self) -> list[dict]: ...


class Documents:
    """Strategies from documents by name (objects, JSON or YAML)."""

    def __init__(self, documents: dict[str, str | dict] | Callable[[], dict[str, str | dict]]):
        self._read = documents if callable(documents) else lambda: documents

    def create(self, name: str, overrides: dict[str, Any] | None = None) -> Strategy | None:
        found = self._read().get(name)
        return None if found is None else parse(found, overrides)

    def listed(self) -> list[dict]:
        made = {name: load(d) for name, d in self._read().items()}
        return [{"name": n, "description": str(d.get("description") or ""), "parameters": d.get("parameters") or {}} for n, d in sorted(made.items())]

    @classmethod
    def of_store(cls, store: Store) -> Documents:
        """The documents saved in a store, as they are at each call."""
        return cls(lambda: {r["name"]: r["document"] for r in store.documents().select("name", "document").collect()})  # a row a strategy


class Chain:
    """Providers in order: the first that knows a name makes it, and it is listed once."""

    def __init__(self, providers: Iterable[Provider]):
        self.providers = list(providers)

    def create(self, name: str, overrides: dict[str, Any] | None = None) -> Strategy | None:
        return next((s for p in self.providers if (s := p.create(name, overrides)) is not None), None)

    def listed(self) -> list[dict]:
        found: dict[str, dict] = {}
        for p in self.providers:
            for x in p.listed():
                found.setdefault(x["name"], x)
        return [found[n] for n in sorted(found)]

    def exists(self, name: str) -> bool:
        return any(x["name"] == name for x in self.listed())
