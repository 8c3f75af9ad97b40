"""Named extension points, filled by decorators and, when a name is missing, by entry points."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points
from typing import Any

from .errors import RegistryError


class Registry:
    """Names of one kind of plugin."""

    def __init__(self, kind: str):
        self.kind, self._found, self._loaded = kind, {}, False

    def add(self, *names: str, replace: bool = False) -> Callable[[Any], Any]:
        def put(item: Any) -> Any:
            for name in names:
                if name in self._found and not replace and self._found[name] is not item:
                    raise RegistryError(f"{self.kind} {name!r} is registered already")
                self._found[name] = item
            return item

        return put

    def get(self, name: str) -> Any:
        if name not in self._found and not self._loaded:
            self._loaded = True
            for point in entry_points(group=f"weirflow.{self.kind}"):
                self._found.setdefault(point.name, point.load())
        if name not in self._found:
            raise RegistryError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self._found))}")
        return self._found[name]

    def names(self) -> list[str]:
        return sorted(self._found)


TRANSFORMS = Registry("transforms")
EXPRESSIONS = Registry("expressions")
NOTIFIERS = Registry("notifiers")
SECRET_PROVIDERS = Registry("secret_providers")
LOAD_STRATEGIES = Registry("load_strategies")
ADAPTERS = Registry("adapters")

register_transform = TRANSFORMS.add
register_expression = EXPRESSIONS.add
register_notifier = NOTIFIERS.add
register_secret_provider = SECRET_PROVIDERS.add
register_load_strategy = LOAD_STRATEGIES.add
register_adapter = ADAPTERS.add
