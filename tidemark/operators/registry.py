"""Named check and convert functions over an upload's rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Function = Callable[[DataFrame], DataFrame]


class Registry:
    """Functions from DataFrame to DataFrame, known by their own names."""

    def __init__(self, kind: str):
        self.kind = kind
        self._entries: dict[str, tuple[Function, str]] = {}

    def register(self, label: str | None = None) -> Callable[[Function], Function]:
        """Decorator. The same function may come twice, another of the same name may not."""

        def add(function: Function) -> Function:
            name = function.__name__
            known = self._entries.get(name)
            if known and known[0] is not function:
                raise ValueError(f"there is already a {self.kind} named {name!r}")
            self._entries[name] = (function, label or name)
            return function

        return add

    def get(self, name: str) -> Function:
        try:
            return self._entries[name][0]
        except KeyError:
            raise LookupError(f"there is no {self.kind} named {name!r}") from None

    def names(self) -> list[str]:
        return sorted(self._entries)

    def choices(self) -> list[tuple[str, str]]:
        """(name, label), in the order a reader expects to find the labels."""
        pairs = [(name, label) for name, (_, label) in self._entries.items()]
        return sorted(pairs, key=lambda pair: pair[1].casefold())


checkers = Registry("checker")
converters = Registry("converter")
