"""A graph's variables: a dictionary with the usual updates. Each call returns new variables, as graphs don't change either."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any

from graphloom.model import InvalidProperty


class Variables(Mapping):
    def __init__(self, values: Mapping[str, Any] | None = None):
        self._values = dict(values or {})

    def __getitem__(self, key: str) -> Any:
        return self._values[key]

    def __iter__(self) -> Iterator[str]:
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def set(self, key: str, value: Any) -> "Variables":
        """Raises on a blank key and on None."""
        if not key.strip() or value is None:
            raise InvalidProperty(f"{key!r} can't be set to {value!r}")
        return Variables(self._values | {key: value})

    def remove(self, *keys: str) -> "Variables":
        return Variables({k: v for k, v in self._values.items() if k not in keys})

    def set_if_absent(self, key: str, value: Any) -> "Variables":
        return self if key in self else self.set(key, value)

    def compute_if_absent(self, key: str, make: Callable[[str], Any]) -> "Variables":
        return self if key in self else self.set(key, make(key))

    def replace(self, key: str, value: Any) -> "Variables":
        """Only where there is one."""
        return self.set(key, value) if key in self else self

    def compare_and_set(self, key: str, old: Any, new: Any) -> tuple["Variables", bool]:
        """And whether the old value was the given one."""
        return (self.set(key, new), True) if self.get(key) == old else (self, False)

    def merge(self, key: str, value: Any, with_old: Callable[[Any, Any], Any]) -> "Variables":
        """The old value combined with the given one; the given one where there is none. A result of None removes it."""
        new = with_old(self[key], value) if key in self else value
        return self.remove(key) if new is None else self.set(key, new)

    def update(self, other: Mapping[str, Any]) -> "Variables":
        return Variables(self._values | dict(other))

    def with_prefix(self, prefix: str) -> "Variables":
        return Variables({k: v for k, v in self._values.items() if k.startswith(prefix)})

    def without_prefix(self, prefix: str) -> "Variables":
        return Variables({k: v for k, v in self._values.items() if not k.startswith(prefix)})
