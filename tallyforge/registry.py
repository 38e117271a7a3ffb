"""Kinds of loaders, processors and sinks by name (EXT-5): our own, and those of installed packages' entry points."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from importlib.metadata import entry_points
from typing import Any

GROUPS = ("loaders", "features", "metrics", "gap", "outputs")
_own: dict[str, dict[str, Any]] = {g: {} for g in GROUPS}


def register(group: str, name: str) -> Callable[[Any], Any]:
    def add(thing: Any) -> Any:
        _own[group][name] = thing
        found.cache_clear()
        return thing

    return add


@cache
def found(group: str) -> dict[str, Any]:
    """All of a group; installed ones never hide our own. Classes of processors must be such."""
    from tallyforge.operators.base import Processor

    out = {}
    for point in entry_points(group=f"tallyforge.{group}"):
        thing = point.load()
        if group in ("features", "metrics", "gap") and not (isinstance(thing, type) and issubclass(thing, Processor)):
            raise TypeError(f"{point.name} of {group} isn't a processor")
        out[point.name] = thing
    return out | _own[group]


def get(group: str, name: str) -> Any:
    try:
        return found(group)[name]
    except KeyError:
        raise ValueError(f"no {name!r} in {group}; there are {sorted(found(group))}") from None
