"""Handlers by name, and construction with the ports they declare."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any, Protocol, get_type_hints, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Handler(Protocol):
    """A worker: takes a table of events and returns a table of responses."""

    name: str
    event_type: str

    def handle(self, events: DataFrame) -> DataFrame: ...


@runtime_checkable
class Stage(Protocol):
    """A step of a job; ``destructive`` stages are skipped once an error has been recorded."""

    name: str

    def __call__(self, df: DataFrame) -> DataFrame: ...


class Registry:
    def __init__(self) -> None:
        self._classes: dict[str, type] = {}
        self._ports: dict[type, Any] = {}

    def register(self, handler: type) -> type:
        for needed in ("name", "event_type", "handle"):
            if not hasattr(handler, needed):
                raise ValueError(f"{handler.__name__} has no '{needed}'")
        self._classes[handler.name] = handler
        return handler

    def names(self) -> list[str]:
        return list(self._classes)

    def bind(self, port: type, adapter: Any) -> None:
        self._ports[port] = adapter

    def port(self, port: type) -> Any:
        if port not in self._ports:
            raise LookupError(f"no adapter for {port.__name__}")
        return self._ports[port]

    def build(self, name: str) -> Any:
        """The handler with its declared ports; optional ones only where an adapter is bound."""
        if name not in self._classes:
            raise LookupError(f"unknown handler: {name}")
        handler = self._classes[name]
        hints, arguments = get_type_hints(handler.__init__), {}
        for parameter in list(inspect.signature(handler.__init__).parameters.values())[1:]:
            wanted = hints.get(parameter.name)
            if wanted in self._ports:
                arguments[parameter.name] = self._ports[wanted]
            elif parameter.default is inspect.Parameter.empty and parameter.kind not in (parameter.VAR_KEYWORD, parameter.VAR_POSITIONAL):
                raise LookupError(f"{name} needs {getattr(wanted, '__name__', wanted)}, but no adapter is bound")
        return handler(**arguments)


def run_stages(df: DataFrame, stages: list[Callable[[DataFrame], DataFrame]], errors: Callable[[], list[str]] = list) -> tuple[DataFrame, list[str]]:
    """Chain of stages; a destructive one is left out, with a message, when errors exist."""
    skipped: list[str] = []
    for stage in stages:
        found = len(errors()) + len(skipped)
        if getattr(stage, "destructive", False) and found:
            skipped.append(f"{getattr(stage, 'name', stage)}: skipped (destructive step gated by {found} prior error(s))")
        else:
            df = df.transform(stage)
    return df, skipped
