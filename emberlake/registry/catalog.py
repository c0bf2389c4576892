"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from emberlake.registry.base import ORACLES, QUERIES

MODULES = ["columns", "joins", "aggs", "windows", "storage", "streams", "learn", "answers"]


def _load() -> None:
    for name in MODULES:
        import_module(f"emberlake.registry.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
