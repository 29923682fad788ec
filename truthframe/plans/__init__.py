"""Registered queries over the driver's tables, with the SQL they must equal."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("logic", "reasoning", "graphs", "interactions", "text", "ontology", "modules", "streams", "files")


def _load() -> None:
    for m in _MODULES:
        import_module(f"truthframe.plans.{m}")


def core_queries() -> dict:
    from truthframe.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def core_oracles() -> dict[str, str]:
    from truthframe.plans.registry import ORACLES

    _load()
    return dict(ORACLES)
