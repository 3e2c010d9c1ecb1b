"""Registered queries over the given tables."""

from __future__ import annotations

from types import SimpleNamespace


def load() -> SimpleNamespace:
    """Import every query module and return what they registered."""
    from foldsmith.catalog import groups, pipelines, registry, rows, selecting  # noqa: F401

    return SimpleNamespace(queries=registry.QUERIES, oracles=registry.ORACLES)
