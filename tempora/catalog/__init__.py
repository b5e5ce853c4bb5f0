"""Registered queries over the star-schema tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

import importlib

_MODULES = ("climate", "summaries", "ingest", "models", "text", "answers", "sft", "documents", "streams", "mergeable", "upkeep", "dashboard")


def load():
    """Import every catalog module and return the registry."""
    from tempora.catalog.base import REGISTRY

    for m in _MODULES:
        importlib.import_module(f"tempora.catalog.{m}")
    return REGISTRY
