"""Named queries over the test tables."""

from __future__ import annotations

import importlib

MODULES = ("ingest", "messages", "sampling", "evaluation", "retrieval", "learning", "streams", "formats", "jobs")


def load():
    for module in MODULES:
        importlib.import_module(f"threadloom.catalog.{module}")
    from threadloom.catalog.base import REGISTRY

    return REGISTRY
