"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = ("features", "checks", "scoring", "metrics", "feedback", "detectors", "models", "sources", "streams")


def load():
    for name in MODULES:
        importlib.import_module(f"paywarden.catalog.{name}")
    from paywarden.catalog.registry import QUERIES

    return QUERIES
