"""Adapter views over the driver tables, and the registered queries with their oracle SQL."""

import importlib

MODULES = ("yields", "dashboard", "engineering", "stream", "quality", "trace", "sources", "flows")


def load() -> None:
    """Import every plan module, which registers its queries."""
    for module in MODULES:
        importlib.import_module(f"testfloor.plans.{module}")
