"""Example queries on the driver's tables."""

from importlib import import_module


def load():
    """Import all query modules and return the registry."""
    for name in ("basic", "text", "stats", "models"):
        import_module(f"tickerpulse.fixtures.queries_{name}")
    return import_module("tickerpulse.fixtures.registry")
