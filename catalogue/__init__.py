"""Every registered query: name -> (Spark query, SQL twin or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ["columns", "profiles", "roles", "association", "checks", "preparation", "metrics", "models", "rules", "sources"]


def entries() -> dict:
    out: dict = {}
    for module in MODULES:
        for name, pair in import_module(f"catalogue.{module}").QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = pair
    return out
