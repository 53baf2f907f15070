"""All registered queries, grouped by area."""

import importlib

AREAS = ["text", "rules", "aggregates", "selection", "matching", "mapping", "files"]


def load():
    for area in AREAS:
        importlib.import_module(f"muster.catalog.{area}")
    from muster.catalog import registry

    return registry
