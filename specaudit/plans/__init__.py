"""Named queries, one module per area."""

from importlib import import_module

AREAS = ["evaluation", "relational", "scalars", "audits", "graphs", "linting", "consistency", "documents", "ingest", "marts", "streams"]


def _load():
    for area in AREAS:
        import_module(f"specaudit.plans.{area}")
    return import_module("specaudit.plans.registry")


def all_builders():
    return _load().builders()


def all_oracles():
    return _load().oracles()
