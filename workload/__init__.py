"""Every operator wired to the test tables, each with its DuckDB counterpart where SQL can say it."""

from importlib import import_module

MODULES = ("sources", "scalars", "master", "profiles", "aggregates", "amounts", "search", "names")


def load():
    """(queries, oracles) of all modules."""
    for name in MODULES:
        import_module(f"workload.{name}")
    from workload.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
