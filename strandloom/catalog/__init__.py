"""Named queries over the given tables, each with an SQL statement of its result."""

from importlib import import_module

_MODULES = ("relational", "geometry", "structures", "library", "files")


def _merged(attribute: str) -> dict:
    result: dict = {}
    for name in _MODULES:
        result.update(getattr(import_module(f"strandloom.catalog.{name}"), attribute))
    return result


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict:
    return _merged("SQL")
