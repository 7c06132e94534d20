"""Query name to builder (spark, sf_dir) -> DataFrame, and to the equivalent SQL."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers the builder under its own name, with SQL that gives the same rows."""

    def add(build):
        if build.__name__ in QUERIES:
            raise ValueError(f"two queries named {build.__name__}")
        QUERIES[build.__name__] = build
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return add


for _name in ("audit", "keying", "relating", "structuring", "markup", "mapping", "stateful", "service", "texts", "working"):
    import_module(f".{_name}", __package__)
