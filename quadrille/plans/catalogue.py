"""Queries of the package by name, and the SQL that gives the same rows. Names begin with the operator's number."""

from __future__ import annotations

from collections.abc import Callable

from .views import duck

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name; without SQL its rows are tested against brute force."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = duck(sql)
        return f

    return add


def queries() -> dict[str, Callable]:
    from . import coordinates, decoding, geometries, images, rasters, relations, stores  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
