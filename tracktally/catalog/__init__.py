"""Registered queries over the test tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Catalog:
    def __init__(self) -> None:
        self.items: list[Query] = []

    def add(self, sql: str | None = None):
        def register(fn):
            self.items.append(Query(fn.__name__, fn, sql))
            return fn

        return register


def all_queries() -> list[Query]:
    from tracktally.catalog import explore, fits, modelling, posterior, spatial, wrangle

    found: list[Query] = []
    for module in (explore, wrangle, spatial, modelling, posterior, fits):
        found += module.catalog.items
    return found
