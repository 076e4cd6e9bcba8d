"""Every query by name, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from docfoundry.sources.fixtures import fixture, with_fixtures

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables and fixtures of one folder, as attributes."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str):
        return fixture(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register a function of Tables as a query; `uses` names the fixtures that its SQL reads."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_fixtures(tuple(uses.split()), sql)
        return f

    return add
