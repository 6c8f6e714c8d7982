"""Where plans register: query(name, sql) marks a function of loaded views as the query `name`."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """The decorated function's parameters name the views that it gets; `spark` is the session."""

    def register(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        wanted = list(inspect.signature(make).parameters)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(*(spark if p == "spark" else fixtures.load(spark, sf_dir, f"f_{p}") for p in wanted))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = fixtures.oracle(" ".join(sql.split()))
        return make

    return register
