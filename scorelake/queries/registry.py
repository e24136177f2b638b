"""Query registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scorelake.queries.fixtures import oracle as render

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register the function under its own name; `oracle` is DuckDB SQL over tables and views."""

    def register(fn):
        if fn.__name__ in QUERIES:
            raise ValueError(f"query {fn.__name__} registered twice")
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = render(oracle)
        return fn

    return register
