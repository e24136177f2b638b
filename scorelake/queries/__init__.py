"""Registered queries, each over whole driver tables, most with a DuckDB oracle."""

from scorelake.queries.registry import ORACLES, QUERIES

# importing a module registers its queries
from scorelake.queries import (  # noqa: E402,F401  isort:skip
    bins,
    captions,
    evaluation,
    files,
    jobs,
    plans,
    scores,
    vectors,
)

__all__ = ["ORACLES", "QUERIES"]
