"""Name an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row.

    Inside higher-order functions Spark does not share common subexpressions; a one-element array
    carries the value instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
