"""Vectorized functions that are built when first used, since types need a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorized(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like ``pandas_udf``, but for use in modules that are imported before a session exists."""

    def make(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(returns)(f)(*columns)

        return call

    return make


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once (a lambda's argument is never inlined again)."""
    return F.element_at(F.transform(F.array(value), body), 1)
