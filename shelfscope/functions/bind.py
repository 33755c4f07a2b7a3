"""Evaluate a column once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once.

    Inside conditions Spark evaluates a repeated expression each time it occurs, which
    matters for regular expressions and page look-ups.
    """
    return F.get(F.transform(F.array(value), use), 0)
