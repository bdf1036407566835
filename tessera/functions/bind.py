"""Binding of a value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Inside a higher-order function an outer expression would be computed again for each
    element, and an expression used twice is written, and planned, twice.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
