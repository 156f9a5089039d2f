"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    A plain Python variable would copy the expression to every place it is
    used, and branches would compute each copy again.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
