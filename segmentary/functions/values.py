"""Values named within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once. Unlike a generator this keeps the order of the rows, so that they aren't sorted again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
