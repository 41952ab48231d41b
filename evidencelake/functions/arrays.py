"""Array columns taken apart in one pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut_at(items: Column, starts: Column) -> Column:
    """Cut an array at the given zero-based starts."""
    ends = F.array_append(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.size(items))
    return F.transform(
        starts, lambda s, i: F.slice(items, s + 1, F.element_at(ends, (i + 1).cast("int")) - s)
    )


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)
