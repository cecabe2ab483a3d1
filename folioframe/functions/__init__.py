"""Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's body would compute it for every element it is used for."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
