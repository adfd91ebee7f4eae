"""A name for an intermediate value inside one expression, so that it isn't repeated wherever it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once and written once in the plan."""
    return F.transform(F.array(value), lambda x: use(x))[0]
