"""A value that an expression needs more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once: inside a lambda nothing is shared, and a tree that repeats its branches grows with every level."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
