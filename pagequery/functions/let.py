"""A value that an expression uses more than once, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """A column of the row at hand: let() puts it where it is used, so the expression stays in generated code."""
    c = F.col(name)
    c._is_column = True
    return c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    if "_is_column" in vars(value):
        return body(value)
    return F.get(F.transform(F.array(value), body), F.lit(0))
