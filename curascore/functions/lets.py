"""Evaluate a column once and use it several times inside a higher-order expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A projected helper column would be inlined into the lambda by the optimizer and then
    re-evaluated for every array element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
