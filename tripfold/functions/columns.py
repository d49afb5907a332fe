"""Columns given themselves or by name, and values that are used more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it. Plain expressions are repeated wherever they
    are used, and within a lambda nothing recognises them as the same."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
