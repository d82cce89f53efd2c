"""Costly array expressions that are computed once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    Exploding a one-element array keeps Catalyst from copying a costly expression into the
    filters and lambdas that use it. It is a narrow step.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def held(array: Column, result: Column) -> Column:
    """``result`` where ``array`` is present.

    Naming the array a second time keeps Catalyst from inlining its definition into a lambda of
    ``result``, which would compute it once per element.
    """
    return F.when(F.size(array) >= 0, result)


def once(value: Column, result: Callable[[Column], Column]) -> Column:
    """``result`` of a value that is computed once, also inside of a lambda, where naming it twice would compute it twice."""
    return F.get(F.transform(F.array(value), result), F.lit(0))
