"""Evaluate costly expressions once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ONCE = "__once"  # the row between the projection and the generator


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add or replace columns behind a one-row generator.

    A filter on a plain computed column is pushed below its projection, which
    copies the whole expression into the filter, once per reference. The
    generator output is an attribute, so later filters and projections refer to
    the value instead of repeating the parsing. The row is made by a projection
    below the generator, because generators interpret their expressions where
    projections compile them.
    """
    kept = [F.col(f"`{name}`") for name in df.columns if name not in columns]
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*kept, row.alias(ONCE)).select(*kept, F.inline(F.array(ONCE)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also inside lambdas of array functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
