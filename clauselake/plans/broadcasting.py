"""Broadcast a side only when its size is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 10_000


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is.

    For small parameter tables (weights, prices). The check reads one row more
    than the bound at most. A larger table is joined by a shuffle, where the
    adaptive skew handling applies.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
