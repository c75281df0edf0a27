"""Top-k per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key with their 1-based rank.

    Catalyst turns the rank filter into a group limit that runs before the
    shuffle, so a task sends at most ``k`` rows of a hot key. When ``k`` is a
    column, its literal ceiling must be applied first by the caller.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
