"""Full ranks over groups of any size, as one lazy plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_by_levels(df: DataFrame, keys: list[str], levels: list[Column], order: list[Column], out: str) -> DataFrame:
    """1-based position of every row in its group, from histograms of nested ranges and their prefix sums.

    ``levels`` cut a group into ranges, each level inside the one before, that
    follow one another in the wanted order; ``order`` sorts the rows of one
    range of the last level and must be total there. Positions are the rows of
    all earlier ranges plus a row number inside the range. Ranges are counted
    by partial aggregates; a sum runs over the ranges of one parent only, so
    with bounded fan-out no task holds a group, however large it is. Nothing is
    run, stored or sampled here, and ``df`` should hold no more columns than
    the rank needs: join the rest to the result. Nulls group and sort as values
    of their own, first.
    """
    names = [f"__level{i}" for i in range(len(levels))]
    # Inside structs nulls are equal, so joins and windows agree on the partitioning.
    placed = df.withColumns({"__group": F.struct(*keys), **{n: F.struct(level.alias("v")) for n, level in zip(names, levels)}})
    counts = placed.groupBy("__group", *names).agg(F.count(F.lit(1)).alias("__rows"))
    offsets = counts.drop("__rows")
    for depth in range(len(levels)):
        parents, ranges = ["__group", *names[:depth]], ["__group", *names[: depth + 1]]
        sums = counts if depth == len(levels) - 1 else counts.groupBy(*ranges).agg(F.sum("__rows").alias("__rows"))
        earlier = Window.partitionBy(*parents).orderBy(names[depth]).rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select(*ranges, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias(f"__before{depth}"))
        offsets = offsets.join(before, ranges)
    ranges = ["__group", *names]
    offset = reduce(lambda a, b: a + b, [F.col(f"__before{i}") for i in range(len(levels))])
    inside = F.row_number().over(Window.partitionBy(*ranges).orderBy(*order))
    ranked = placed.withColumn("__inside", inside).join(offsets.select(*ranges, offset.alias("__offset")), ranges)
    return ranked.withColumn(out, (F.col("__offset") + F.col("__inside")).cast("bigint")).select(*df.columns, out)


def integer_levels(position: Column, width: int = 1 << 13) -> list[Column]:
    """Two nested levels for an integer sort key: ranges of ``width**2`` and of ``width`` values."""
    return [F.floor(position / (width * width)), F.floor(position / width)]
