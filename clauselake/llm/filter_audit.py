"""Audit of how filters interact: which filter removes what under every order of application, by decision diagrams.

Five filters judge a whole document; a document's failures form a mask. Masks are counted per part, and each part's
counts become a decision diagram: a level per filter, a passing and a failing branch per node, counts at the leaves.
Equal subdiagrams are one node and empty ones none. All orders of the filters are visited by adjacent level swaps, one
swap per order. In each order the path on which everything passes gives the steps: the failing branch that leaves it
holds what the filter removes there, the passing branch what is kept.

Whether a text was seen before is decided by counts alone: rows are counted per document and text, then per text and
part, and only the least document of a text passes. No text and no group of copies is gathered; a text that makes up a
third of the rows is reduced in every task before it is exchanged.

Defined results: a null text is empty, a null source the empty string; a row with a null doc_id has no smaller
document, so it never counts as a copy, and it has no labels; repeated rows count one by one, and rows that share the
least doc_id of a text all pass; a document is good (toxic) if any of its label rows says 1; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MEASURES = ("rows", "good", "toxic")
STEPS = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)
NOTHING = (0, 0, 0)


def failures(text: Column) -> Column:
    """Bits 1, 2, 4, 8 of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))
    points = F.char_length(text).cast("long")
    capitals = points - F.char_length(F.translate(text, UPPER, ""))

    def bits(counted: Column) -> Column:
        fails = [
            counted["n"] < LEAST_WORDS,
            100 * counted["distinct"] < DISTINCT_PERCENT * counted["n"],
            100 * capitals > CAPITAL_PERCENT * points,
            text.rlike(r"[#$%&*|]"),
        ]
        return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0))

    return F.get(F.transform(sizes, bits), F.lit(0)).cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, rows, good, toxic)``: documents per part and set of failed filters."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    judged = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("digest"),
        failures(text).alias("mask"),
    )
    keys = ["doc_id", "part", "digest", "mask"]
    per_document = judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # Rows without id meet no label; their digest spreads them over the join's partitions.
    per_document = per_document.withColumn("spread", F.when(F.col("doc_id").isNull(), F.col("digest")).otherwise(""))
    known = known.withColumn("spread_of_id", F.lit(""))
    matched = per_document.join(known, (F.col("doc_id") == F.col("id")) & (F.col("spread") == F.col("spread_of_id")), "left")
    per_text = matched.groupBy(
        "digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
    ).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    # One row per text, part and label kind: copies of a text are a few rows here, however many they are.
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    split = per_text.withColumn("passing", passing).select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(F.col("mask"), F.col("passing").alias("n")),
            F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))))
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def plain_changes(n: int) -> Iterator[int]:
    """Left places of the ``n! - 1`` adjacent swaps that lead through all orders of ``n`` items."""
    if n < 2:
        return
    others = list(plain_changes(n - 1))
    for turn in range(factorial(n - 1)):
        yield from range(n - 2, -1, -1) if turn % 2 == 0 else range(n - 1)
        if turn < len(others):
            yield others[turn] + (1 if turn % 2 == 0 else 0)


class Diagram:
    """A count-weighted decision diagram over the filters, every path from the root naming a mask.

    ``branches[node]`` are its passing and failing child, ``weights[node]`` the sum of the leaves below. Node 0 is
    empty; nodes with the same children are one.
    """

    def __init__(self, counts: dict[int, tuple[int, int, int]], filters: int = len(FILTERS)):
        self.order = list(range(filters))
        self.branches: list[tuple[int, int]] = [(0, 0)]
        self.weights: list[tuple[int, int, int]] = [NOTHING]
        self._known: dict[tuple, int] = {}
        self.root = self._grow(counts, 0, 0)

    def _grow(self, counts: dict[int, tuple[int, int, int]], depth: int, mask: int) -> int:
        if depth == len(self.order):
            return self._leaf(counts.get(mask, NOTHING))
        return self._node(self._grow(counts, depth + 1, mask), self._grow(counts, depth + 1, mask | 1 << depth))

    def _leaf(self, weight: tuple[int, int, int]) -> int:
        return 0 if weight == NOTHING else self._found(("leaf", weight), (0, 0), weight)

    def _node(self, passed: int, failed: int) -> int:
        if not passed and not failed:
            return 0
        weight = tuple(a + b for a, b in zip(self.weights[passed], self.weights[failed], strict=True))
        return self._found((passed, failed), (passed, failed), weight)

    def _found(self, key: tuple, branches: tuple[int, int], weight: tuple) -> int:
        if key not in self._known:
            self._known[key] = len(self.branches)
            self.branches.append(branches)
            self.weights.append(weight)
        return self._known[key]

    def swap(self, level: int) -> None:
        """Exchange the filters of two neighbouring levels; only nodes at and above them are made anew."""
        self.root = self._swapped(self.root, level, {})
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def _swapped(self, node: int, depth: int, done: dict[int, int]) -> int:
        if node and node not in done:
            passed, failed = self.branches[node]
            if depth:
                done[node] = self._node(self._swapped(passed, depth - 1, done), self._swapped(failed, depth - 1, done))
            else:
                both, second = self.branches[passed]
                first, neither = self.branches[failed]
                done[node] = self._node(self._node(both, first), self._node(second, neither))
        return done.get(node, 0)

    def steps(self) -> list[tuple[int, tuple, tuple]]:
        """Filter, what is kept and what is removed, along the path on which everything passes."""
        node, found = self.root, []
        for number in self.order:
            passed, failed = self.branches[node]
            found.append((number, self.weights[passed], self.weights[failed]))
            node = passed
        return found


def audit_part(counts: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """Steps of all orders of one part, from ``filter_order`` to ``shapley``."""
    diagram = Diagram(counts)
    walks = [(tuple(diagram.order), diagram.steps())]
    for level in plain_changes(len(FILTERS)):
        diagram.swap(level)
        walks.append((tuple(diagram.order), diagram.steps()))
    total, alone, summed = [0] * len(FILTERS), [0] * len(FILTERS), [0] * len(FILTERS)
    for _, walk in walks:
        for place, (number, _, lost) in enumerate(walk):
            summed[number] += lost[0]
            if place == 0:
                total[number] = lost[0]  # asked first, a filter removes all that fail it
            if place == len(walk) - 1:
                alone[number] = lost[0]  # asked last, only what no other filter removes
    return [
        ("".join(FILTERS[i] for i in order), place, kept[0], lost[0], total[number] - lost[0], alone[number], lost[1], lost[2], summed[number])
        for order, walk in walks
        for place, (number, kept, lost) in enumerate(walk, start=1)
    ]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, see ``STEPS``."""
    counted = mask_counts(docs, labels)
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("counts"))  # 32 masks at most

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = {c["mask"]: tuple(c[m] for m in MEASURES) for c in row["counts"]}
                columns = [list(column) for column in zip(*audit_part(counts), strict=True)]
                names = ["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
                out = pa.table({"part": [row["part"]] * len(columns[0]), **dict(zip(names, columns, strict=True))})
                yield from out.set_column(2, "step", out.column("step").cast(pa.int32())).to_batches()

    return parts.mapInArrow(steps, STEPS)
