"""Mixing sources to target weights by the cube method (balanced sampling).

Every document of a source is taken ``floor(r)`` whole times, r being target over size of its source, and once more
with the remaining fraction as its inclusion probability. The flight phase moves the probabilities of three documents
at a time along the null space of two constraints, the number of documents and the number of words, until one of the
three is 0 or 1. It runs in chunks of bounded size; the at most two undecided documents of each chunk meet again in the
next level, until one chunk per source is left. There the last two documents of the flight are landed by dropping first
the word and then the document constraint, and a small reserve of documents of at most average size is fitted to the
words still wanted, so a source's words miss their target by less than a document.

Defined results: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own, last in
order; a source whose size is 0 has target 0; repeated rows are documents of their own, numbered so that they spread over
the chunks; an empty table gives no rows; extra columns are ignored by ``mix_sources`` and kept by ``mixed_documents``.
Draws depend on seed, source, chunk and level alone, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauselake.llm.common import stored

CHUNK_ROWS = 4096
COPY_RUN = 4096
NEAR = 1e-9
LANDING = 20
SIZE_PATTERN = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, ceiling: float) -> DataFrame:
    """One row per source: rank, size, number of documents and target.

    Water filling: sources in order of ``ceiling * size / weight`` stop at their ceiling while the level, what is left
    per remaining weight, is above it. The windows run over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    listed = listed.withColumn("weight", weight).withColumn("stop", F.col("source_size") * ceiling / F.col("weight"))
    filled = Window.orderBy("stop", "rank")
    rest = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * share - F.coalesce(F.sum(F.col("source_size") * ceiling).over(before), F.lit(0.0))
    ) / F.sum("weight").over(rest)
    listed = listed.withColumn("level", level).withColumn("capped", F.col("level") >= F.col("stop"))
    # Once a source stays below its ceiling, so do all later ones, and its level is theirs.
    final = F.min(F.when(~F.col("capped"), F.struct("stop", "rank", "level"))).over(everything)["level"]
    return listed.select(
        "source", "rank", "source_size", "source_rows",
        F.when(F.col("capped"), F.col("source_size") * ceiling).otherwise(final * F.col("weight")).cast("double").alias("target"),
    )


def flight(sizes: list[float], chances: list[float], draws: np.random.Generator, land: bool) -> list[float]:
    """Move inclusion chances until at most two are undecided; ``land`` decides all.

    For the landing, documents of at most average size are held back until they outweigh the largest one a few times.
    The flight decides the others and the landing fits the reserve to the words that are then still wanted.
    """
    chances = [round(p) if p <= NEAR or p >= 1 - NEAR else p for p in chances]
    waiting = [i for i, p in enumerate(chances) if 0 < p < 1]
    reserve = _reserve(sizes, waiting, draws) if land else []
    kept_back = set(reserve)
    waiting = [i for i in reversed(waiting) if i not in kept_back]
    wanted = sum(chances[i] * sizes[i] for i in [*waiting, *reserve])
    moved = list(waiting)
    held: list[int] = []
    uniform = iter(draws.random(2 * len(waiting) + 8).tolist())
    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) == 3:
            a, b, c = (sizes[i] for i in held)
            move = (c - b, a - c, b - a)
            if not any(move):
                move = (1.0, -1.0, 0.0)
        elif not land or not held:
            break
        else:
            move = (1.0, -1.0)[: len(held)]
        up, down = np.inf, np.inf
        for i, m in zip(held, move, strict=True):
            if m:
                p = chances[i]
                up = min(up, (1 - p) / m if m > 0 else p / -m)
                down = min(down, p / m if m > 0 else (1 - p) / -m)
        step = up if next(uniform) * (up + down) < down else -down
        for i, m in zip(held, move, strict=True):
            p = chances[i] + step * m
            chances[i] = 0.0 if p <= NEAR else 1.0 if p >= 1 - NEAR else p
        held = [i for i in held if 0.0 < chances[i] < 1.0]
    if land:
        _land(sizes, chances, reserve, wanted - sum(chances[i] * sizes[i] for i in moved), draws)
    return chances


def _reserve(sizes: list[float], waiting: list[int], draws: np.random.Generator) -> list[int]:
    if not waiting:
        return []
    mean, largest = sum(sizes[i] for i in waiting) / len(waiting), max(sizes[i] for i in waiting)
    reserve, total = [], 0.0
    for i in draws.permutation([i for i in waiting if sizes[i] <= mean]).tolist():
        if total >= 4 * largest:
            break
        reserve.append(i)
        total += sizes[i]
    return reserve


def _land(sizes: list[float], chances: list[float], reserve: list[int], wanted: float, draws: np.random.Generator) -> None:
    """Draw the reserve with the chance that fits what is still wanted; fit the last few, largest first."""
    last = min(len(reserve), LANDING)
    for place, i in enumerate(reserve[: len(reserve) - last]):
        left = sum(sizes[j] for j in reserve[place:])
        chances[i] = float(draws.random() * left < wanted)
        wanted -= chances[i] * sizes[i]
    for i in sorted(reserve[len(reserve) - last :], key=lambda i: (-sizes[i], i)):
        chances[i] = float(wanted > sizes[i] / 2)
        wanted -= chances[i] * sizes[i]


def _numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``copy``, the number of a row among its equals: counted, then written out in runs of ``COPY_RUN``."""
    counted = sizes.groupBy(*sizes.columns).agg(F.count(F.lit(1)).alias("rows"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / COPY_RUN))))
    first, last = F.col("run") * COPY_RUN, F.least(F.col("rows"), (F.col("run") + 1) * COPY_RUN) - 1
    return runs.select(*sizes.columns, F.explode(F.sequence(first, last)).alias("copy"))


def _added_name(name: str, taken: list[str]) -> str:
    """``name``, with ``mix_`` before it as often as it takes to differ from the names in ``taken``."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"mix_{name}"
    return name


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: int = 7,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``(doc_id, source, row_hash, size, source_size, target, times, taken)``, one row per document.

    ``times`` says how often the mix takes the document, ``taken`` how many words that is. ``row_hash`` identifies the
    row together with doc_id for a join back to the text.
    """
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64("doc_id", "text").alias("row_hash"),
        F.coalesce(F.regexp_count("text", F.lit(SIZE_PATTERN)), F.lit(0)).cast("long").alias("size"),
    )
    sizes = stored(_numbered(sizes), "mix-sizes")
    targets = stored(source_targets(sizes, weights, share, ceiling).coalesce(1), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(ceiling))).otherwise(0.0)
    units = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    units = units.select(
        "doc_id", "source", "row_hash", "copy", "size", "rank", "source_size", "target",
        F.floor(ratio + NEAR).cast("long").alias("whole"),
        F.ceil(F.col("source_rows") / chunk_rows).cast("long").alias("chunks"),
        (ratio - F.floor(ratio + NEAR)).alias("chance"),
    )
    shape = units.schema
    most = targets.agg(F.max(F.ceil(F.col("source_rows") / chunk_rows))).first()[0] or 1

    def fly(level: int):
        def run(key, unit: pd.DataFrame) -> pd.DataFrame:
            unit = unit.sort_values(["doc_id", "size", "row_hash", "copy"], kind="stable", na_position="last").reset_index(drop=True)
            draws = np.random.default_rng([seed, level, int(key[0]), int(key[1])])
            last = int(unit["chunks"].iloc[0]) == 1
            unit["chance"] = flight(unit["size"].astype(float).tolist(), unit["chance"].tolist(), draws, last)
            unit["doc_id"] = unit["doc_id"].astype("Int64")
            unit["chunks"] = -(-2 * unit["chunks"] // chunk_rows)
            return unit[shape.names]

        return run

    decided, level, open_units = [], 0, units
    while True:
        chunk = F.pmod(F.xxhash64("doc_id", "row_hash", "copy", F.lit(level)), "chunks")
        flown = open_units.withColumn("chunk", chunk).groupBy("rank", "chunk")
        flown = stored(flown.applyInPandas(fly(level), shape), f"mix-level{level}")
        done = F.col("chance").isin(0.0, 1.0)
        decided.append(flown.filter(done))
        if most == 1:
            break
        open_units, most, level = flown.filter(~done), -(-2 * most // chunk_rows), level + 1
    result = decided[0]
    for part in decided[1:]:
        result = result.unionAll(part)
    times = F.col("whole") + F.col("chance").cast("long")
    return result.select(
        "doc_id", "source", "row_hash", "size", "source_size", "target", times.alias("times"),
        (F.col("size") * times).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents that the mix takes, with ``size``, ``source_size``, ``target``, ``times`` and ``taken``.

    Equal rows share the greatest number of times that one of them is taken. An added column whose name ``docs`` has
    already is called ``mix_`` and that name.
    """
    mix = mix_sources(docs, **settings).filter("times > 0")
    mix = mix.groupBy("doc_id", "row_hash", "size", "source_size", "target").agg(F.max("times").alias("times"))
    whole = docs.select(F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("whole"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("doc_id", "text").alias("hash"))
    joined = whole.join(mix, (whole["hash"] == mix["row_hash"]) & whole["id"].eqNullSafe(mix["doc_id"]))
    added = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "times": F.col("times"), "taken": F.col("size") * F.col("times")}
    return joined.select("whole.*", *[value.alias(_added_name(name, docs.columns)) for name, value in added.items()])
