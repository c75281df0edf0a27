"""Hard negatives by shared lists: anchors are clustered, and a cluster's members walk one list of candidates.

For a cluster with centre c whose members lie within the angle t of it, no member m has a product with a candidate x above
|m| |x| cos(max(0, angle(x, c) - t)). Candidates are sorted by |x| cos(...) once for the cluster; every member walks
that list, slab by slab, and stops when its last wanted place is held by a score above the bound of all that follow, or
when the bound falls below the least score that counts. Then its result is certified, not estimated.

Two walks are made. The first finds each anchor's positives, the rows of its own label with the highest scores. The
second finds, per positive, the rows of other labels with the highest scores inside the window that its score allows.

Scores are inner products of the integer vectors floor(256 x). Candidates lie in packed blocks of ``BLOCK`` rows by the
hash of their id, anchors in packed groups of up to ``GROUP`` near clusters; each group meets each block in a task of
bounded size, and the blocks' winners are merged by a group limit before they are exchanged. The query set is stated
(ids divisible by ``every``); all its members meet all rows, none is left out.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part, nor do rows of
another length than most; of rows that share an id the one of least vector and label counts, so repeated rows count once;
zero vectors take part with score 0; scores are exact while they fit a long; ties go to the smaller id; fewer
candidates than wanted give all of them; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.llm.common import gathered, pack, shares, stored, unpack

BLOCK, LEAST_BLOCKS, GROUP = 32_768, 16, 8192
SAMPLE, CLUSTER_ROWS, CLUSTERS = 4096, 64, 64
SLAB = 1024
EXACT = 1 << 53  # products below are exact in double precision
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
WINNERS = "anchor_id bigint, positive int, score bigint, id bigint"
MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``(id, label, vector)`` with integer components of the rows that take part, and their length."""
    given = F.col("embedding").cast("array<double>")
    sound = F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = F.col("vec_id").cast("long")
    turned = F.when(own % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")).cast("int")
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))).select(
        own.alias("id"), turned.alias("label"), F.transform(given, lambda x: F.floor(x * 256).cast("long")).alias("vector"))
    common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 0
    rows = rows.filter(F.size("vector") == dim).groupBy("id").agg(F.min(F.struct("vector", "label")).alias("row"))
    return rows.select("id", "row.label", "row.vector"), dim


def integers(table: pa.Table | pa.RecordBatch, dim: int) -> np.ndarray:
    column = table.column("vector")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the least type that holds them."""
    most = int(np.abs(values).max()) if values.size else 0
    return values.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products as longs: by floating point where that is exact."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if most < EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    vectors = vectors.astype(np.float64)
    size = np.sqrt((vectors**2).sum(axis=1))
    return vectors / np.where(size > 0, size, 1)[:, None], size


def angles(units: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centre, -1, 1))


class Held:
    """The best ``k`` hits per slot so far: score, then smaller id."""

    def __init__(self, slots: int, k: int):
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.k, self.floor = k, np.full(slots, LOW)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(pair) for pair in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        best = place < self.k
        self.slot, self.score, self.id = slot[best], score[best], ids[best]
        last = place == self.k - 1
        self.floor[slot[last]] = score[last]


def walk(
    members: np.ndarray, member_ids: np.ndarray, member_labels: np.ndarray, centre: np.ndarray,
    block: tuple[np.ndarray, np.ndarray, np.ndarray], low: np.ndarray, high: np.ndarray, same: bool, k: int, slab: int = SLAB,
) -> tuple[Held, int]:
    """The best ``k`` candidates per member and window ``[low, high]``, and how many places of the list were visited.

    ``block`` holds ids, labels and vectors; ``low`` and ``high`` have a row per member and a column per window.
    """
    ids, labels, vectors = block
    windows = low.shape[1]
    held = Held(len(members) * windows, k)
    units, size = unit(members)
    candidates, candidate_size = unit(vectors)
    reach = float(angles(units, centre)[size > 0].max(initial=0.0))
    bound = candidate_size * np.cos(np.maximum(0.0, angles(candidates, centre) - reach))
    order = np.argsort(-bound, kind="stable")
    slack = 1e-6 * candidate_size.max(initial=0.0)  # rounding of angles and lengths
    active, visited = np.arange(len(members)), 0
    for begin in range(0, len(order), slab):
        rest = (bound[order[begin]] + slack) * size[active] + 1
        slots = active[:, None] * windows + np.arange(windows)
        active = active[((held.floor[slots] <= rest[:, None]) & (low[active] <= rest[:, None]) & (low[active] <= high[active])).any(axis=1)]
        if not len(active):
            break
        own = order[begin : begin + slab]
        visited += len(own) * len(active)
        found = products(members[active], vectors[own])
        fits = (member_labels[active, None] == labels[None, own]) == same
        fits &= member_ids[active, None] != ids[None, own]
        for w in range(windows):
            slot = active * windows + w
            least = np.maximum(low[active, w], held.floor[slot])
            row, column = np.nonzero(fits & (found >= least[:, None]) & (found <= high[active, w][:, None]))
            held.add(slot[row], found[row, column], ids[own[column]])
    return held, visited


def fitted_centres(anchors: DataFrame, dim: int, seed: int) -> np.ndarray:
    """Directions of the clusters, by k-means on at most ``SAMPLE`` anchors."""
    sample = anchors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    points, _ = unit(integers(sample, dim))
    draws = np.random.default_rng(seed)
    number = int(np.clip(len(points) // CLUSTER_ROWS, 1, CLUSTERS))
    centres = points[draws.choice(len(points), number, replace=False)]
    for _ in range(8):
        nearest = np.argmax(points @ centres.T, axis=1)
        sums = np.stack([points[nearest == c].sum(axis=0) if (nearest == c).any() else centres[c] for c in range(number)])
        centres = unit(sums)[0]
    return centres


def grouping(sizes: dict[int, int], limit: int) -> dict[int, tuple[int, int]]:
    """First group and number of groups of each cluster: neighbours share a group up to ``limit``, large ones are split."""
    found, group, filled = {}, 0, 0
    for cluster, size in sorted(sizes.items()):
        if filled and filled + size > limit:
            group, filled = group + 1, 0
        parts = -(-size // limit)
        found[cluster] = (group, parts)
        group, filled = (group + parts, 0) if parts > 1 else (group, filled + size)
    return found


def packed(rows: DataFrame, key: str, dim: int) -> DataFrame:
    """``(key, packed)``: the rows of each key as one value, their columns in the order of ``rows``."""
    others = [c for c in rows.columns if c not in (key, "vector")]

    def whole(table: pa.Table) -> pa.Table:
        columns = [np.asarray(table.column(c).combine_chunks().flatten() if pa.types.is_list(table.schema.field(c).type) else table.column(c)) for c in others]
        return pa.table({key: table.column(key)[:1], "packed": [pack(*columns, narrow(integers(table, dim)).ravel())]})

    return rows.groupBy(key).applyInArrow(whole, f"{key} int, packed binary")


def meet(groups: DataFrame, blocks: DataFrame, centres: np.ndarray, dim: int, windows: int, same: bool, k: int, numbers: tuple[int, int]) -> DataFrame:
    """Winners of every group of anchors in every block of candidates."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids, labels, clusters, low, high, vectors = unpack(left.column("packed")[0].as_py())
            members, low, high = vectors.reshape(-1, dim), low.reshape(-1, windows), high.reshape(-1, windows)
            block_ids, block_labels, block_vectors = unpack(right.column("packed")[0].as_py())
            block = (block_ids, block_labels, block_vectors.reshape(-1, dim))
            for cluster in np.unique(clusters).tolist():
                every = np.flatnonzero(clusters == cluster)
                for own in np.split(every, range(SLAB, len(every), SLAB)):
                    held, _ = walk(members[own], ids[own], labels[own], centres[cluster], block, low[own], high[own], same, k)
                    for column, values in zip(out, (ids[own][held.slot // windows], held.slot % windows, held.score, held.id), strict=True):
                        column.append(values)
        anchor, window, score, found = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        return pa.table({"anchor_id": anchor, "positive": pa.array(window, pa.int32()), "score": score, "id": found})

    last_group, last_block = numbers[0] - 1, numbers[1] - 1
    left = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last_block))))
    right = blocks.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(last_group))))
    return left.groupBy("grp", "block").cogroup(right.groupBy("grp", "block")).applyInArrow(compare, WINNERS)


def first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def whole_share(score: Column) -> Column:
    """floor(19 score / 20) of a score from zero on, in longs."""
    rest = F.pmod(score, F.lit(20))
    return score - F.floor((score - rest) / 20).cast("long") - F.when(rest > 0, 1).otherwise(0)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, seed: int = 5) -> DataFrame:
    """``MINED`` rows: per anchor and positive the first ``negatives`` rows of other labels within 50 % to 95 % of its score."""
    spark = vectors.sparkSession
    rows, dim = usable(vectors)
    rows = stored(rows, "vectors")
    anchors = rows.filter(F.col("id") % every == 0)
    total = rows.count()
    if not dim or not anchors.limit(1).count():
        return spark.createDataFrame([], MINED)
    centres = fitted_centres(anchors, dim, seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            nearest = np.argmax(unit(integers(table, dim))[0] @ centres.T, axis=1)
            yield from table.append_column("cluster", pa.array(nearest, pa.int32())).to_batches()

    placed = stored(anchors.mapInArrow(assign, "id bigint, label int, vector array<bigint>, cluster int"), "anchors")
    groups = grouping({r["cluster"]: r["count"] for r in placed.groupBy("cluster").count().collect()}, GROUP)  # CLUSTERS rows
    numbers = (max(g + parts for g, parts in groups.values()), max(LEAST_BLOCKS, shares(total, BLOCK)))
    plan = F.create_map(*[F.lit(v) for c, parts in groups.items() for v in (c, list(parts))])
    first_part, parts = (F.element_at(F.element_at(plan, F.col("cluster")), i) for i in (1, 2))
    grp = (first_part + F.pmod(F.xxhash64("id"), parts)).cast("int").alias("grp")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(numbers[1])).cast("int").alias("block")
    blocks = stored(packed(rows.select("id", "label", "vector", block), "block", dim), "blocks")

    open_window = [F.array(F.lit(int(LOW))).alias("low"), F.array(F.lit(int(HIGH))).alias("high")]
    sides = packed(placed.select("id", "label", "cluster", *open_window, "vector", grp), "grp", dim)
    best = stored(first(meet(sides, blocks, centres, dim, 1, True, positives, numbers), ["anchor_id"], positives), "positives")

    # The window of a positive's score; an anchor with fewer positives has empty windows behind them.
    scores = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("found"))  # five at most
    padded = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.get("found", i)["score"])
    low = F.transform(padded, lambda s: F.coalesce(F.when(s >= 0, F.shiftright(s + 1, 1)), F.lit(int(HIGH))))
    high = F.transform(padded, lambda s: F.coalesce(F.when(s >= 0, whole_share(s)), F.lit(int(LOW))))
    windowed = placed.join(scores, placed["id"] == scores["anchor_id"]).select("id", "label", "cluster", low.alias("low"), high.alias("high"), "vector", grp)
    met = meet(packed(windowed, "grp", dim), blocks, centres, dim, positives, False, negatives, numbers)
    chosen = first(met, ["anchor_id", "positive"], negatives)
    named = best.select(F.col("anchor_id").alias("anchor"), (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return chosen.join(named, (F.col("anchor_id") == F.col("anchor")) & (F.col("positive") == F.col("place"))).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
