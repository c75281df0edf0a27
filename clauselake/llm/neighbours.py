"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` vectors of least id hash) and every vector is assigned to a leaf.
A query pops nodes off a priority queue, nearest centre first, until it has met ``visits`` leaves. That number is
calibrated: up to ``CALIBRATION`` queries are answered by brute force over all vectors, and leaf visits widen until the
wanted share of their true neighbours lies in visited leaves, and a query goes on until its leaves hold ``k`` others.
Neighbouring leaves form ``SHARDS`` shards; a query is sent once to each shard that it enters, with the leaves it
visits there. Shards with many vectors or many queries are cut into chunks, so a vector that makes up a third of the
table is spread like any other.

Scores are inner products in double precision on the original vectors, summed the same way for every row, so equal
vectors tie exactly and ties go to the smaller id.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows with a
null id or of another length than most; of rows that share an id the least vector counts, so repeated rows count once;
fewer candidates than ``k`` give all of them; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauselake.llm.common import gathered, runs_of, stored

SAMPLE = 16_384
CALIBRATION = 256
LEAF_SAMPLE = 32
BRANCHES = 8
SHARDS, CHUNK = 32, 8192
QUERY_RECALL, QUERY_SHARE = 0.8, 0.95
VECTOR = "id bigint, vector array<double>"
HITS = "query_id bigint, vec_id bigint, score double, leaf int"


def matrix(table: pa.Table | pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class Tree:
    """``centres[node]`` and ``children[node]``; a child below zero is the leaf ``-1 - child``."""

    def __init__(self, sample: np.ndarray, seed: int):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self._draws = np.random.default_rng(seed)
        self._grow(sample)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, points: np.ndarray) -> int:
        distinct = np.unique(points, axis=0)
        if len(points) <= LEAF_SAMPLE or len(distinct) < BRANCHES:
            return self._leaf()
        centres = distinct[self._draws.choice(len(distinct), BRANCHES, replace=False)]
        for _ in range(8):
            nearest = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
            centres = np.stack([points[nearest == c].mean(axis=0) if (nearest == c).any() else centres[c] for c in range(BRANCHES)])
        nearest = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
        node = len(self.centres)
        self.centres.append(centres)
        self.children.append([])
        for c in range(BRANCHES):
            own = points[nearest == c]
            child = self._leaf() if len(own) == len(points) else self._grow(own)
            self.children[node].append(child)
        return node

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at = np.zeros(len(points), dtype=np.int64) if self.centres else np.full(len(points), -1)
        while (at >= 0).any():
            for node in np.unique(at[at >= 0]):
                own = np.flatnonzero(at == node)
                centres = self.centres[node]
                nearest = np.argmin((centres**2).sum(1) - 2 * points[own] @ centres.T, axis=1)
                at[own] = np.array(self.children[node])[nearest]
        return -1 - at

    def order(self, query: np.ndarray, visits: int, counts: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first ``visits`` leaves, best bin first, and as many more as hold ``least`` vectors together by ``counts``."""
        queue, found, held = [(0.0, 0 if self.centres else -1)], [], 0
        while queue and (len(found) < visits or held < least):
            _, node = heapq.heappop(queue)
            if node < 0:
                found.append(-1 - node)
                held += int(counts[-1 - node]) if counts is not None else 0
                continue
            for product, child in zip((self.centres[node] @ query).tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (-product, child))
        return found


def chosen(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the k best points of a block of ``rough`` products (-inf: no candidate): rows, columns, exact scores."""
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    near = np.isfinite(rough)
    if len(ids) > k:
        floor = -np.partition(-rough, k - 1, axis=1)[:, k - 1 : k]
        slack = 1e-9 * (1 + np.abs(floor, where=np.isfinite(floor), out=np.zeros_like(floor)))
        near &= rough >= floor - slack
    rows, columns, scores = [], [], []
    for q in range(len(queries)):
        own = np.flatnonzero(near[q])
        exact = np.einsum("ij,j->i", points[own], queries[q])
        first = np.lexsort((ids[own], -exact))[:k]
        rows.append(np.full(len(first), q))
        columns.append(own[first])
        scores.append(exact[first])
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (rows, columns, scores))


def query_blocks(queries: int, points: int) -> Iterator[tuple[int, int]]:
    """Bounds of blocks of queries whose products with all points take some 16 MB."""
    step = max(1, (1 << 21) // max(1, points))
    for begin in range(0, queries, step):
        yield begin, min(begin + step, queries)


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the k best of all points: row of the query, row of the point, exact score."""
    found = []
    for begin, end in query_blocks(len(queries), len(ids)):
        rows, columns, scores = chosen(query_ids[begin:end], queries[begin:end], ids, points, queries[begin:end] @ points.T, k)
        found.append((rows + begin, columns, scores))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def best_in_leaves(
    query_ids: np.ndarray, queries: np.ndarray, wanted: list[np.ndarray], ids: np.ndarray, points: np.ndarray, leaves: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``best``, each query among the points of the leaves that it visits. Points are sorted by leaf."""
    begins, ends = runs_of(leaves)
    visited = np.zeros((len(queries), len(begins)), dtype=bool)
    for q, own in enumerate(wanted):
        visited[q] = np.isin(leaves[begins], own)
    found = []
    for begin, end in query_blocks(len(queries), len(ids)):
        rough = np.full((end - begin, len(ids)), -np.inf)
        for leaf, (first, last) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
            rows = np.flatnonzero(visited[begin:end, leaf])
            if len(rows):
                rough[rows, first:last] = queries[begin + rows] @ points[first:last].T
        rows, columns, scores = chosen(query_ids[begin:end], queries[begin:end], ids, points, rough, k)
        found.append((rows + begin, columns, scores))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """``(id, vector)`` of the rows that take part, and their length."""
    vector = F.col(vector_column).cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), vector.alias("vector")).filter(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 0
    rows = rows.filter(F.size("vector") == dim).groupBy("id").agg(F.min("vector").alias("vector"))
    return rows, dim


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, recall: float = 0.95, seed: int = 3,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best of each row whose id is divisible by ``every``."""
    rows, dim = usable(vectors, id_column, vector_column)
    spark = vectors.sparkSession
    if not dim:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = stored(rows, "vectors")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()  # at most SAMPLE vectors
    tree = Tree(np.stack(sample["vector"].to_numpy()), seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            leaf = tree.assign(matrix(table, "vector", dim))
            yield from table.append_column("leaf", pa.array(leaf, pa.int32())).to_batches()

    placed = stored(rows.mapInArrow(assign, VECTOR + ", leaf int"), "leaves")
    counts = np.zeros(tree.leaves, dtype=np.int64)
    for row in placed.groupBy("leaf").count().collect():  # one row per leaf, SAMPLE at most
        counts[row["leaf"]] = row["count"]
    queries = rows.filter(F.col("id") % every == 0)
    visits = calibrated(placed, queries, tree, dim, k, recall)
    shard_of = np.arange(tree.leaves) * SHARDS // tree.leaves if tree.leaves > SHARDS else np.arange(tree.leaves)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query once per shard that it enters, with the leaves that it visits there."""
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                index, shards, lists = [], [], []
                for q, vector in enumerate(matrix(part, "vector", dim)):
                    leaves = np.sort(np.array(tree.order(vector, visits, counts, k + 1)))
                    for first, last in zip(*runs_of(shard_of[leaves]), strict=True):
                        index.append(q)
                        shards.append(shard_of[leaves[first]])
                        lists.append(leaves[first:last])
                table = pa.Table.from_batches([part]).take(pa.array(index, pa.int64()))
                table = table.append_column("shard", pa.array(shards, pa.int32())).append_column("leaves", pa.array(lists, pa.list_(pa.int32())))
                yield from table.to_batches()

    visited = stored(queries.mapInArrow(visit, VECTOR + ", shard int, leaves array<int>"), "visits")
    shard = F.floor(F.col("leaf") * F.lit(SHARDS) / F.lit(tree.leaves)).cast("int") if tree.leaves > SHARDS else F.col("leaf")
    sharded = placed.withColumn("shard", shard)
    sizes = sharded.groupBy("shard").count().withColumnRenamed("count", "points")
    sizes = sizes.join(visited.groupBy("shard").count().withColumnRenamed("count", "queries"), "shard")
    chunks = F.broadcast(sizes.select(  # one row per shard, SHARDS at most
        "shard", F.ceil(F.col("points") / CHUNK).cast("int").alias("point_chunks"), F.ceil(F.col("queries") / CHUNK).cast("int").alias("query_chunks")))

    def dealt(side: DataFrame, own: str, other: str, extra: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(f"{own}_chunks")).cast("int").alias(own)
        theirs = F.explode(F.sequence(F.lit(0), F.col(f"{other}_chunks") - 1)).alias(other)
        return side.join(chunks, "shard").select("id", "vector", "shard", extra, mine, theirs)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty_hits()
        left = left.sort_by("leaf")
        ids, leaves, query_ids = (t.column(c).to_numpy() for t, c in ((left, "id"), (left, "leaf"), (right, "id")))
        wanted = [np.asarray(own) for own in right.column("leaves").to_pylist()]
        row, column, score = best_in_leaves(query_ids, matrix(right, "vector", dim), wanted, ids, matrix(left, "vector", dim), leaves, k)
        return pa.table({"query_id": query_ids[row], "vec_id": ids[column], "score": score, "leaf": pa.array(leaves[column], pa.int32())})

    keys = ["shard", "point", "query"]
    points = dealt(sharded, "point", "query", "leaf").groupBy(*keys)
    hits = points.cogroup(dealt(visited, "query", "point", "leaves").groupBy(*keys)).applyInArrow(compare, HITS)
    return top(hits, k).select("query_id", "rank", "vec_id", "score")


def empty_hits() -> pa.Table:
    return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "leaf": pa.array([], pa.int32())})


def top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def brute_force(placed: DataFrame, ids: np.ndarray, queries: np.ndarray, dim: int, k: int) -> DataFrame:
    """The true neighbours of a bounded set of queries: partial winners of each task, merged."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            own = table.column("id").to_numpy()
            row, column, score = best(ids, queries, own, matrix(table, "vector", dim), k)
            leaf = table.column("leaf").to_numpy()[column]
            yield pa.record_batch({"query_id": ids[row], "vec_id": own[column], "score": score, "leaf": pa.array(leaf, pa.int32())})

    return top(placed.mapInArrow(scan, HITS), k)


def calibrated(placed: DataFrame, queries: DataFrame, tree: Tree, dim: int, k: int, recall: float) -> int:
    """Least number of leaf visits that reaches ``recall`` over the calibration queries and ``QUERY_RECALL`` on most of them."""
    chosen = queries.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION).toPandas()
    if chosen.empty:
        return 1
    ids, points = chosen["id"].to_numpy(), np.stack(chosen["vector"].to_numpy())
    truth = brute_force(placed, ids, points, dim, k).select("query_id", "leaf").toPandas()  # CALIBRATION * k rows at most
    if truth.empty:
        return 1
    place = {}
    for query_id, point in zip(ids.tolist(), points, strict=True):
        for position, leaf in enumerate(tree.order(point, tree.leaves)):
            place[query_id, leaf] = position
    truth["needed"] = [place[q, leaf] + 1 for q, leaf in zip(truth["query_id"].tolist(), truth["leaf"].tolist(), strict=True)]
    pooled = truth["needed"].quantile(recall, interpolation="higher")
    single = truth.groupby("query_id")["needed"].quantile(QUERY_RECALL, interpolation="higher").quantile(QUERY_SHARE, interpolation="higher")
    return int(max(pooled, single))
