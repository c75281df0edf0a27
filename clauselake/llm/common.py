"""Helpers that the operators share: stored stages, groups of documents, Arrow slices, packed arrays."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.session import ensure_checkpoint_dir

SLICE_BYTES = 4 << 20
GROUP_BYTES = 8 << 20


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: later jobs neither repeat it nor lose it."""
    folder = stage_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


ID_BITS = 24  # 2**24 bits in blocks of 4 KB: at most 2 MB, whatever the number of ids


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` joined with ``ids``, a row per ``doc_id``, by a shuffle of those texts that can match.

    A bitmap of the hashed ids, at most 512 rows, is broadcast and holds back the other texts; a false match falls out
    in the join. The join is an inner one, since Spark moves a semi-join below the bitmap.
    """
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << ID_BITS))
    held = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    marked = docs.withColumn("__p", place).withColumn("__bucket", F.bitmap_bucket_number("__p")).join(F.broadcast(held), "__bucket")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(bitmap_bit_position(__p) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    likely = marked.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(__p) % 8 as int))")) != 0)
    return likely.select(*docs.columns).join(ids.hint("merge"), "doc_id")


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: one number, from a scan of the text column."""
    return int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)


def shares(total: float, each: float) -> int:
    """Number of groups, growing with the data, that keeps a group near ``each``."""
    return max(1, math.ceil(total / each))


def with_group(docs: DataFrame, groups: int) -> DataFrame:
    """``(doc_id, text, grp)``; equal rows share a group, rows without id are spread by their text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("grp"),
    )


def carried(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, the other columns under names that no operator uses."""
    rest = [name for name in docs.columns if name not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *[F.col(f"`{name}`").alias(f"__carried_{i}") for i, name in enumerate(rest)])


def restored_name(docs: DataFrame, column: str) -> str:
    """The name under which ``carried`` keeps a column."""
    return f"__carried_{[n for n in docs.columns if n not in ('doc_id', 'text')].index(column)}"


def restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, ``text`` as it is now."""
    rest = [name for name in docs.columns if name not in ("doc_id", "text")]
    names = {name: f"__carried_{i}" for i, name in enumerate(rest)}
    return df.select(*[F.col(names.get(name, name)).alias(name) for name in docs.columns])


class Slice:
    """Texts of some rows as one byte array; ``offsets`` has a bound more than rows. Null texts are empty."""

    def __init__(self, table: pa.Table | pa.RecordBatch):
        column = table.column("text")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        column = column.cast(pa.large_binary())
        buffers = column.buffers()
        bounds = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(buffers[2] or b"", dtype=np.uint8)
        if len(column) == 0:
            bounds = np.zeros(1, dtype=np.int64)
        self.data = data[bounds[0] : bounds[-1]]
        self.offsets = bounds - bounds[0]
        if column.null_count:  # a null row may own bytes in its buffer; those are not text
            filled = [b"" if v is None else v for v in column.to_pylist()]
            self.data = np.frombuffer(b"".join(filled), dtype=np.uint8)
            self.offsets = np.concatenate([[0], np.cumsum([len(v) for v in filled])]).astype(np.int64)
        self.table = table
        self.rows = len(self.offsets) - 1

    def column(self, name: str, null: int = -1) -> np.ndarray:
        values = self.table.column(name)
        return values.fill_null(null).to_numpy() if isinstance(values, pa.ChunkedArray) else values.fill_null(null).to_numpy(zero_copy_only=False)

    def valid(self, name: str) -> np.ndarray:
        values = self.table.column(name).is_valid()
        return values.to_numpy() if isinstance(values, pa.ChunkedArray) else values.to_numpy(zero_copy_only=False)

    def bytes(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def slices(batches: Iterator[pa.RecordBatch] | pa.Table, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Runs of rows with texts of about ``limit`` bytes together; a longer text is a slice of its own."""
    for batch in batches.to_batches() if isinstance(batches, pa.Table) else batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column("text").cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            yield Slice(batch.slice(begin, end - begin))


def gathered(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Small Arrow batches joined up to about ``limit`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed value."""
    parts = [np.array([len(arrays)], dtype=np.int64).tobytes()]
    for array in arrays:
        parts.append(np.array([ord(array.dtype.char), len(array)], dtype=np.int64).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*parts, *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    heads = np.frombuffer(raw, np.int64, 2 * count, 8).reshape(count, 2)
    at, arrays = 8 + 16 * count, []
    for kind, length in heads.tolist():
        dtype = np.dtype(chr(kind))
        arrays.append(np.frombuffer(raw, dtype, length, at))
        at += length * dtype.itemsize
    return arrays


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of equal values in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return begin, np.concatenate([begin[1:], [len(keys)]])
