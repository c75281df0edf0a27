"""Substring dedup: Rabin-Karp hashes of every window of ``window`` words, counted in Spark.

Words are hashed from the bytes, window hashes are differences of prefix sums, all over whole arrays. Windows are dealt
to buckets by one hash and compared there by another 64-bit hash, so unequal windows meet only where both agree
(about one pair in 2**64 times the number of buckets, which grows with the data). Before the exchange each slice of a
task keeps the first occurrence of a window and reports later ones as removed at once, so that a window that stands in
a third of all documents reaches its bucket once per slice. Buckets keep the first occurrence by (doc_id, start); all
others go back to their documents, where they are merged into maximal removal intervals.

Defined results: a null text has no words; a text shorter than a window keeps everything; rows with a null doc_id are
returned with nothing removed and count for nobody; equal rows get equal results, and other rows that share a doc_id
count as that document, an occurrence being earlier if its start is smaller; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import GROUP_BYTES, gathered, pack, shares, slices, text_bytes, unpack, with_group
from clauselake.llm.tokens import BASES, Words, window_hashes

BUCKET_WINDOWS = 2_000_000
BYTES_PER_WORD = 6
SENT = "kind int, part int, hashes binary, places binary"
REMOVED = "grp int, places binary"
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<start:int,stop:int>>, kept_text string"


def window_rows(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed windows of a task: kind 0 goes to a bucket of hashes, kind 1 (known repeats) to a group of documents."""
    for table in gathered(batches):
        order = np.argsort(table.column("doc_id").fill_null(-1).to_numpy(), kind="stable")
        for part in slices(table.take(pa.array(order)).combine_chunks()):
            yield from _slice_rows(part, window, buckets)


def _slice_rows(part, window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    words = Words(part)
    ids, groups, crcs = part.column("doc_id"), part.column("grp"), part.column("text_hash", 0)
    starts = np.arange(len(words.starts))
    starts = starts[(starts + window <= words.bounds[1:][words.rows]) & part.valid("doc_id")[words.rows]]
    if not len(starts):
        return
    hashes = words.hashes()
    own = window_hashes(hashes, starts, starts + window, BASES[1])
    other = window_hashes(hashes, starts, starts + window, BASES[2])
    bucket = ((other >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    row = words.rows[starts]
    begin = (starts - words.bounds[row]).astype(np.int32)
    order = np.lexsort((begin, ids[row], own))
    first = np.ones(len(order), dtype=bool)
    first[1:] = own[order][1:] != own[order][:-1]
    leader = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    later = (ids[row[order]] > ids[row[leader]]) | (begin[order] > begin[leader])
    repeats, sent = np.sort(order[later]), np.sort(order[~later])
    out = [[], [], [], []]
    for kind, chosen, key in ((0, sent, bucket), (1, repeats, groups[row])):
        chosen = chosen[np.argsort(key[chosen], kind="stable")]
        keys = key[chosen]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for piece in np.split(chosen, cuts) if len(chosen) else []:
            r = row[piece]
            out[0].append(kind)
            out[1].append(int(key[piece[0]]))
            out[2].append(own[piece].tobytes() if kind == 0 else b"")
            out[3].append(packed_places(ids[r], crcs[r], groups[r], begin[piece]))
    yield pa.record_batch([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["kind", "part", "hashes", "places"])


def packed_places(ids: np.ndarray, texts: np.ndarray, groups: np.ndarray, starts: np.ndarray) -> bytes:
    """Occurrences, those of a document side by side; starts as differences."""
    change = np.ones(len(ids), dtype=bool)
    change[1:] = (ids[1:] != ids[:-1]) | (texts[1:] != texts[:-1])
    at = np.flatnonzero(change)
    counts = np.diff(np.append(at, len(ids))).astype(np.int32)
    return pack(ids[at].astype(np.int64), texts[at], groups[at].astype(np.int32), counts, np.diff(starts, prepend=0).astype(np.int32))


def unpacked_places(value: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, texts, groups, counts, steps = unpack(value)
    return np.repeat(ids, counts), np.repeat(texts, counts), np.repeat(groups, counts), np.cumsum(steps, dtype=np.int64)


def removed_rows(table: pa.Table) -> pa.Table:
    """Of one bucket, all occurrences but the first of each window; known repeats pass through."""
    places = table.column("places").to_pylist()
    if table.column("kind")[0].as_py() == 1:
        return pa.table({"grp": table.column("part"), "places": table.column("places")})
    hashes = np.concatenate([np.frombuffer(h, np.uint64) for h in table.column("hashes").to_pylist()])
    ids, texts, groups, starts = (np.concatenate(c) for c in zip(*map(unpacked_places, places), strict=True))
    order = np.lexsort((starts, ids, hashes))
    sorted_hashes = hashes[order]
    first = np.ones(len(order), dtype=bool)
    first[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    leader = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    repeats = order[(ids[order] > ids[leader]) | (starts[order] > starts[leader])]
    return places_by_group(ids[repeats], texts[repeats], groups[repeats], starts[repeats])


def places_by_group(ids: np.ndarray, texts: np.ndarray, groups: np.ndarray, starts: np.ndarray) -> pa.Table:
    order = np.lexsort((starts, texts, ids, groups))
    cuts = np.flatnonzero(np.diff(groups[order])) + 1
    pieces = np.split(order, cuts) if len(order) else []
    return pa.table({
        "grp": pa.array([int(groups[p[0]]) for p in pieces], pa.int32()),
        "places": pa.array([packed_places(ids[p], texts[p], groups[p], starts[p]) for p in pieces], pa.binary()),
    })


def starts_by_document(table: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """(doc_id, text_hash) -> starts, of one group of documents."""
    values = table.column("places").to_pylist()
    if not values:
        return {}
    ids, texts, _, starts = (np.concatenate(c) for c in zip(*map(unpacked_places, values), strict=True))
    order = np.lexsort((starts, texts, ids))
    ids, texts, starts = ids[order], texts[order], starts[order]
    cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(texts) != 0)) + 1
    begins = np.concatenate([[0], cuts]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    return {(int(ids[b]), int(texts[b])): s for b, s in zip(begins, np.split(starts, cuts), strict=True)} if len(ids) else {}


def merged(starts: np.ndarray, width: int) -> np.ndarray:
    """Maximal intervals of the union of ``[start, start + width)`` for sorted starts, as rows (start, stop)."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(np.diff(starts) > width)
    return np.stack([starts[np.concatenate([[0], gap + 1])], starts[np.concatenate([gap, [len(starts) - 1]])] + width], axis=1)


def applied(docs: pa.Table, removed: pa.Table, window: int) -> pa.Table:
    """The documents of one group with their intervals and what is left."""
    known = starts_by_document(removed)
    ids, hashes = docs.column("doc_id").to_pylist(), docs.column("text_hash").to_pylist()
    out = [[], [], [], [], []]
    for doc_id, text_hash, text in zip(ids, hashes, docs.column("text"), strict=True):
        words = (text.as_py() or "").encode().split()
        spans = merged(known.get((doc_id, text_hash), np.zeros(0, np.int64)), window)
        keep = np.ones(len(words), dtype=np.uint8)
        for begin, end in spans.tolist():
            keep[begin:end] = 0
        kept = list(compress(words, keep.tolist())) if len(spans) else words
        for column, value in zip(out, (doc_id, len(words), len(words) - len(kept), [{"start": b, "stop": e} for b, e in spans.tolist()], b" ".join(kept).decode()), strict=True):
            column.append(value)
    shape = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("kept_text", pa.string())])
    return pa.table(dict(zip(shape.names, out, strict=True)), schema=shape)


def remove_repeated_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """``(doc_id, n_words, n_removed, removed, kept_text)``, one row per row of ``docs``.

    ``removed`` has the maximal intervals of word positions, ``kept_text`` the other words joined by a space.
    """
    size = text_bytes(docs)
    buckets = shares(size / BYTES_PER_WORD, BUCKET_WINDOWS)
    grouped = with_group(docs, shares(size, GROUP_BYTES)).withColumn("text_hash", F.xxhash64("text"))

    def windows(batches):
        return window_rows(batches, window, buckets)

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        return applied(left, right, window)

    sent = grouped.mapInArrow(windows, SENT)
    removed = sent.groupBy("kind", "part").applyInArrow(removed_rows, REMOVED)
    return grouped.groupBy("grp").cogroup(removed.groupBy("grp")).applyInArrow(join, RESULT)
