"""Suffix-array dedup of bytes by a distributed merge sort that is aware of common prefixes.

A string of ``width`` bytes has one or more anchors: the positions whose ``GRAM``-byte hash is least within it (all of
them at a tie), so equal strings have equal anchors. Only anchors that stand in two documents can lie in a repeated
string; a first exchange of hashes finds those, and only their suffixes are sorted. A key is the suffix of ``width``
bytes and, behind it, the bytes before the anchor in reverse. Each group of documents sorts its keys into runs, which
are exchanged front-coded (length of the prefix shared with the predecessor, then the rest). A task rebuilds the runs of
its share and combines them by a loser tree that stores, with each loser, the length of the prefix it shares with its
winner: comparisons start behind it and no known prefix is read again. The common prefix lengths of the merged sequence
give the classes of equal strings for each distance between string and anchor, without hashing.

Equal keys of a group of documents travel once; the copies in larger doc_ids are known to be repeats there and then.

Defined results: matches never cross documents; a string is repeated if it also starts in a row of smaller doc_id,
never by its own document or rows with the same doc_id; null texts are empty; rows with a null doc_id are returned whole
and count for nobody; equal rows get equal results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import GROUP_BYTES, Slice, gathered, pack, shares, slices, text_bytes, unpack, with_group
from clauselake.llm.tokens import BASES, mixed, window_hashes
from clauselake.llm.substrings import packed_places, places_by_group, starts_by_document, unpacked_places

GRAM = 20
BYTES_PER_ANCHOR = 16
BUCKET_ANCHORS = 1_000_000
SHARE_BYTES = 24 << 20
SENT = "kind int, part int, hashes binary, places binary"
CANDIDATES = "grp int, places binary"
RUNS = "kind int, part int, payload binary"
REMOVED = "grp int, payload binary"
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, removed array<struct<start:int,stop:int>>, kept binary"


def anchors(part: Slice, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, hashes and rows of the anchors of a slice."""
    size = len(part.data)
    reach = width - gram + 1
    if size < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    place = np.arange(size - gram + 1)
    hashes[: len(place)] = mixed(window_hashes(part.data + np.uint64(1), place, place + gram, BASES[0])) >> np.uint64(1)
    lengths = np.diff(part.offsets)
    left = np.repeat(part.offsets[1:], lengths) - np.arange(size)  # bytes from here to the end of the document
    hashes[left < gram] = np.iinfo(np.uint64).max
    least = hashes.copy()
    span = 1
    while span < reach:
        step = min(span, reach - span)
        np.minimum(least[:-step], least[step:], out=least[:-step])
        span += step
    least[left < width] = 0
    most, span = least, 1
    while span < reach:
        step = min(span, reach - span)
        most[step:] = np.maximum(most[step:], most[:-step])
        span += step
    at = np.flatnonzero((most == hashes) & (left >= gram))
    return at, hashes[at], np.repeat(np.arange(part.rows), lengths)[at]


def anchor_rows(batches: Iterator[pa.RecordBatch], width: int, gram: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchor hashes of a task. Kind 0 goes to a bucket; kind 1 stands in two documents for certain.

    Within a bucket 32 bits are sent: a chance agreement only adds a key to the sort, which compares bytes.
    """
    for table in gathered(batches):
        order = np.argsort(table.column("doc_id").fill_null(-1).to_numpy(), kind="stable")
        for part in slices(table.take(pa.array(order)).combine_chunks()):
            at, hashes, row = anchors(part, width, gram)
            known = part.valid("doc_id")[row]
            at, hashes, row = at[known], hashes[known], row[known]
            ids, groups, texts = part.column("doc_id"), part.column("grp"), part.column("text_hash", 0)
            begin = (at - part.offsets[row]).astype(np.int32)
            order = np.lexsort((begin, row, hashes))
            once = np.ones(len(order), dtype=bool)  # one position for each hash and row
            once[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
            order = order[once]
            first = np.ones(len(order), dtype=bool)
            first[1:] = hashes[order][1:] != hashes[order][:-1]
            leader = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            shared = ids[row[order]] != ids[row[leader]]
            multiple = np.zeros(len(at), dtype=bool)
            multiple[leader[shared]] = True
            sure = shared | (first & multiple[order])
            rows = [[], [], [], []]
            for kind, chosen, key in ((0, np.sort(order[first]), (hashes % np.uint64(buckets)).astype(np.int64)), (1, np.sort(order[sure | (~first & multiple[leader])]), groups[row])):
                chosen = chosen[np.argsort(key[chosen], kind="stable")]
                for piece in np.split(chosen, np.flatnonzero(np.diff(key[chosen])) + 1) if len(chosen) else []:
                    r = row[piece]
                    rows[0].append(kind)
                    rows[1].append(int(key[piece[0]]))
                    rows[2].append((hashes[piece] >> np.uint64(31)).astype(np.uint32).tobytes() if kind == 0 else b"")
                    rows[3].append(packed_places(ids[r], texts[r], groups[r], begin[piece]))
            yield pa.record_batch([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], names=["kind", "part", "hashes", "places"])


def shared_anchors(table: pa.Table) -> pa.Table:
    """Of one bucket, the anchors whose hash stands in two documents."""
    if table.column("kind")[0].as_py() == 1:
        return pa.table({"grp": table.column("part"), "places": table.column("places")})
    hashes = np.concatenate([np.frombuffer(h, np.uint32) for h in table.column("hashes").to_pylist()])
    ids, texts, groups, starts = (np.concatenate(c) for c in zip(*map(unpacked_places, table.column("places").to_pylist()), strict=True))
    order = np.lexsort((ids, hashes))
    change = np.flatnonzero(np.diff(hashes[order])) + 1
    begin, end = np.concatenate([[0], change]), np.concatenate([change, [len(order)]])
    several = ids[order[begin]] != ids[order[end - 1]]
    chosen = order[np.repeat(several, end - begin)]
    return places_by_group(ids[chosen], texts[chosen], groups[chosen], starts[chosen])


def front_coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the prefixes shared with the predecessor, and the remaining bytes, of sorted rows of bytes."""
    differs = np.ones(keys.shape, dtype=bool)
    differs[1:] = keys[1:] != keys[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), keys.shape[1]).astype(np.uint8)
    shared[:1] = 0
    return shared, keys[np.arange(keys.shape[1]) >= shared[:, None]]


def rebuilt(shared: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes from their front coding."""
    keys = np.zeros((len(shared), width), dtype=np.uint8)
    own = np.arange(width) >= shared[:, None]
    keys[own] = rest
    index = np.arange(len(shared))
    for column in range(width):
        keys[:, column] = keys[np.maximum.accumulate(np.where(own[:, column], index, 0)), column]
    return keys


def merge_runs(keys: list[list[bytes]], shared: list[list[int]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs; returns the run of each output and the prefix length that it shares with its predecessor.

    ``lcp[r]`` is what the front of run r shares with the last output. A node holds the loser of its match with the
    prefix length shared with the winner. Exhausted runs have -1 and lose every match.
    """
    leaves = 1
    while leaves < len(keys):
        leaves *= 2
    at, lcp = [0] * leaves, [-1] * leaves
    fronts: list[bytes] = [b""] * leaves
    for r, run in enumerate(keys):
        if run:
            fronts[r], lcp[r] = run[0], 0
    losers = [0] * leaves

    def play(node: int) -> int:
        if node >= leaves:
            return node - leaves
        return match(play(2 * node), play(2 * node + 1), node)

    def match(a: int, b: int, node: int) -> int:
        """The winner of a and b; the loser stays at ``node``."""
        ha, hb = lcp[a], lcp[b]
        if ha > hb:
            losers[node] = b
            return a
        if hb > ha:
            losers[node] = a
            return b
        if ha < 0:
            losers[node] = b
            return a
        x, y = fronts[a], fronts[b]
        size = len(x)
        h = ha
        if x[h:] == y[h:]:
            h = size
        else:
            while x[h] == y[h]:
                h += 1
        if h == size:
            winner, loser = (a, b) if a < b else (b, a)
        else:
            winner, loser = (a, b) if x[h] < y[h] else (b, a)
        lcp[loser] = h
        losers[node] = loser
        return winner

    winner = play(1) if leaves > 1 else 0
    out, lengths = [], []
    while lcp[winner] >= 0:
        out.append(winner)
        lengths.append(lcp[winner])
        at[winner] += 1
        here = at[winner]
        if here < len(keys[winner]):
            fronts[winner], lcp[winner] = keys[winner][here], shared[winner][here]
        else:
            lcp[winner] = -1
        node = (winner + leaves) >> 1
        while node:
            winner = match(winner, losers[node], node)
            node >>= 1
    return out, lengths


def packed_spans(ids, texts, groups, starts, stops) -> bytes:
    return pack(*unpack(packed_places(ids, texts, groups, starts)), (stops - starts).astype(np.int32))


def unpacked_spans(value: bytes) -> tuple[np.ndarray, ...]:
    ids, texts, _, counts, steps, lengths = unpack(value)
    starts = np.cumsum(steps, dtype=np.int64)
    return np.repeat(ids, counts), np.repeat(texts, counts), starts, starts + lengths


def key_runs(docs: pa.Table, candidates: pa.Table, width: int, gram: int, parts: int) -> pa.Table:
    """Sorted, front-coded runs of the candidate keys of a group of documents, by share of the anchor hashes (kind 0),
    and intervals known to be repeats (kind 1)."""
    known = starts_by_document(candidates)
    back = width - gram
    gathered_keys: list[tuple] = []
    for part in slices(docs):
        at, hashes, row = anchors(part, width, gram)
        ids, texts, groups = part.column("doc_id"), part.column("text_hash", 0), part.column("grp")
        first = np.searchsorted(row, np.arange(part.rows + 1))
        chosen = np.zeros(len(at), dtype=bool)
        for r in range(part.rows):
            starts = known.get((int(ids[r]), int(texts[r])))
            if starts is not None and first[r] < first[r + 1]:
                own = slice(first[r], first[r + 1])
                wanted = hashes[own][np.isin(at[own] - part.offsets[r], starts)]
                chosen[own] = np.isin(hashes[own], wanted)
        at, hashes, row = at[chosen], hashes[chosen], row[chosen]
        if not len(at):
            continue
        padded = np.concatenate([np.zeros(back, np.uint8), part.data, np.zeros(width, np.uint8)])
        before = np.minimum(at - part.offsets[row], back)
        after = np.minimum(part.offsets[row + 1] - at, width)
        right = padded[at[:, None] + (back + np.arange(width))] * (np.arange(width) < after[:, None])
        left = padded[at[:, None] + (back - 1 - np.arange(back))] * (np.arange(back) < before[:, None])
        gathered_keys.append((np.concatenate([right, left], axis=1), before, after, ids[row], texts[row], groups[row], at - part.offsets[row], (hashes % np.uint64(parts)).astype(np.int64)))
    out: list[tuple[int, int, bytes]] = []
    if gathered_keys:
        keys, before, after, ids, texts, groups, starts, share = (np.concatenate(c) for c in zip(*gathered_keys, strict=True))
        span = keys.shape[1] + -keys.shape[1] % 8
        numbers = np.zeros((len(keys), span), dtype=np.uint8)
        numbers[:, : keys.shape[1]] = keys
        columns = numbers.view(">u8").astype(np.uint64)
        order = np.lexsort((starts, ids, before, after, *columns.T[::-1], share))
        same = np.zeros(len(order), dtype=bool)
        o, p = order[1:], order[:-1]
        same[1:] = (columns[o] == columns[p]).all(axis=1) & (before[o] == before[p]) & (after[o] == after[p]) & (share[o] == share[p])
        leader = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        repeat = ids[order] > ids[leader]
        gone = order[repeat & (before[order] + after[order] >= width)]
        order = order[~repeat]
        for piece in np.split(order, np.flatnonzero(np.diff(share[order])) + 1) if len(order) else []:
            shared, rest = front_coded(keys[piece])
            out.append((0, int(share[piece[0]]), pack(shared, rest, before[piece].astype(np.int16), after[piece].astype(np.int16), ids[piece], texts[piece], groups[piece], starts[piece].astype(np.int64))))
        for group in np.unique(groups[gone]):
            g = gone[groups[gone] == group]
            g = g[np.lexsort((starts[g], texts[g], ids[g]))]
            out.append((1, int(group), packed_spans(ids[g], texts[g], groups[g], starts[g] - before[g], starts[g] + after[g])))
    kinds, shares_, payloads = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"kind": pa.array(kinds, pa.int32()), "part": pa.array(shares_, pa.int32()), "payload": pa.array(payloads, pa.binary())})


def repeated_spans(table: pa.Table, width: int, gram: int) -> pa.Table:
    """Merge the runs of one share and mark, for each distance from string to anchor, all but the least document."""
    if table.column("kind")[0].as_py() == 1:
        return pa.table({"grp": table.column("part"), "payload": table.column("payload")})
    back = width - gram
    runs = [unpack(v) for v in table.column("payload").to_pylist()]
    matrices = [rebuilt(r[0], r[1], width + back) for r in runs]
    keys = [[row.tobytes() for row in m] for m in matrices]
    out, lengths = merge_runs(keys, [r[0].tolist() for r in runs])
    del keys
    run_of = np.array(out, dtype=np.int64)
    begins = np.cumsum([0, *(len(m) for m in matrices)])
    position = np.empty(len(run_of), dtype=np.int64)  # in the runs, one after the other
    by_run = np.argsort(run_of, kind="stable")
    position[by_run] = np.arange(len(run_of))
    assert begins[-1] == len(run_of)
    shared = np.array(lengths, dtype=np.int64)
    left = np.concatenate(matrices)[position][:, width:]
    before, after, ids, texts, groups, starts = (np.concatenate([r[i] for r in runs])[position] for i in range(2, 8))
    numbers = np.zeros((len(left), back + -back % 8), dtype=np.uint8)
    numbers[:, :back] = left
    left_order = np.lexsort(numbers.view(">u8").astype(np.uint64).T[::-1])
    left_shared, _ = front_coded(left[left_order])
    by_id = np.argsort(ids, kind="stable")
    gone = np.zeros((len(ids), back + 2 + 1), dtype=np.int8)  # a column of zeros on either side
    for distance in range(back + 1):
        valid = by_id[(before[by_id] >= distance) & (after[by_id] >= width - distance)]
        if not len(valid):
            continue
        right_class = np.cumsum(shared < width - distance)
        left_class = np.empty(len(left), dtype=np.int64)
        left_class[left_order] = np.cumsum(left_shared < distance) if distance else 0
        key = right_class[valid] * (len(left) + 1) + left_class[valid]
        order = np.argsort(key, kind="stable")
        first = np.ones(len(order), dtype=bool)
        first[1:] = key[order][1:] != key[order][:-1]
        leader = valid[order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]]
        members = valid[order]
        gone[members[ids[members] > ids[leader]], distance + 1] = 1
    edges = np.diff(gone, axis=1)
    row, nearest = np.nonzero(edges == 1)  # distances nearest..farthest are repeated
    _, farthest = np.nonzero(edges == -1)
    begin, end = starts[row] - (farthest - 1), starts[row] - nearest + width
    order = np.lexsort((begin, texts[row], ids[row], groups[row]))
    row, begin, end = row[order], begin[order], end[order]
    pieces = np.split(np.arange(len(row)), np.flatnonzero(np.diff(groups[row])) + 1) if len(row) else []
    return pa.table({
        "grp": pa.array([int(groups[row[p[0]]]) for p in pieces], pa.int32()),
        "payload": pa.array([packed_spans(ids[row[p]], texts[row[p]], groups[row[p]], begin[p], end[p]) for p in pieces], pa.binary()),
    })


def united(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of intervals, as rows (start, stop)."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(begin), dtype=bool)
    fresh[1:] = begin[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return np.stack([begin[at], reach[np.append(at[1:], len(begin)) - 1]], axis=1) if len(begin) else np.zeros((0, 2), np.int64)


def cut(docs: pa.Table, removed: pa.Table) -> pa.Table:
    """The documents of one group with their removed runs and remaining bytes."""
    known: dict[tuple[int, int], list] = {}
    for value in removed.column("payload").to_pylist():
        ids, texts, begin, end = unpacked_spans(value)
        cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(texts) != 0)) + 1
        for piece in np.split(np.arange(len(ids)), cuts) if len(ids) else []:
            known.setdefault((int(ids[piece[0]]), int(texts[piece[0]])), []).append((begin[piece], end[piece]))
    out = [[], [], [], [], []]
    for doc_id, text_hash, text in zip(docs.column("doc_id").to_pylist(), docs.column("text_hash").to_pylist(), docs.column("text"), strict=True):
        data = (text.as_py() or "").encode()
        spans = np.zeros((0, 2), np.int64)
        if found := known.get((doc_id, text_hash)):
            spans = united(*(np.concatenate(c) for c in zip(*found, strict=True)))
        bounds = [0, *spans.ravel().tolist(), len(data)]
        kept = b"".join(data[bounds[i] : bounds[i + 1]] for i in range(0, len(bounds), 2))
        for column, value in zip(out, (doc_id, len(data), len(data) - len(kept), [{"start": b, "stop": e} for b, e in spans.tolist()], kept), strict=True):
            column.append(value)
    shape = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("kept", pa.binary())])
    return pa.table(dict(zip(shape.names, out, strict=True)), schema=shape)


def remove_repeated_bytes(docs: DataFrame, width: int = 50, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, removed, kept)``, one row per row of ``docs``; ``kept`` has the other bytes."""
    size = text_bytes(docs)
    buckets = shares(size / BYTES_PER_ANCHOR, BUCKET_ANCHORS)
    parts = shares(size, SHARE_BYTES)
    grouped = with_group(docs, shares(size, GROUP_BYTES)).withColumn("text_hash", F.hash("text"))

    def sent(batches):
        return anchor_rows(batches, width, gram, buckets)

    def runs(left: pa.Table, right: pa.Table) -> pa.Table:
        return key_runs(left, right, width, gram, parts)

    def merge(table: pa.Table) -> pa.Table:
        return repeated_spans(table, width, gram)

    candidates = grouped.mapInArrow(sent, SENT).groupBy("kind", "part").applyInArrow(shared_anchors, CANDIDATES)
    sorted_runs = grouped.groupBy("grp").cogroup(candidates.groupBy("grp")).applyInArrow(runs, RUNS)
    removed = sorted_runs.groupBy("kind", "part").applyInArrow(merge, REMOVED)
    return grouped.groupBy("grp").cogroup(removed.groupBy("grp")).applyInArrow(cut, RESULT)
