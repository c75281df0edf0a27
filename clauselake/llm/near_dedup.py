"""Near-duplicates by order MinHash, verified by banded alignment.

A text's 5-word shingles are labelled with their occurrence number. For each of ``SKETCHES`` hash functions the ``PICKS``
labelled shingles of least hash are taken and kept in text order; the hash of that tuple is the sketch. Texts with few
edits share most sketches, texts with the same shingles in another order do not. Equal sketches of texts of like length
make a bucket; each member is first compared with the bucket's least and greatest document, so a bucket of n members
gives at most 2 n pairs. A pair is verified by the longest common subsequence L of the two shingle sequences, computed in
a band around the diagonal that no alignment good enough can leave: L / (m + n - L) has to reach ``SIMILARITY``. Verified
pairs are joined into classes by alternating star contractions.

A bucket whose members are one class by then is done. Any other is open: up to ``WHOLE`` members are all compared across
classes. Members of larger ones are compared exactly, by shared rare shingles (prefix filtering): every pair of unlike
classes that can reach the threshold is verified, and boilerplate below it makes no pairs. So a pair is lost only if it
shares none of the ``SKETCHES`` sketches.

Equal texts are collapsed to their least document before anything is compared. Representatives of large buckets are
salted; texts move once to be partitioned by document and once more for documents that have candidates.

Defined results: null texts and rows with a null doc_id are classes of their own (the class of a null id is null);
empty texts equal each other; a text of fewer than five words is one shingle; rows that share a doc_id are one class,
of which the row of least text digest is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import Slice, gathered, slices, stored
from clauselake.llm.tokens import BASES, Words, mixed, window_hashes

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, PICKS = 12, 2
WHOLE, SLOTS = 64, 1 << 20
SALT_ROWS = 1000
NONE = np.iinfo(np.uint64).max
LAST = np.iinfo(np.int64).max


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all rows one after the other, their rows, and the number per row."""
    hashes = words.hashes()
    counts = np.where(words.counts >= size, words.counts - size + 1, np.minimum(words.counts, 1))
    row = np.repeat(np.arange(len(counts)), counts)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + words.bounds[row]
    end = np.minimum(begin + size, words.bounds[row + 1])
    return mixed(window_hashes(hashes, begin, end, BASES[1]) + (end - begin).astype(np.uint64)), row, counts


def occurrence_labelled(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Shingle hashes that also tell the first, second, ... occurrence in a text apart."""
    order = np.lexsort((hashes, row))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    index = np.arange(len(order))
    occurrence = np.empty(len(order), dtype=np.uint64)
    occurrence[order] = index - np.maximum.accumulate(np.where(fresh, index, 0))
    return mixed(hashes + occurrence * np.uint64(BASES[2]))


def sketches(hashes: np.ndarray, row: np.ndarray, counts: np.ndarray, number: int, picks: int) -> np.ndarray:
    """Order MinHash sketches, one row per text that has shingles."""
    labelled = occurrence_labelled(hashes, row)
    held = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[held]
    dense = np.repeat(np.arange(len(held)), counts[held])
    out = np.empty((len(held), number), dtype=np.uint64)
    for s in range(number):
        values = mixed(labelled ^ np.uint64((s + 1) * 0x632BE59BD9B4E019 & NONE)) >> np.uint64(1)
        chosen = np.full((len(held), picks), len(hashes), dtype=np.int64)
        for p in range(picks):
            least = np.minimum.reduceat(values, starts)
            hit = np.flatnonzero((values == least[dense]) & (values != NONE))
            first = np.ones(len(hit), dtype=bool)
            first[1:] = dense[hit][1:] != dense[hit][:-1]
            hit = hit[first]
            chosen[dense[hit], p] = hit
            values[hit] = NONE
        chosen.sort(axis=1)
        total = np.full(len(held), s + 1, dtype=np.uint64)
        for p in range(picks):
            own = chosen[:, p] < len(hashes)
            total[own] = mixed(total[own] * np.uint64(BASES[0]) + hashes[chosen[own, p]])
        out[:, s] = total
    return out


def sketched(docs: DataFrame, size: int, number: int, picks: int, similarity: float) -> DataFrame:
    """``(doc_id, digest, shingles, keys)``: keys are sketches under the two overlapping length bands of the text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            for part in slices(table.combine_chunks()):
                hashes, row, counts = shingles(Words(part, lower=True), size)
                keys = np.zeros((part.rows, 0), np.uint64)
                lists = np.zeros(part.rows, np.int64)
                if len(hashes):
                    found = sketches(hashes, row, counts, number, picks)
                    held = counts > 0
                    level = np.log(counts[held]) / -np.log(similarity) / 2  # like lengths differ by at most a half
                    bands = [np.floor(level).astype(np.uint64) * np.uint64(2), np.floor(level + 0.5).astype(np.uint64) * np.uint64(2) + np.uint64(1)]
                    keys = np.concatenate([mixed(found + (band[:, None] + np.uint64(1)) * np.uint64(BASES[1])) for band in bands], axis=1)
                    lists[held] = keys.shape[1]
                values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lists)]).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
                yield pa.record_batch([part.table.column("doc_id"), part.table.column("digest"), pa.array(counts.astype(np.int64)), values], names=["doc_id", "digest", "shingles", "keys"])

    return docs.mapInArrow(sketch, "doc_id bigint, digest string, shingles bigint, keys array<bigint>")


def candidates(rows: DataFrame) -> DataFrame:
    """``(doc, other)``: each member of a bucket, given as ``(key, doc_id)``, with the bucket's least and greatest document."""
    ends = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    members = rows.join(ends, "key")
    pairs = members.select(F.col("doc_id").alias("doc"), F.explode(F.array("least", "most")).alias("other")).filter("doc <> other")
    return pairs.select(F.greatest("doc", "other").alias("doc"), F.least("doc", "other").alias("other"), (F.col("doc") < F.col("other")).alias("turned")).groupBy("doc", "other").agg(F.min("turned").alias("turned")).select(
        F.when(F.col("turned"), F.col("other")).otherwise(F.col("doc")).alias("doc"),
        F.when(F.col("turned"), F.col("doc")).otherwise(F.col("other")).alias("other"))


def open_buckets(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``(key, doc_id, shingles, root, members)`` of the buckets whose members are of several classes."""
    named = rows.join(roots, rows["doc_id"] == roots["node"], "left").select("key", "doc_id", "shingles", F.coalesce("root", "doc_id").alias("root"))
    mixed_ones = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("members")).filter("a < b")
    return named.join(mixed_ones.select("key", "members"), "key")


def across_classes(rows: DataFrame, similarity: float) -> DataFrame:
    """``(doc, other)``: all pairs of a bucket's members of unlike classes whose lengths allow ``similarity``."""
    left = rows.select("key", F.col("doc_id").alias("doc"), "root", "shingles")
    right = rows.select("key", F.col("doc_id").alias("other"), F.col("root").alias("other_root"), F.col("shingles").alias("other_shingles"))
    alike = F.least("shingles", "other_shingles") >= similarity * F.greatest("shingles", "other_shingles") - 1e-9
    return left.join(right, "key").filter((F.col("doc") > F.col("other")) & (F.col("root") != F.col("other_root")) & alike).select("doc", "other").distinct()


def labelled_grams(part: Slice, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles with their occurrence number as hashes, unlike within a text; their rows, and the number per row."""
    hashes, row, counts = shingles(Words(part, lower=True), size)
    return occurrence_labelled(hashes, row), row, counts


def gram_slots(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """By ``SLOTS`` hash slots: how often labelled shingles occur, and whether in unlike classes. Arrays of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least, most = np.zeros(SLOTS, dtype=np.int64), np.full(SLOTS, LAST), np.full(SLOTS, -LAST - 1)
        for batch in batches:
            for part in slices(iter([batch])):
                grams, row, _ = labelled_grams(part, size)
                slot, root = (grams % np.uint64(SLOTS)).astype(np.int64), part.column("root")[row]
                total += np.bincount(slot, minlength=SLOTS)
                np.minimum.at(least, slot, root)
                np.maximum.at(most, slot, root)
        slot = np.flatnonzero(total)
        for begin in range(0, len(slot), 1 << 16):
            own = slot[begin : begin + (1 << 16)]
            yield pa.record_batch({"slot": own.astype(np.int32), "n": total[own], "least": least[own], "most": most[own]})

    counted = texts.select("root", "text").mapInArrow(count, "slot int, n bigint, least bigint, most bigint")
    summed = counted.groupBy("slot").agg(F.sum("n").alias("n"), (F.min("least") < F.max("most")).alias("unlike")).toArrow()
    frequency, unlike = np.zeros(SLOTS, dtype=np.int64), np.zeros(SLOTS, dtype=bool)
    frequency[summed.column("slot").to_numpy()] = summed.column("n").to_numpy()
    unlike[summed.column("slot").to_numpy()] = summed.column("unlike").to_numpy()
    return frequency, unlike


def prefix_pairs(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """``(doc, other)``: the pairs of unlike classes among ``(doc_id, root, text)`` that can reach ``similarity``, none missed.

    Each text sorts its shingles by their frequency, rare ones first. Two texts with enough in common share one among
    the first few, so many that the rest is too little; of the shorter text fewer are needed. What most texts of a large
    bucket share is frequent and comes last, so boilerplate below the threshold makes no pairs.
    """
    frequency, unlike = gram_slots(texts, size)

    def first_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch])):
                grams, row, counts = labelled_grams(part, size)
                slot = (grams % np.uint64(SLOTS)).astype(np.int64)
                order = np.lexsort((grams, frequency[slot], row))
                place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                own = counts[row]
                longer = place <= own - np.ceil(similarity * own - 1e-9)
                shorter = place <= own - np.ceil(2 * similarity / (1 + similarity) * own - 1e-9)
                taken = np.flatnonzero(longer & unlike[slot[order]])  # what one class alone holds makes no pair of two
                at = row[taken]
                yield pa.record_batch({
                    "gram": grams[order][taken].view(np.int64), "doc_id": part.column("doc_id")[at], "root": part.column("root")[at],
                    "n": own[taken].astype(np.int32), "place": place[taken].astype(np.int32), "first": pa.array(shorter[taken])})

    entries = stored(texts.select("doc_id", "root", "text").mapInArrow(first_grams, "gram bigint, doc_id bigint, root bigint, n int, place int, first boolean"), "prefixes")
    of_many = entries.groupBy("gram").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.bool_or("first").alias("probed")).filter("a < b and probed").select("gram")
    shared = entries.join(of_many, "gram", "left_semi")
    short = shared.filter("first").select("gram", F.col("doc_id").alias("s"), F.col("root").alias("s_root"), F.col("n").alias("s_n"), F.col("place").alias("s_place"))
    wanted = similarity / (1 + similarity) * (F.col("s_n") + F.col("n")) - 1e-9
    met = shared.join(short, "gram").filter(
        (F.col("root") != F.col("s_root")) & ((F.col("s_n") < F.col("n")) | ((F.col("s_n") == F.col("n")) & (F.col("s") < F.col("doc_id"))))
        & (F.col("s_n") >= similarity * F.col("n") - 1e-9) & (F.least(F.col("s_n") - F.col("s_place"), F.col("n") - F.col("place")) >= wanted))
    return met.select(F.greatest("s", "doc_id").alias("doc"), F.least("s", "doc_id").alias("other")).distinct()


def class_roots(unique: DataFrame, texts: DataFrame, tied: DataFrame, size: int, similarity: float, whole: int) -> DataFrame:
    """``(node, root)`` by verified pairs: a bucket's ends first, then what is left open between unlike classes."""
    rows = unique.select(F.explode("keys").alias("key"), "doc_id", "shingles")
    edges = stored(verified(texts, candidates(rows), size, similarity).select("doc", "other").unionAll(tied), "links")
    roots = classes(edges)
    unlike = stored(open_buckets(rows, roots), "open")
    if not unlike.limit(1).count():
        return roots
    pairs = across_classes(unlike.filter(F.col("members") <= whole), similarity)
    large = unlike.filter(F.col("members") > whole).groupBy(F.col("doc_id").alias("id")).agg(F.min("root").alias("root")).hint("merge")
    among = texts.join(large, texts["doc_id"] == large["id"]).groupBy("doc_id", "root", "digest").agg(F.first("text").alias("text"))
    among = stored(among, "open-texts")
    pairs = pairs.unionAll(prefix_pairs(among, size, similarity)).distinct()
    return classes(edges.unionAll(verified(texts, pairs, size, similarity).select("doc", "other")))


def banded_common(a: list, b: list, band: int) -> int:
    """Longest common subsequence by matches with ``|i - j| <= band``: a bit per place of the band, a step per place of b."""
    places: dict = {}
    for i, value in enumerate(a):
        places.setdefault(value, []).append(i)
    width = 2 * band + 1
    full = (1 << width) - 1
    unmatched, low, common = full, 0, 0
    for j, value in enumerate(b):
        if j - band > low:  # the band moves on; the place that leaves it is settled
            common += 1 - (unmatched & 1)
            unmatched = (unmatched >> 1) | (1 << (width - 1))
            low += 1
        own = places.get(value)
        if own:
            match = 0
            for i in own[bisect_left(own, low) : bisect_right(own, j + band)]:
                match |= 1 << (i - low)
            taken = unmatched & match
            unmatched = ((unmatched + taken) | (unmatched - taken)) & full
    return common + width - unmatched.bit_count()


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Shared over all shingles of the best alignment; 0 where it cannot reach ``least``."""
    m, n = len(a), len(b)
    wanted = least * (m + n) / (1 + least)
    if not m or not n or min(m, n) < wanted - 1e-9:
        return 0.0
    short = min(m, n)
    differs = np.flatnonzero(a[:short] != b[:short])
    head = int(differs[0]) if len(differs) else short
    rest = short - head
    differs = np.flatnonzero(a[m - rest :][::-1] != b[n - rest :][::-1]) if rest else np.zeros(0, np.int64)
    tail = int(differs[0]) if len(differs) else rest
    x, y = a[head : m - tail].tolist(), b[head : n - tail].tolist()
    common = head + tail
    if x and y:
        if common + sum((Counter(x) & Counter(y)).values()) < wanted - 1e-9:
            return 0.0
        common += banded_common(x, y, int(max(m, n) - wanted) + 1)
    return common / (m + n - common) if common >= wanted - 1e-9 else 0.0


def verified(docs: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs whose alignment reaches ``similarity``."""
    load = pairs.groupBy("other").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    dealt = pairs.join(load, "other").select("doc", "other", F.pmod(F.xxhash64("doc"), "salts").cast("int").alias("salt"))
    dealt = stored(dealt, "pairs").hint("merge")  # pairs grow with the corpus: never broadcast, alike at every size
    texts = docs.select("doc_id", "text")
    left = texts.join(dealt, texts["doc_id"] == dealt["doc"]).select("doc", "other", "salt", F.col("text").alias("left"))
    wanted = dealt.select(F.col("other").alias("id"), F.col("salt").alias("part")).distinct().hint("merge")
    right = texts.join(wanted, texts["doc_id"] == wanted["id"]).select("id", "part", F.col("text").alias("right"))
    both = left.join(right.hint("merge"), (left["other"] == right["id"]) & (left["salt"] == right["part"])).select("doc", "other", "left", "right")

    def sequences(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
        column = pa.record_batch([batch.column(name)], names=["text"])
        out: list[np.ndarray] = []
        for part in slices(iter([column])):
            hashes, _, counts = shingles(Words(part, lower=True), size)
            out += np.split(hashes, np.cumsum(counts)[:-1])
        return out

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                found = pa.array([aligned_similarity(a, b, similarity) for a, b in zip(sequences(part, "left"), sequences(part, "right"), strict=True)], pa.float64())
                yield pa.record_batch([part.column("doc"), part.column("other"), found], names=["doc", "other", "similarity"])

    return both.mapInArrow(align, "doc bigint, other bigint, similarity double").filter("similarity > 0")


def classes(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has an edge: least node of its connected component.

    Alternates large and small stars; each round is written to the shared folder, and their number grows with the
    logarithm of the longest path.
    """
    current = stored(edges.select(F.greatest("doc", "other").alias("u"), F.least("doc", "other").alias("v")).filter("u > v").distinct(), "edges")
    before = None
    while True:
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        current = stored(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u > v").distinct(), "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, number: int = SKETCHES, picks: int = PICKS, whole: int = WHOLE
) -> DataFrame:
    """``(doc_id, class_id, shingles, digest, kept)``, one row per row of ``docs``; a class is named by its least doc_id.

    ``kept`` marks one document of each class.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("digest", F.md5("text"))
    listed = stored(sketched(rows, size, number, picks, similarity), "sketches")
    judged = F.col("doc_id").isNotNull() & F.col("digest").isNotNull()
    known = listed.filter(judged)
    unique = known.groupBy("digest").agg(F.min(F.struct("doc_id", "keys", "shingles")).alias("first")).select("digest", "first.*")
    unique = stored(unique, "unique")
    firsts = unique.select(F.col("doc_id"), F.col("digest").alias("own"))
    texts = rows.filter(judged)
    versions = known.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a < b")  # one id, several texts
    tied = known.join(versions.select("doc_id"), "doc_id", "left_semi").join(unique.select("digest", F.col("doc_id").alias("other")), "digest")
    tied = tied.select(F.col("doc_id").alias("doc"), "other").filter("doc <> other")
    roots = class_roots(unique, texts, tied, size, similarity, whole)
    named = firsts.join(roots, firsts["doc_id"] == roots["node"], "left").select("own", F.coalesce("root", "doc_id").alias("class_id"))
    found = listed.join(named, listed["digest"] == named["own"], "left").select(
        "doc_id", F.when(judged, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "shingles", "digest")
    least = known.groupBy(F.col("doc_id").alias("id")).agg(F.min("digest").alias("least"))
    return found.join(least, found["doc_id"] == least["id"], "left").select(
        "doc_id", "class_id", "shingles", "digest",
        (~judged | ((F.col("doc_id") == F.col("class_id")) & (F.col("digest") == F.col("least")))).alias("kept"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each class; of equal rows one is kept."""
    found = near_duplicates(docs, **settings).filter("kept").select(F.col("doc_id").alias("id"), F.col("digest").alias("kept_digest")).distinct()
    whole = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").cast("long").alias("id"), F.md5("text").alias("kept_digest"))
    plain = whole.filter("id is null or kept_digest is null").select("whole.*")
    judged = whole.join(found, ["id", "kept_digest"], "left_semi")
    return judged.groupBy("id", "kept_digest").agg(F.first("whole").alias("whole")).select("whole.*").unionAll(plain)
