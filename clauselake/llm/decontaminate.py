"""Benchmark decontamination with DataFrame functions only.

The windows of all benchmark items (13 consecutive words, or a whole shorter item) make a small table. While it has at
most ``MAX_BROADCAST_WINDOWS`` rows, the set of their 64-bit hashes travels with the plan: each document hashes its own
windows in place, verifies the few positions found against the set of the windows' words, and looks up their items, so
documents are neither joined nor shuffled. A larger benchmark is joined by a shuffle on the hash with the same results;
then only hashes, positions and ids move, and the words are compared where the hash is known.

Defined results: a null or empty text has no words and is clean; items without words have no windows; a window that
several items share, or equal items, count for each item; an item with a null id hits words but is not listed or
counted; rows with a null doc_id and repeated rows are judged one by one; empty tables give no rows or clean
documents; extra columns of documents are kept and never read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import carried, restored, stored
from clauselake.plans.once import compute_once

WINDOW = 13
MAX_BROADCAST_WINDOWS = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed values of the contract: what separates words. A-Z are lower-cased after the split, so they are no separators.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PLACES = "array<struct<start:int,stop:int>>"
HASHED = "array<struct<start:int,stop:int,gram_hash:bigint>>"


def words(text: Column) -> Column:
    """Words of a text, lower-cased in A-Z; none for null."""
    pieces = F.filter(F.split(text, SEPARATORS), lambda w: w != "")
    lowered = F.transform(
        pieces, lambda w: F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    )
    return F.coalesce(lowered, F.array().cast("array<string>"))


def window_table(items: DataFrame, window: int) -> DataFrame:
    """``(gram, length, gram_hash, item_ids)``: distinct windows, their words joined by a space, and their items."""
    listed = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
    listed = listed.filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    grams = F.transform(starts, lambda i: F.slice("words", i, F.col("length")))
    return (
        listed.select("item_id", "length", F.explode(grams).alias("words"))
        .select("item_id", "length", F.xxhash64("words").alias("gram_hash"), F.concat_ws(" ", "words").alias("gram"))
        .groupBy("gram", "length", "gram_hash").agg(F.collect_set("item_id").alias("item_ids"))
    )


def _starts(length: int) -> Column:
    return F.when(F.size("words") >= length, F.sequence(F.lit(1), F.size("words") - (length - 1)))


def _gram(start: Column, length: int) -> Column:
    return F.concat_ws(" ", F.slice("words", start, length))


def _occurrences(length: int, hashes: list[int], texts: list[str]) -> Column:
    """Places whose window has one of ``hashes`` and is one of ``texts``."""
    likely = F.filter(_starts(length), lambda i: F.xxhash64(F.slice("words", i, length)).isin(hashes))
    sure = F.filter(likely, lambda i: _gram(i, length).isin(texts))
    places = F.transform(sure, lambda i: F.struct((i - 1).alias("start"), (i - 1 + length).alias("stop")))
    return F.coalesce(places, F.array().cast(PLACES))


def _hashed_windows(length: int) -> Column:
    windows = F.transform(
        _starts(length),
        lambda i: F.struct(
            (i - 1).alias("start"), (i - 1 + length).alias("stop"), F.xxhash64(F.slice("words", i, length)).alias("gram_hash")
        ),
    )
    return F.coalesce(windows, F.array().cast(HASHED))


def covered(spans: Column) -> Column:
    """Words below the union of ``spans``, sorted by start; stops are exclusive."""
    return F.aggregate(
        spans, F.struct(F.lit(0).alias("total"), F.lit(0).alias("reach")),
        lambda acc, s: F.struct(
            (acc["total"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["reach"]))).alias("total"),
            F.greatest(acc["reach"], s["stop"]).alias("reach"),
        ),
        lambda acc: acc["total"],
    )


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_windows: int = MAX_BROADCAST_WINDOWS) -> DataFrame:
    """``docs`` with ``words``, ``spans`` (word positions of the occurrences, by start) and ``item_ids`` (by name)."""
    grams = stored(window_table(items, window), "windows")
    tagged = compute_once(docs, words=words(F.col("text")))
    lengths = [row["length"] for row in grams.select("length").distinct().orderBy("length").collect()]  # window at most
    if grams.count() > broadcast_windows:
        return _joined(tagged, grams, lengths)
    known = grams.collect()  # at most broadcast_windows rows
    found = F.array().cast(PLACES)
    for n in lengths:
        own = [row for row in known if row["length"] == n]
        found = F.concat(found, _occurrences(n, sorted({row["gram_hash"] for row in own}), sorted(row["gram"] for row in own)))
    tagged = compute_once(tagged, spans=F.array_sort(found))
    names = F.from_json(F.lit(json.dumps([row["gram"] for row in known])), "array<string>")
    owners = F.from_json(F.lit(json.dumps([sorted(row["item_ids"]) for row in known])), "array<array<string>>")
    held = F.transform(
        F.array_distinct(F.transform("spans", lambda s: _gram(s["start"] + 1, s["stop"] - s["start"]))),
        lambda g: F.element_at(owners, F.array_position(names, g).cast("int")),
    )
    items_hit = F.when(F.size("spans") > 0, F.array_sort(F.array_distinct(F.flatten(held))))
    return compute_once(tagged, item_ids=F.coalesce(items_hit, F.array().cast("array<string>")))


def _joined(tagged: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """The same by shuffles, for a benchmark of any size. Equal rows share their windows."""
    tagged = tagged.withColumn("row", F.xxhash64("doc_id", "text"))
    all_windows = F.concat(*[_hashed_windows(n) for n in lengths], F.array().cast(HASHED))
    spread = tagged.select("row", F.inline(all_windows)).distinct()
    likely = spread.join(grams.select("gram_hash").distinct(), "gram_hash", "left_semi")
    places = likely.select("row", F.struct("start", "stop").alias("place"))
    placed = tagged.join(places.groupBy("row").agg(F.array_sort(F.collect_set("place")).alias("places")), "row", "left")
    texts = F.transform("places", lambda p: F.struct(p, _gram(p["start"] + 1, p["stop"] - p["start"])))
    hits = placed.select("row", F.inline(texts)).toDF("row", "place", "gram").distinct().join(grams.select("gram", "item_ids"), "gram")
    gathered = hits.groupBy("row").agg(
        F.array_sort(F.collect_set("place")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
    )
    judged = tagged.join(gathered, "row", "left").drop("row")
    return judged.withColumns({
        "spans": F.coalesce("spans", F.array().cast(PLACES)),
        "item_ids": F.coalesce("item_ids", F.array().cast("array<string>")),
    })


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, **settings: int) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``spans``, ``item_ids`` and ``contaminated``.

    A document is contaminated when at least one in ``share`` of its words is hit.
    """
    hits = find_hits(docs, items, window, **settings)
    hits = compute_once(hits, n_words=F.size("words").cast("long"), n_hit=covered(F.col("spans")).cast("long")).drop("words")
    return hits.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with the columns of ``docs``."""
    return restored(judge(carried(docs), items, window, share).filter(~F.col("contaminated")), docs)
