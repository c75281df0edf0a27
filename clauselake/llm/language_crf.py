"""Language identification: a linear-chain conditional random field labels every word of code-switched text.

Features of a word are its affixes (1 to 3 bytes at either end), its byte 2- and 3-grams with boundary marks, all
hashed to ``FEATURES`` rows, and its class in a lexicon (which language it is most common in, how surely, how often).
Emission weights and transitions are learned by gradient ascent on the likelihood, both sides of the gradient from
forward-backward. A document's label is the one with the greatest mean posterior over its words with a letter, and
that mean is its score; runs of words with the same best label are returned as well.

The model is fitted on a bounded sample: about ``SAMPLE_DOCS`` labelled documents per language (at most
``MAX_SAMPLE`` in all), of each a stretch of at most ``SEGMENT`` words at a place set by its hash. Half of them make the
lexicon, the other half, joined into sequences that switch languages, the training data. Prediction runs over whole
texts where they lie, without a shuffle; weights are computed once per distinct word of a slice.

Defined results: null texts and texts without a letter are ``und`` with score 0; without labelled rows all are; ties go
to the first label by name; repeated rows are predicted one by one; an empty table gives no rows; extra columns are
ignored; rows with a null doc_id are not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.chain import Layout, backward, forward, pair_counts
from clauselake.llm.common import Slice, gathered, slices
from clauselake.llm.tokens import BASES, Words, mixed, window_hashes

FEATURES = 1 << 16
SAMPLE_DOCS, MAX_SAMPLE, SEGMENT = 600, 20_000, 60
STEPS, RATE, PENALTY = 60, 0.1, 1e-4
RESULT = "doc_id bigint, held_out boolean, lang_pred string, score double, runs array<struct<start:int,stop:int,lang:string>>"
_MARK = 1 << 8  # boundary mark, beyond all bytes


class WordFeatures:
    """Hashed feature rows of some distinct words, flat; ``owner`` says whose they are."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        lengths = ends - starts
        size = lengths + 2
        begin = np.cumsum(size) - size
        marked = np.full(int(size.sum()), _MARK, dtype=np.uint64)
        inside = np.ones(len(marked), dtype=bool)
        inside[begin] = inside[begin + size - 1] = False
        place = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        marked[inside] = data[place]
        marked += np.uint64(1)
        finish = begin + size
        owners, codes = [], []
        for n in (2, 3):
            counts = np.maximum(size - n + 1, 0)
            at = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
            owners.append(np.repeat(np.arange(len(size)), counts))
            codes.append(self._hashed(marked, at, at + n, n))
        words = np.arange(len(size))
        for n in (1, 2, 3):
            own = words[lengths >= n]
            owners += [own, own]
            codes += [self._hashed(marked, begin[own] + 1, begin[own] + 1 + n, 10 + n), self._hashed(marked, finish[own] - 1 - n, finish[own] - 1, 20 + n)]
        self.owner, self.code, self.words = np.concatenate(owners), np.concatenate(codes), len(size)

    @staticmethod
    def _hashed(values: np.ndarray, begin: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        return (mixed(window_hashes(values, begin, end, BASES[1]) + np.uint64(salt * 0x51ED270B)) % np.uint64(FEATURES)).astype(np.int64)

    def weights(self, table: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.owner, weights=table[self.code, k], minlength=self.words) for k in range(table.shape[1])], axis=1)

    def gradient(self, each: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.code, weights=each[self.owner, k], minlength=FEATURES) for k in range(each.shape[1])], axis=1)


def with_letter(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words hold a letter: lower-cased ASCII at once, words with other bytes one by one."""
    ascii_sum = np.concatenate([[0], np.cumsum((data >= 0x61) & (data <= 0x7A))])
    other_sum = np.concatenate([[0], np.cumsum(data >= 0x80)])
    found = ascii_sum[ends] > ascii_sum[starts]
    for i in np.flatnonzero(~found & (other_sum[ends] > other_sum[starts])):
        found[i] = any(c.isalpha() for c in data[starts[i] : ends[i]].tobytes().decode("utf-8", "ignore"))
    return found


class Distinct:
    """Distinct words of a slice, with the place of each token among them."""

    def __init__(self, part: Slice):
        self.words = Words(part, lower=True)
        self.hashes, first, self.place = np.unique(self.words.hashes(), return_index=True, return_inverse=True)
        self.starts, self.ends = self.words.starts[first], self.words.ends[first]
        self.data = self.words.data


class Model:
    def __init__(self, labels: list[str], lexicon: tuple[np.ndarray, np.ndarray], table: np.ndarray, classes: np.ndarray, move: np.ndarray):
        self.labels, self.lexicon, self.table, self.classes, self.move = labels, lexicon, table, classes, move

    def lexicon_class(self, hashes: np.ndarray) -> np.ndarray:
        """Class of each word, the last one for words that are not listed."""
        known, kinds = self.lexicon
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        unlisted = len(self.classes) - 1
        return np.where(known[at] == hashes, kinds[at], unlisted) if len(known) else np.full(len(hashes), unlisted)

    def word_weights(self, words: Distinct) -> np.ndarray:
        scores = WordFeatures(words.data, words.starts, words.ends).weights(self.table) + self.classes[self.lexicon_class(words.hashes)]
        return np.exp(scores - scores.max(axis=1, keepdims=True))

    def posteriors(self, words: Distinct) -> np.ndarray:
        """Label posteriors of each token."""
        layout = Layout(words.words.counts)
        weights = self.word_weights(words)[words.place][layout.source]
        move, ones = np.exp(self.move), np.ones(len(self.labels))
        ahead, scales = forward(layout, weights, ones, move)
        both = ahead * backward(layout, weights, scales, move, ones)
        out = np.empty_like(both)
        out[layout.source] = both / both.sum(axis=1, keepdims=True)
        return out


def make_lexicon(hashes: np.ndarray, label: np.ndarray, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """Listed words and their classes: language * 9 + sureness * 3 + frequency."""
    known, place = np.unique(hashes, return_inverse=True)
    counts = np.stack([np.bincount(place, weights=label == k, minlength=len(known)) for k in range(labels)], axis=1)
    total = counts.sum(axis=1)
    share = counts.max(axis=1) / np.maximum(total, 1)
    return known, counts.argmax(axis=1) * 9 + np.digitize(share, [0.6, 0.9]) * 3 + np.digitize(total, [2, 8])


def fit(sample: pa.Table, labels: list[str], seed: int) -> Model:
    """Learn from sampled segments ``(text, lang)``."""
    count = len(labels)
    draws = np.random.default_rng(seed)
    sample = sample.take(pa.array(draws.permutation(sample.num_rows))).combine_chunks()
    label = np.array([labels.index(x) for x in sample.column("lang").to_pylist()])
    half = max(sample.num_rows // 2, 1)
    first, second = Distinct(Slice(sample.slice(0, half))), Distinct(Slice(sample.slice(half) if sample.num_rows > half else sample))
    lexicon = make_lexicon(first.hashes[first.place], label[:half][first.words.rows], count)
    model = Model(labels, lexicon, np.zeros((FEATURES, count)), np.zeros((9 * count + 1, count)), 0.5 * np.eye(count))
    lengths = second.words.counts
    rest = label[half:] if sample.num_rows > half else label
    truth = np.repeat(rest, lengths)
    joined = np.add.reduceat(lengths, np.arange(0, len(lengths), 3))  # three documents a sequence: labels switch
    layout = Layout(joined)
    features = WordFeatures(second.data, second.starts, second.ends)
    kinds = model.lexicon_class(second.hashes)
    token = second.place[layout.source]
    target = np.zeros((len(token), count))
    target[np.arange(len(token)), truth[layout.source]] = 1
    ahead_of = layout.source
    pairs = np.zeros((count, count))
    same_sequence = np.ones(len(truth), dtype=bool)
    same_sequence[np.cumsum(joined)[:-1]] = False
    np.add.at(pairs, (truth[:-1][same_sequence[1:]], truth[1:][same_sequence[1:]]), 1)
    held = [model.table, model.classes, model.move]
    square = [np.full_like(h, 1e-8) for h in held]
    ones = np.ones(count)
    for _ in range(STEPS if len(token) else 0):
        scores = features.weights(held[0]) + held[1][kinds]
        weights = np.exp(scores - scores.max(axis=1, keepdims=True))[token]
        move = np.exp(held[2])
        ahead, scales = forward(layout, weights, ones, move)
        back = backward(layout, weights, scales, move, ones)
        both = ahead * back
        surplus = target - both / both.sum(axis=1, keepdims=True)
        each = np.stack([np.bincount(token, weights=surplus[:, k], minlength=features.words) for k in range(count)], axis=1)
        expected = pair_counts(layout, ahead, back, weights, scales, move)
        slopes = [
            features.gradient(each),
            np.stack([np.bincount(kinds, weights=each[:, k], minlength=len(held[1])) for k in range(count)], axis=1),
            pairs - expected,
        ]
        for h, s, slope in zip(held, square, slopes, strict=True):
            slope = slope - PENALTY * len(ahead_of) * h
            s += slope**2
            h += RATE * slope / np.sqrt(s)
    return model


def sampled(docs: DataFrame, learn: Column) -> tuple[pa.Table, list[str]]:
    """Segments of about SAMPLE_DOCS documents per language, and the languages."""
    labelled = docs.filter(F.coalesce(learn, F.lit(True)) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    chosen = F.lit(False)
    for lang, count in counts.items():
        chosen = chosen | ((F.col("lang") == lang) & (draw < min(1.0, SAMPLE_DOCS / count) * (1 << 30)))
    words = F.split(F.trim(F.col("text")), r"[\x20\x09-\x0D]+")
    spare = F.greatest(F.size("words") - SEGMENT, F.lit(0))
    start = (F.pmod(F.xxhash64("text"), (spare + 1).cast("long")) + 1).cast("int")
    segments = labelled.filter(chosen).select("lang", F.col("text"), words.alias("words"))
    segments = segments.select(F.array_join(F.slice("words", start, SEGMENT), " ").alias("text"), F.col("lang").cast("string").alias("lang"))
    return segments.limit(MAX_SAMPLE).orderBy("lang", "text").toArrow(), sorted(map(str, counts))


def identify(docs: DataFrame, learn: Column, held_out: Column, seed: int = 5) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, runs)``, one row per row of ``docs``.

    Only text and non-null lang of rows where ``learn`` holds are learned from; ``held_out`` is passed on.
    """
    sample, labels = sampled(docs.select("doc_id", "text", "lang"), learn)
    model = fit(sample, labels, seed) if sample.num_rows else None
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text")
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            for part in slices(table.combine_chunks()):
                yield predicted(part, model)

    return rows.mapInArrow(predict, RESULT)


def predicted(part: Slice, model: Model | None) -> pa.RecordBatch:
    names, scores = ["und"] * part.rows, np.zeros(part.rows)
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))
    runs = pa.array([[]] * part.rows, run_type)
    if model is not None and len(part.data):
        words = Distinct(part)
        rows, bounds = words.words.rows, words.words.bounds
        lettered = with_letter(words.data, words.starts, words.ends)[words.place]
        both = model.posteriors(words)
        sums = np.stack([np.bincount(rows, weights=both[:, k] * lettered, minlength=part.rows) for k in range(len(model.labels))], axis=1)
        letters = np.bincount(rows, weights=lettered, minlength=part.rows)
        winner = sums.argmax(axis=1)
        names = [model.labels[w] if n else "und" for w, n in zip(winner.tolist(), letters.tolist(), strict=True)]
        scores = np.where(letters > 0, sums.max(axis=1) / np.maximum(letters, 1), 0.0).clip(0, 1)
        tag = both.argmax(axis=1)
        fresh = np.ones(len(tag), dtype=bool)
        fresh[1:] = (tag[1:] != tag[:-1]) | (rows[1:] != rows[:-1])
        begin = np.flatnonzero(fresh)
        row = rows[begin]
        end = np.append(begin[1:], len(tag))
        named = pa.array(np.array(model.labels, dtype=object)[tag[begin]], pa.string())
        items = pa.StructArray.from_arrays([pa.array((begin - bounds[row]).astype(np.int32)), pa.array((end - bounds[row]).astype(np.int32)), named], ["start", "stop", "lang"])
        offsets = np.searchsorted(row, np.arange(part.rows + 1)).astype(np.int32)
        runs = pa.ListArray.from_arrays(pa.array(offsets), items)
    return pa.record_batch([part.table.column("doc_id"), part.table.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), runs.cast(run_type)], names=["doc_id", "held_out", "lang_pred", "score", "runs"])
