"""Toxicity behind spelling tricks: noisy-channel decoding of character lattices, then a score of the restored text.

A writer's word passes a channel that may swap letters for look-alikes (leetspeak), repeat letters, and put separators
or spaces between them. Each observed word, or run of single characters, is a lattice: per character the letters it may
stand for, with the cost of the swap, or nothing where it may be a repetition or a separator. The Viterbi path under an
interpolated character 4-gram model restores the word. Restored words are looked up in a table of weights, and a
logistic function of a text's greatest weight and of the sum over its distinct words gives its score.

Everything is learned from the rows that ``learn`` selects, all labelled texts (equal
texts once): word weights are lower bounds of the log odds of being in a toxic text, the character model mixes
the texts with the weighted words, the logistic function is fitted on the same texts. The model has at most ``WORDS``
weighted words and 28**4 probabilities whatever the corpus holds, and travels to the tasks, which score whole texts
where they lie.

A word is decoded only if it, or a piece of it between separators, could be a weighted word: letters and their
look-alikes form classes, and collapsed classes must be those of a weighted word; classes of marks that may be letters
or separators are left out on both sides. ``restored_text`` decodes everything.

Defined results: null and empty texts score as a text without weighted words; rows with a null doc_id are scored and
teach nothing; a labelled doc_id is toxic if any of its label rows says so, and rows with a null label say nothing;
without labelled toxic and harmless texts every score is the share of toxic ones (0 without any); repeated rows are
scored one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import Slice, gathered, slices, stored, with_ids
from clauselake.llm.tokens import Words

WORDS, LEAST_WEIGHT = 2000, 1.5
THRESHOLD = 0.3
SYMBOLS, SPACE, OTHER = 28, 26, 27  # a to z, a space, anything else
LEXICON_SHARE = 0.2
SWAP, AGAIN, REPEAT, DROP, INNER_DROP, SPLIT = 2.5, 0.5, 1.0, 1.5, 3.0, 0.5  # costs of the channel, natural logarithms
HELD_TYPES = 200_000

# The letters that a look-alike may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l",
}
MAYBE_MARKS = "@$!|+€£"  # look-alikes that may also be mere separators
MERGED = {"l": "i"}  # letters that share a look-alike are one class
CLASSES = str.maketrans({**{s: MERGED.get(v[0], v[0]) for s, v in LOOKALIKES.items()}, **MERGED})
LOOSE = {MERGED.get(v, v) for s in MAYBE_MARKS for v in LOOKALIKES[s]}
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "€£…“”‘’«»¡¿–—"
_LETTER = re.compile(r"[a-z]")
_MARKS = re.compile(r"[^a-z0-9@$!|+€£]+")
_MAYBE = re.compile(r"[@$!|+€£]")
_PLAIN = re.compile(r"[a-z]+\Z")
_DOUBLE = re.compile(r"(.)\1")
_RUN = re.compile(r"(.)\1+")


def folded(word: str) -> str:
    """Lower case without accents."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", word).lower() if not unicodedata.combining(c))


def core(word: str) -> str:
    """A folded word without the marks at its ends."""
    return folded(word).strip(EDGES)


def classes_of(text: str) -> str:
    """Letter classes, runs collapsed."""
    return _RUN.sub(r"\1", _MARKS.sub("", text).translate(CLASSES))


def loose_classes(text: str) -> str:
    """Classes without those that a possible separator could be."""
    return _RUN.sub(r"\1", "".join(c for c in _MARKS.sub("", text).translate(CLASSES) if c not in LOOSE))


class Channel:
    """Viterbi decoding under a character model of ``SYMBOLS**4`` natural log probabilities."""

    def __init__(self, logs: np.ndarray):
        self.logs = logs

    @staticmethod
    def lattice(text: str) -> list[list[tuple[str, float]]]:
        """Per character the alternatives and their costs; an empty one is a dropped character."""
        found = []
        for i, c in enumerate(text):
            if _LETTER.match(c):
                options = [(c, 0.0)]
            elif c in LOOKALIKES:
                before = text[i - 1] if i else ""
                options = [(letter, AGAIN if letter in LOOKALIKES.get(before, before) else SWAP) for letter in LOOKALIKES[c]]
                inside = 0 < i < len(text) - 1
                options += [("", INNER_DROP if inside else DROP), (" ", SPLIT)] if c in MAYBE_MARKS else [("#", 0.0)]
            else:
                options = [("", DROP), (" ", SPLIT)]
            if i and c == text[i - 1]:
                options.append(("", REPEAT))
            found.append(options)
        return found

    def decode(self, text: str) -> str:
        """The likeliest writing behind folded ``text``."""
        states: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(SPACE,) * 3: (0.0, None)}
        for options in [*self.lattice(text), [(" ", 0.0)]]:
            reached: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
            for state, (cost, path) in states.items():
                for letter, price in options:
                    total, after, held = cost + price, state, path
                    symbol = SPACE if letter == " " else OTHER if letter == "#" else ord(letter) - 97 if letter else -1
                    if symbol >= 0 and not (symbol == SPACE and state[2] == SPACE):
                        total -= self.logs[((state[0] * SYMBOLS + state[1]) * SYMBOLS + state[2]) * SYMBOLS + symbol]
                        after, held = (state[1], state[2], symbol), (letter, path)
                    if after not in reached or total < reached[after][0]:
                        reached[after] = (total, held)
            states = reached
        _, path = min(states.values(), key=lambda s: s[0])
        letters = []
        while path:
            letters.append(path[0])
            path = path[1]
        return "".join(reversed(letters)).strip()


def restored_word(channel: Channel, word: str) -> str:
    """The restored form of any word; one without tricks is itself."""
    own = core(word)
    if not own:
        return ""
    if _PLAIN.match(own) and not _DOUBLE.search(own):
        return own
    if not _LETTER.search(own.translate(CLASSES)):
        return own
    return channel.decode(own)


class Model:
    """Weights of words, the channel, and the logistic function over a text's weights."""

    def __init__(self, weights: dict[str, float], logs: np.ndarray, logistic: tuple[float, float, float]):
        self.weights, self.channel, self.logistic = weights, Channel(logs), logistic
        self.exact = {classes_of(w) for w in weights} - {""}
        self.loose = {loose_classes(w) for w in weights}
        self._held: dict[str, tuple[str, ...]] = {}

    def weighted(self, word: str) -> tuple[str, ...]:
        """The weighted words behind an observed word."""
        held = self._held.get(word)
        if held is None:
            if len(self._held) >= HELD_TYPES:
                self._held.clear()
            held = self._held[word] = self._weighted(word)
        return held

    def _weighted(self, word: str) -> tuple[str, ...]:
        own = core(word)
        if own in self.weights:
            return (own,)
        whole = folded(word)
        look, known = (loose_classes, self.loose) if _MAYBE.search(whole) else (classes_of, self.exact)
        if look(whole) not in known and not any(p and look(p) in known for p in self._pieces(own)):
            return ()
        found = self.channel.decode(whole).split()
        return tuple(dict.fromkeys(w for w in found if w in self.weights))

    @staticmethod
    def _pieces(own: str) -> list[str]:
        """Parts between separators, sure ones and possible ones."""
        pieces = _MARKS.split(own) if _MARKS.search(own) else []
        return pieces + _MAYBE.split(own) if _MAYBE.search(own) else pieces

    def spaced(self, run: str) -> tuple[str, ...]:
        """The weighted words behind single characters with spaces between."""
        whole = folded(run)
        look, among = (loose_classes, self.loose) if _MAYBE.search(whole) else (classes_of, self.exact)
        if not any(c in look(whole) for c in among):
            return ()
        return tuple(dict.fromkeys(w for w in self.channel.decode(whole).split() if w in self.weights))

    def features(self, part: Slice) -> np.ndarray:
        """Greatest weight and sum over the distinct weighted words of each text."""
        words = Words(part)
        _, first, index = np.unique(words.hashes(), return_index=True, return_inverse=True)
        text = words.data.tobytes()
        found: list[set[str]] = [set() for _ in range(part.rows)]
        kinds = [self.weighted(text[a:b].decode("utf-8", "replace")) for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
        hits = np.array([bool(k) for k in kinds], dtype=bool)
        if len(hits):
            for place in np.flatnonzero(hits[index]).tolist():
                found[words.rows[place]].update(kinds[index[place]])
        for row, run in single_runs(words, text):
            found[row].update(self.spaced(run))
        out = np.zeros((part.rows, 2))
        for row, own in enumerate(found):
            if own:
                weights = sorted(self.weights[w] for w in own)
                out[row] = weights[-1], math.fsum(weights)
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        base, greatest, total = self.logistic
        if math.isinf(base):
            return np.full(len(features), float(base > 0))
        return 1 / (1 + np.exp(-np.clip(base + features @ np.array([greatest, total]), -500, 500)))


def single_runs(words: Words, text: bytes) -> Iterator[tuple[int, str]]:
    """Row and characters of each run of three or more words of one ASCII character."""
    single = np.flatnonzero(words.ends - words.starts == 1)
    if len(single) < 3:
        return
    breaks = np.flatnonzero((np.diff(single) != 1) | (np.diff(words.rows[single]) != 0)) + 1
    for begin, end in zip([0, *breaks.tolist()], [*breaks.tolist(), len(single)], strict=True):
        if end - begin >= 3:
            yield int(words.rows[single[begin]]), " ".join(chr(text[i]) for i in words.starts[single[begin:end]].tolist())


def symbols_of(text: str) -> np.ndarray:
    """A text as symbol numbers, other runs than letters as one space or mark."""
    squeezed = re.sub(r"[^a-z0-9]+", " ", folded(text))
    codes = np.frombuffer(f"   {squeezed} ".encode("ascii"), dtype=np.uint8).astype(np.int64)
    return np.where(codes == 32, SPACE, np.where(codes >= 97, codes - 97, OTHER))


def gram_counts(texts: list[str]) -> np.ndarray:
    counts = np.zeros(SYMBOLS**4)
    for text in texts:
        s = symbols_of(text)
        code = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
        counts += np.bincount(code, minlength=SYMBOLS**4) if len(code) > SYMBOLS**3 else 0
        if len(code) <= SYMBOLS**3:
            np.add.at(counts, code, 1)
    return counts


def interpolated(counts: np.ndarray) -> np.ndarray:
    """Probabilities of a symbol after three others: each order backed off to the shorter one by its number of kinds."""
    prob = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, 5):
        own = counts.reshape(-1, SYMBOLS**order).sum(axis=0).reshape(-1, SYMBOLS)
        kinds = (own > 0).sum(axis=1, keepdims=True)
        total = own.sum(axis=1, keepdims=True)
        shorter = np.tile(prob.reshape(-1, SYMBOLS), (len(own) // max(1, prob.size // SYMBOLS), 1))
        prob = np.where(total > 0, (own + kinds * shorter) / np.maximum(total + kinds, 1), shorter)
    return prob.ravel()


def toxic_labels(labels: DataFrame) -> DataFrame:
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


def labelled(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """``(text, toxic)``: all labelled texts that may teach, equal texts once."""
    teach = docs.filter(F.coalesce(learn, F.lit(False)) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"))
    chosen = toxic_labels(labels).join(teach.distinct(), "id", "left_semi").withColumnRenamed("id", "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = with_ids(texts, chosen)
    return rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def word_evidence(rows: DataFrame) -> tuple[dict[str, tuple[int, int]], np.ndarray, tuple[int, int]]:
    """Texts with each of the heaviest words by kind, 4-gram counts, and texts of each kind; sums of partial counts of the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches):
            seen: dict[str, list[int]] = {}
            texts, kinds = table.column("text").to_pylist(), table.column("toxic").to_pylist()
            for text, toxic in zip(texts, kinds, strict=True):
                for word in {core(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)}:
                    if _PLAIN.match(word):
                        seen.setdefault(word, [0, 0])[toxic] += 1
            grams = gram_counts(texts)
            code = np.flatnonzero(grams)
            words = pa.record_batch({
                "word": list(seen), "code": pa.nulls(len(seen), pa.int64()),
                "harmless": pa.array([n[0] for n in seen.values()], pa.int64()), "toxic": pa.array([n[1] for n in seen.values()], pa.int64())})
            yield words
            yield pa.record_batch({"word": pa.nulls(len(code), pa.string()), "code": code, "harmless": grams[code].astype(np.int64), "toxic": np.zeros(len(code), np.int64)})
            yield pa.record_batch({
                "word": pa.array([""], pa.string()), "code": pa.nulls(1, pa.int64()),
                "harmless": pa.array([len(kinds) - sum(kinds)], pa.int64()), "toxic": pa.array([sum(kinds)], pa.int64())})

    counted = rows.mapInArrow(count, "word string, code bigint, harmless bigint, toxic bigint")
    summed = counted.groupBy("word", "code").agg(F.sum("harmless").alias("harmless"), F.sum("toxic").alias("toxic"))
    summed = stored(summed.filter("code is not null or word = '' or toxic >= 2"), "toxic-words")  # other words get no weight
    table = summed.filter("code is not null or word = ''").toArrow().to_pydict()  # SYMBOLS**4 rows at most
    grams, size = np.zeros(SYMBOLS**4), (0, 0)
    for code, harmless, toxic in zip(table["code"], table["harmless"], table["toxic"], strict=True):
        if code is not None:
            grams[code] = harmless
        else:
            size = (harmless, toxic)
    odds = F.log((F.col("toxic") + 0.5) / (size[1] + 1)) - F.log((F.col("harmless") + 0.5) / (size[0] + 1))
    bound = odds - 1.64 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("harmless") + 0.5))
    heaviest = summed.filter("code is null and length(word) > 2").withColumn("bound", bound).filter(F.col("bound") >= LEAST_WEIGHT - 1e-9)
    heaviest = heaviest.orderBy(F.desc("bound"), "word").limit(WORDS)  # the model has no more words
    return {r["word"]: (r["harmless"], r["toxic"]) for r in heaviest.collect()}, grams, size


def word_weights(words: dict[str, tuple[int, int]], size: tuple[int, int]) -> dict[str, float]:
    """Lower bounds of log odds (1.64 standard errors), the greatest ``WORDS`` of them."""
    found = {}
    for word, (harmless, toxic) in words.items():
        odds = math.log((toxic + 0.5) / (size[1] + 1)) - math.log((harmless + 0.5) / (size[0] + 1))
        bound = odds - 1.64 * math.sqrt(1 / (toxic + 0.5) + 1 / (harmless + 0.5))
        if bound >= LEAST_WEIGHT and len(word) > 2:
            found[word] = bound
    return dict(sorted(found.items(), key=lambda item: (-item[1], item[0]))[:WORDS])


def fit_logistic(features: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Newton steps with a small ridge; the intercept starts at the share of toxic texts."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(3)
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - toxic) + ridge @ w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    rows = stored(labelled(docs, labels, learn), "labelled-texts")  # read for the words and for the features
    words, grams, size = word_evidence(rows)
    weights = word_weights(words, size)
    corpus = interpolated(grams)
    if weights:
        own = interpolated(gram_counts(list(weights)))
        corpus = (1 - LEXICON_SHARE) * corpus + LEXICON_SHARE * own
    base = size[1] / max(1, sum(size))
    flat = (math.log(base / (1 - base)) if 0 < base < 1 else (-math.inf if base == 0 else math.inf), 0.0, 0.0)
    model = Model(weights, np.log(corpus), flat)
    if not weights or not 0 < base < 1:
        return model

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch])):
                found = model.features(part)
                yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1]), part.table.column("toxic")], names=["greatest", "total", "toxic"])

    table = rows.mapInArrow(featured, "greatest double, total double, toxic int")
    table = table.groupBy("greatest", "total", "toxic").count().orderBy("greatest", "total", "toxic").toArrow()  # three numbers for each distinct pair of features
    times = table.column("count").to_numpy()
    pairs = np.column_stack([table.column("greatest").to_numpy(), table.column("total").to_numpy()])
    model.logistic = fit_logistic(np.repeat(pairs, times, axis=0), np.repeat(table.column("toxic").to_numpy(), times))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``docs``."""
    model = fit(docs, labels, learn)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(iter([batch]), 1 << 20):
                scores = model.scores(model.features(part))
                yield pa.record_batch([part.table.column("doc_id"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id bigint, score double, predicted int")


def restored_text(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, restored)``: every word and every run of single characters decoded, words joined by a space."""

    def restore(text: str | None) -> str:
        out, run = [], []
        for word in [*re.findall(r"[^\x20\x09-\x0D]+", text or ""), ""]:
            if len(word) == 1 and word.isascii():
                run.append(word)
                continue
            if run:
                out.append(model.channel.decode(folded(" ".join(run))) if len(run) > 2 else " ".join(run).lower())
                run = []
            out.append(restored_word(model.channel, word))
        return " ".join(w for w in out if w)

    def all_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([restore(t) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.record_batch([batch.column("doc_id"), texts], names=["doc_id", "restored"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(all_texts, "doc_id bigint, restored string")
