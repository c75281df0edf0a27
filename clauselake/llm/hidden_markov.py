"""Language model: a hidden Markov model over word classes, trained by Baum-Welch over all partitions.

A word belongs to one of ``classes`` classes by its hash; the model is P(text) = P(class sequence) * product of
P(word | class). The class sequence, with an end symbol, has ``states`` latent states. Expected counts of a full
Baum-Welch step are gathered by every task over its documents and summed in Spark; their size is states * classes
whatever the corpus holds. P(word | class) = (c + 0.5) / (N_class + 0.5 * (V_class + 1)) rests on the exact counts of all
training words, unknown words sharing one half count. Counts are summed per shard of the words' 64-bit hashes and sent
back to the groups of documents that asked for them. The score is the scaled forward recursion over the whole text.

Baum-Welch starts from random emissions that break the symmetry of the states; ``START_STEPS`` and then ``passes`` full
steps follow, each over all training documents.

Defined results: null and empty texts consist of the end alone; rows with a null doc_id are learned from; repeated rows
count each; without training documents all counts are 0; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.chain import Layout, backward, forward, pair_counts, per_sequence
from clauselake.llm.common import GROUP_BYTES, gathered, pack, shares, slices, stored, text_bytes, unpack, with_group
from clauselake.llm.tokens import Words

STATES, CLASSES = 8, 4096
START_STEPS = 3
BUCKET_BYTES = 64 << 20
FAN_IN = 1024  # tasks whose expected counts are summed first
ASKED = "bucket int, grp int, payload binary"
ANSWERED = "kind int, part int, bucket int, payload binary"
RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def word_hashes(table: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
    """Slices with the hashes and numbers of their lower-cased words."""
    for part in slices(table if isinstance(table, pa.Table) else iter([table])):
        words = Words(part, lower=True)
        yield part, words.hashes(), words.counts


def class_of(hashes: np.ndarray, classes: int) -> np.ndarray:
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64) % classes


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(33)).astype(np.int64) % buckets


def symbols(hashes: np.ndarray, counts: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token with the end symbol behind each text, and the tokens per text."""
    return np.insert(class_of(hashes, classes), np.cumsum(counts), classes), counts + 1


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def random(cls, states: int, frequencies: np.ndarray, seed: int) -> Model:
        draws = np.random.default_rng(seed)
        emit = frequencies * draws.gamma(2.0, size=(states, len(frequencies)))
        move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Model:
        """Maximisation; columns are the symbols, then the states moved to, then the starts."""
        states = len(counts)
        emit, move, start = counts[:, : -states - 1], counts[:, -states - 1 : -1], counts[:, -1]
        shared = emit.sum(0) + 0.5  # the common distribution, as many counts as there are symbols, steadies small corpora
        emit = emit + shared / shared.sum() * (emit.shape[1] + 0.01 * emit.sum(1, keepdims=True))
        move, start = move + 0.1, start + 0.1
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def expected(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected counts of a Baum-Welch step over some texts."""
        layout = Layout(lengths)
        symbol = tokens[layout.source]
        weights = self.emit.T[symbol]
        ahead, scales = forward(layout, weights, self.start, self.move)
        back = backward(layout, weights, scales, self.move, np.ones(len(self.start)))
        moved = pair_counts(layout, ahead, back, weights, scales, self.move)
        posterior = ahead * back
        size = self.emit.shape[1]
        emitted = np.stack([np.bincount(symbol, weights=posterior[:, k], minlength=size) for k in range(len(self.start))])
        began = posterior[: layout.active[0]].sum(axis=0) if len(layout.active) else np.zeros(len(self.start))
        return np.concatenate([emitted, moved, began[:, None]], axis=1)

    def log10(self, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Exact log10 probability of each symbol sequence."""
        layout = Layout(lengths)
        _, scales = forward(layout, self.emit.T[tokens[layout.source]], self.start, self.move)
        return per_sequence(layout, np.log10(scales))


def start_model(learned: DataFrame, states: int, classes: int, seed: int) -> Model:
    """A model from START_STEPS full steps; they begin at even frequencies, which cancel in the posteriors of the states."""
    model = Model.random(states, np.ones(classes + 1), seed)
    for _ in range(START_STEPS):
        model = baum_welch(learned, model, classes)
    return model


def baum_welch(learned: DataFrame, model: Model, classes: int) -> Model:
    """One step over all documents: each task sums its expected counts, Spark sums those of the tasks by state.

    The sums of ``FAN_IN`` tasks meet first, so no group gathers a vector from every task.
    """

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for table in gathered(batches):
            for _, hashes, counts in word_hashes(table):
                own = model.expected(*symbols(hashes, counts, classes))
                total = own if total is None else total + own
        if total is not None:
            branch = TaskContext.get().partitionId() // FAN_IN
            yield pa.record_batch({
                "state": pa.array(range(len(total)), pa.int32()), "branch": pa.array([branch] * len(total), pa.int32()),
                "counts": pa.array([row.tobytes() for row in total], pa.binary()),
            })

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(len(table.column("counts")[0].as_py()) // 8)
        for counts in table.column("counts"):
            total += np.frombuffer(counts.as_py(), np.float64)
        return table.slice(0, 1).select(["state", "branch"]).append_column("counts", pa.array([total.tobytes()], pa.binary()))

    shape = "state int, branch int, counts binary"
    summed = learned.select("text").mapInArrow(expect, shape)
    for keys in (["state", "branch"], ["state"]):
        summed = summed.groupBy(*keys).applyInArrow(add, shape)
    rows = sorted((r["state"], bytes(r["counts"])) for r in summed.collect())  # one row per state
    return Model.from_counts(np.stack([np.frombuffer(c, np.float64) for _, c in rows])) if rows else model


def asked(table: pa.Table, buckets: int) -> pa.Table:
    """The distinct words of a group of documents with their training counts, by bucket."""
    found, trained = [], []
    for part, hashes, counts in word_hashes(table):
        found.append(hashes)
        trained.append(np.repeat(part.column("train", False).astype(bool), counts))
    hashes, trained = np.concatenate(found), np.concatenate(trained)
    distinct, place = np.unique(hashes, return_inverse=True)
    counts = np.bincount(place, weights=trained, minlength=len(distinct)).astype(np.int64)
    bucket = bucket_of(distinct, buckets)
    order = np.argsort(bucket, kind="stable")
    pieces = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
    return pa.table({
        "bucket": pa.array([int(bucket[p[0]]) for p in pieces], pa.int32()),
        "grp": pa.array([table.column("grp")[0].as_py()] * len(pieces), pa.int32()),
        "payload": pa.array([pack(distinct[p], counts[p].astype(np.int32)) for p in pieces], pa.binary()),
    })


def answered(table: pa.Table, classes: int) -> pa.Table:
    """Counts of a bucket's words: kind 0 for each asking group, kind 1 the sums by class."""
    held = [unpack(v) for v in table.column("payload").to_pylist()]
    distinct, place = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate([c for _, c in held]), minlength=len(distinct)).astype(np.int64)
    kind = class_of(distinct, classes)
    sums = pack(np.bincount(kind, weights=counts, minlength=classes).astype(np.int64), np.bincount(kind, weights=counts > 0, minlength=classes).astype(np.int64))
    ends = np.cumsum([len(h) for h, _ in held])
    bucket = table.column("bucket")[0].as_py()
    parts = [*table.column("grp").to_pylist(), bucket % 64]
    payloads = [*(pack(counts[place[e - len(h) : e]]) for e, (h, _) in zip(ends, held, strict=True)), sums]
    return pa.table({
        "kind": pa.array([0] * len(held) + [1], pa.int32()), "part": pa.array(parts, pa.int32()),
        "bucket": pa.array([bucket] * len(parts), pa.int32()), "payload": pa.array(payloads, pa.binary()),
    })


def added(table: pa.Table) -> pa.Table:
    total = [sum(column) for column in zip(*(unpack(v) for v in table.column("payload").to_pylist()), strict=True)]
    return pa.table({"part": table.column("part").slice(0, 1), "payload": pa.array([pack(*total)], pa.binary())})


def score_documents(
    docs: DataFrame, learn: Column, states: int = STATES, classes: int = CLASSES, passes: int = 2, seed: int = 11
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    ``learn`` says which rows the model learns from. ``base_score`` is the unigram score with additive smoothing.
    """
    size = text_bytes(docs)
    buckets = shares(size, BUCKET_BYTES)
    rule = F.coalesce(learn, F.lit(True))
    grouped = with_group(docs, shares(size, GROUP_BYTES)).withColumn("train", rule)
    learned = docs.filter(rule).select("doc_id", "text")
    model = start_model(learned, states, classes, seed)
    for _ in range(passes):
        model = baum_welch(learned, model, classes)
    replies = grouped.groupBy("grp").applyInArrow(lambda t: asked(t, buckets), ASKED)
    replies = stored(replies.groupBy("bucket").applyInArrow(lambda t: answered(t, classes), ANSWERED), "word-counts")
    sums = replies.filter("kind = 1").groupBy("part").applyInArrow(added, "part int, payload binary").collect()  # 64 rows at most
    class_tokens, class_words = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for row in sums:
        tokens, distinct = unpack(row["payload"])
        class_tokens, class_words = class_tokens + tokens, class_words + distinct
    ends = learned.count()
    total, vocabulary = int(class_tokens.sum()) + ends, int(class_words.sum()) + (ends > 0)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return scored(left, right, model, classes, buckets, class_tokens, class_words, ends, total, vocabulary)

    known = replies.filter("kind = 0").select(F.col("part").alias("grp"), "bucket", "payload")
    return grouped.groupBy("grp").cogroup(known.groupBy("grp")).applyInArrow(score, RESULT)


def scored(docs, replies, model, classes, buckets, class_tokens, class_words, ends, total, vocabulary) -> pa.Table:
    """The scores of one group of documents."""
    found = list(word_hashes(docs))
    distinct, place = np.unique(np.concatenate([h for _, h, _ in found]) if found else np.zeros(0, np.uint64), return_inverse=True)
    counts, bucket = np.zeros(len(distinct), np.int64), bucket_of(distinct, buckets)
    for b, payload in zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist(), strict=True):
        counts[bucket == b] = unpack(payload)[0]
    kind = class_of(distinct, classes)
    base = np.log10((counts + 0.5) / (total + 0.5 * (vocabulary + 1)))
    inside = np.log10((counts + 0.5) / (class_tokens[kind] + 0.5 * (class_words[kind] + 1)))
    end_base = np.log10((ends + 0.5) / (total + 0.5 * (vocabulary + 1)))
    out, at = [], 0
    for part, hashes, words in found:
        here = place[at : at + len(hashes)]
        at += len(hashes)
        row = np.repeat(np.arange(part.rows), words)

        def added_up(values, row=row, rows=part.rows):
            return np.bincount(row, weights=values, minlength=rows)

        out.append(pa.table({
            "doc_id": part.table.column("doc_id"),
            "held_out": ~part.column("train", False).astype(bool),
            "n_tokens": words.astype(np.int64) + 1,
            "n_known": added_up(counts[here] > 0).astype(np.int64) + (ends > 0),
            "train_tokens": np.full(part.rows, total, np.int64),
            "base_score": added_up(base[here]) + end_base,
            "score": added_up(inside[here]) + model.log10(*symbols(hashes, words, classes)),
        }))
    return pa.concat_tables(out)
