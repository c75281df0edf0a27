import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.llm import hidden_markov
from clauselake.llm.registered import QUERIES

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(text):
    return [*(text or "").encode().translate(LOWER).split(), None]


def test_query_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts = Counter(t for i, text in docs.items() if not held[i] for t in tokens(text))
    total, vocabulary = sum(counts.values()), len(counts)
    rows = QUERIES["op7_baum_welch"](spark, sf).collect()
    assert len(rows) == len(docs)
    sums = {True: [0.0, 0.0], False: [0.0, 0.0]}
    for r in rows:
        own = tokens(docs[r["doc_id"]])
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (vocabulary + 1))) for t in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(counts[t] > 0 for t in own), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and -math.inf < r["score"] < 0
        sums[r["held_out"]][0] += r["score"]
        sums[r["held_out"]][1] += base
    assert all(score > base for score, base in sums.values())


def test_model_is_a_distribution():
    draws = np.random.default_rng(0)
    model = hidden_markov.Model.random(3, np.full(4, 0.25), 1)
    model = hidden_markov.Model.from_counts(model.expected(draws.integers(0, 4, 200), np.full(20, 10)))
    pairs = [(a, b) for a in range(4) for b in range(4)]
    logs = model.log10(np.array(pairs).ravel(), np.full(16, 2))
    assert (10**logs).sum() == pytest.approx(1)


def test_steps_raise_the_likelihood():
    draws = np.random.default_rng(3)
    lengths = np.full(40, 25)
    symbols = np.concatenate([draws.integers(0, 5, 25) + 5 * (s % 2) for s in range(40)])
    model = hidden_markov.Model.random(4, np.full(10, 0.1), 2)
    scores = []
    for _ in range(8):
        scores.append(model.log10(symbols, lengths).sum())
        model = hidden_markov.Model.from_counts(model.expected(symbols, lengths))
    assert all(b > a - 1e-6 for a, b in zip(scores, scores[1:], strict=False))
    assert scores[-1] > 40 * 25 * math.log10(0.1) + 200


def test_sums_of_tasks_meet_in_a_tree(spark, frame, monkeypatch):
    docs = frame([(i, " ".join(f"w{(i * 31 + j * j) % 97}" for j in range(20 + i % 9))) for i in range(200)])
    model = hidden_markov.Model.random(3, np.full(33, 1 / 33), 4)
    usual = hidden_markov.baum_welch(docs.coalesce(1), model, 32)
    monkeypatch.setattr(hidden_markov, "FAN_IN", 2)
    tree = hidden_markov.baum_welch(docs.repartition(7), model, 32)
    for name in ("start", "move", "emit"):
        assert np.allclose(getattr(usual, name), getattr(tree, name), rtol=1e-9)


def test_cases(frame):
    rows = [(1, "A b a"), (2, None), (3, ""), (None, "a"), (4, "B " * 5000), (4, "B " * 5000), (5, "new words")]
    learn = F.col("doc_id") != 5
    found = hidden_markov.score_documents(frame([(*r, 1) for r in rows], "doc_id bigint, text string, train int"), learn).collect()
    got = {(r["doc_id"], r["n_tokens"]): (r["held_out"], r["n_known"], r["train_tokens"]) for r in found}
    total = 4 + 1 + 1 + 2 + 5001 * 2
    assert got == {(1, 4): (False, 4, total), (2, 1): (False, 1, total), (3, 1): (False, 1, total), (None, 2): (False, 2, total), (4, 5001): (False, 5001, total), (5, 3): (True, 1, total)}
    assert hidden_markov.score_documents(frame([]), learn).collect() == []
    none = hidden_markov.score_documents(frame([(5, "a b")]), learn).first()
    assert (none["n_known"], none["train_tokens"]) == (0, 0) and none["base_score"] == pytest.approx(0.0)
