import math

import numpy as np
import pytest

from clauselake.llm import hard_negatives
from clauselake.llm.hard_negatives import HIGH, LOW, grouping, mine, products, walk

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, score double"


def expected(rows, every=50):
    """All products of all anchors, by the definition."""
    known = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        row = ([math.floor(256 * float(np.float32(x))) for x in vector], label)
        known[vec_id] = min(known.get(vec_id, row), row)
    out = []
    for anchor, (own, label) in known.items():
        if anchor % every:
            continue
        scored = [(-sum(a * b for a, b in zip(own, v, strict=True)), i, other == label) for i, (v, other) in known.items() if i != anchor]
        scored.sort()
        for positive_score, positive, _ in [s for s in scored if s[2]][:5]:
            fits = [s for s in scored if not s[2] and -50 * positive_score <= -100 * s[0] <= -95 * positive_score]
            out += [(anchor, positive, rank, s[1], -positive_score, -s[0]) for rank, s in enumerate(fits[:3], start=1)]
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(i, v, l, "x", 1.0) for i, v, l in rows], SCHEMA)
    return sorted(tuple(r) for r in mine(df).collect())


def drawn(n, dim, seed, spread=1.0, centres=3):
    draws = np.random.default_rng(seed)
    middle = draws.normal(size=(centres, dim))
    return [(i, [float(x) for x in middle[i % centres] + spread * draws.normal(size=dim)], int(draws.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(hard_negatives, "CLUSTER_ROWS", 2)
    monkeypatch.setattr(hard_negatives, "GROUP", 3)
    rows = drawn(400, 6, 1, spread)
    assert found(spark, rows) == expected(rows)


def test_cases(spark):
    rows = [(i, v, l) for i, v, l in drawn(120, 3, 2)]
    rows += [(i, [0.5, 0.25, -0.125], 2) for i in range(200, 240)]  # ties
    rows += [(150, [0.0, 0.0, 0.0], 1), (250, None, 1), (300, [1.0, None, 0.0], 1), (301, [float("nan"), 0.0, 0.0], 1), (302, [float("inf"), 0.0, 0.0], 1)]
    rows += [(303, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1), (350, [-1.0, 2.0, 0.5], 2), (350, [-1.0, 2.0, 0.5], 2), (400, [1.0, 0.0, 0.0], 9)]
    rows += [(-50, [0.3, 0.2, 0.1], 2), (304, [], 1)]
    assert found(spark, rows) == expected([r for r in rows if r[1] != []])


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
    assert found(spark, [(50, [1.0], 1)]) == []
    assert found(spark, [(50, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2)]) == [(50, 1, 1, 2, 65536, 49152)]


def test_walk_ends_early_and_certified():
    draws = np.random.default_rng(3)
    vectors = np.rint(256 * (np.eye(8)[draws.integers(0, 8, 4000)] + 0.02 * draws.normal(size=(4000, 8)))).astype(np.int64)
    labels, ids = draws.integers(0, 3, 4000), np.arange(4000)
    members = np.flatnonzero(vectors[:, 0] > 128)[:40]
    low, high = np.full((40, 1), LOW), np.full((40, 1), HIGH)
    held, visited = walk(vectors[members], ids[members], labels[members], np.eye(8)[0], (ids, labels, vectors), low, high, True, 5, slab=100)
    assert visited < 40 * 1500
    every = products(vectors[members], vectors)
    every[(labels[members, None] != labels) | (members[:, None] == ids)] = LOW
    for row in range(40):
        best = sorted((-s, i) for i, s in enumerate(every[row].tolist()))[:5]
        assert [(-s, i) for s, i in zip(held.score[held.slot == row].tolist(), held.id[held.slot == row].tolist(), strict=True)] == best


def test_large_components():
    left = np.array([[1 << 30, -(1 << 29)]])
    assert products(left, left).tolist() == [[(1 << 60) + (1 << 58)]]


def test_groups_hold_bounded_numbers():
    assert grouping({0: 3, 1: 4, 2: 20, 3: 1}, 8) == {0: (0, 1), 1: (0, 1), 2: (1, 3), 3: (4, 1)}
