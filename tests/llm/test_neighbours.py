import numpy as np
import pytest

from clauselake.llm import neighbours
from clauselake.llm.registered import QUERIES

SHAPE = "vec_id bigint, embedding array<float>"


def brute(rows, every, k):
    ids = np.array([i for i, _ in rows])
    points = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        scores = points @ points[q]
        order = [i for i in np.lexsort((ids, -np.round(scores, 12))) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), scores[i]) for i in order]
    return out


def lists(found):
    out = {}
    for r in sorted(found.collect()):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_of_the_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    truth, got = brute(rows, 20, 20), lists(QUERIES["op9_kmeans_tree"](spark, sf))
    assert truth.keys() == got.keys()
    assert sum(len({i for i, _ in truth[q]} & {i for i, _ in got[q]}) for q in truth) >= 0.9 * 20 * len(truth)
    exact = {(q, i): s for q, own in brute(rows, 20, len(rows)).items() for i, s in own}
    for q, own in got.items():
        assert [s for _, s in own] == pytest.approx([exact[q, i] for i, _ in own], abs=1e-12)
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))


def test_common_vector_is_cut_into_chunks(spark, frame, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    draws = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else draws.normal(size=3).astype(np.float32).tolist()) for i in range(240)]
    assert {q: [i for i, _ in own] for q, own in lists(neighbours.nearest(frame(rows, SHAPE), recall=1.0)).items()} == {
        q: [i for i, _ in own] for q, own in brute(rows, 20, 20).items()}


def test_cases(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, []), (20, [2.0, 0.0])]
    assert lists(neighbours.nearest(frame(rows, SHAPE))) == {0: [(20, 2.0), (1, 0.5)], 20: [(0, 2.0), (1, 1.0)]}
    assert neighbours.nearest(frame([], SHAPE)).collect() == []
    assert neighbours.nearest(frame([(1, [1.0])], SHAPE)).collect() == []
    more = frame([(0, [1.0], 4, "x"), (3, [2.0], 5, "y")], SHAPE + ", leaf int, vector string")
    assert lists(neighbours.nearest(more)) == {0: [(3, 2.0)]}
