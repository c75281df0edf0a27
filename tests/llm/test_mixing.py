import numpy as np
import pytest

from clauselake.llm import mixing
from clauselake.llm.registered import QUERIES


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, ceiling=2.0):
    """Reshare the excess by weight until no source is above its ceiling."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if target[s] > ceiling * sizes[s]]
        if not above:
            return capped | target
        capped |= {s: ceiling * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, "c": 5, "Z": 40, None: 60}, {"one": 7}, {"é": 500, "z": 1, "a": 1, "b": 300},
])
def test_targets(frame, sizes):
    rows = [(s, v) for s, v in sizes.items()]
    found = mixing.source_targets(frame(rows, "source string, size bigint"), (3, 1, 2), 1.5, 2.0).collect()
    expected = brute_targets(sizes)
    assert {r["source"]: pytest.approx(r["target"]) for r in found} == expected


@pytest.mark.parametrize("land", [False, True])
def test_flight_balances(land):
    draws = np.random.default_rng(5)
    sizes = draws.lognormal(5, 1, 800).round().tolist()
    chances = mixing.flight(sizes, [0.3] * 800, np.random.default_rng(1), land)
    open_ones = [p for p in chances if 0 < p < 1]
    assert len(open_ones) <= (0 if land else 2)
    assert abs(np.dot(sizes, chances) - 0.3 * sum(sizes)) <= (1e-6 * sum(sizes) if not land else np.median(sizes))
    assert abs(sum(chances) - 240) < (1e-6 if not land else 25)


def test_inclusion_chances_hold():
    sizes, hits = [5.0, 9.0, 1.0, 30.0, 12.0, 7.0], np.zeros(6)
    for seed in range(4000):
        hits += mixing.flight(sizes, [0.4] * 6, np.random.default_rng(seed), False)
    assert np.abs(hits / 4000 - 0.4).max() < 0.04


def test_query(spark, sf):
    rows = QUERIES["op4_cube_mix"](spark, sf).collect()
    assert sorted(rows) == sorted(QUERIES["op4_cube_mix"](spark, sf).collect())
    texts = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len((r["text"] or "").encode().split()) for i, r in texts.items()}
    sizes = {}
    for r in rows:
        sizes[texts[r["doc_id"]]["source"]] = sizes.get(texts[r["doc_id"]]["source"], 0) + r["size"]
    targets, taken = brute_targets(sizes), {}
    for r in rows:
        source = texts[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(targets[source])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source] = taken.get(source, 0) + r["taken"]
    # Ten documents a source: no choice of whole documents comes nearer for certain than half of the largest one.
    largest = {s: max(len((r["text"] or "").split()) for r in texts.values() if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= 0.05 * targets[s] + largest[s] / 2 for s in sizes), [(taken[s], targets[s], largest[s]) for s in sizes]


def test_chunks_and_cases(frame):
    rows = [(i, "w " * (1 + i * 7919 % 50), "s" if i % 3 else None) for i in range(3000)]
    rows += [(None, "a b c", "t"), (None, None, "t"), (5, "", "u"), (5, "", "u"), (7, "x y", "t"), (7, "x y", "t")]
    docs = frame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix_sources(docs, chunk_rows=64).collect()
    assert len(found) == len(rows)
    assert all(r["taken"] == r["size"] * r["times"] and 0 <= r["times"] <= 2 for r in found)
    for source in ("s", None):
        own = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) < 60
    empty = docs.limit(0)
    assert mixing.mix_sources(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
    named = docs.withColumns({"size": docs["doc_id"], "rank": docs["source"]})
    assert mixing.mix_sources(named).count() == len(rows)


def test_equal_rows_spread_over_chunks(frame):
    docs = frame([(5, "a b c", "s")] * 3000 + [(None, None, "s")] * 10 + [(9, "d e", "t")], "doc_id bigint, text string, source string")
    found = mixing.mix_sources(docs, chunk_rows=64).collect()
    assert len(found) == 3011
    own = [r for r in found if r["doc_id"] == 5]
    assert len(own) == 3000 and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 60
    assert len({r["times"] for r in own}) <= 2


def test_added_columns_with_clashing_names(frame, tmp_path):
    rows = [(i, "w " * (1 + i % 7), "s" if i % 3 else None, 5, "x", 1) for i in range(60)]
    docs = frame(rows, "doc_id bigint, text string, source string, Size int, mix_size string, `a.b` int")
    kept = mixing.mixed_documents(docs)
    assert kept.columns == [*docs.columns, "mix_mix_size", "source_size", "target", "times", "taken"]
    kept.write.parquet(str(tmp_path / "mixed"))
    assert all(r["Size"] == 5 and r["mix_mix_size"] == len(r["text"].split()) and r["taken"] == r["times"] * r["mix_mix_size"] for r in kept.collect())
