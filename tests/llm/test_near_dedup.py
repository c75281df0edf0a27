import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clauselake.llm import near_dedup


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def shingled(text):
    words = (text or "").lower().split()
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def brute_classes(rows):
    ids = [i for i, t in rows if i is not None and t is not None]
    texts = {i: [t for j, t in rows if j == i and t is not None] for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in set(ids):
        for j in set(ids):
            if j < i and find(i) != find(j):
                for a in texts[i]:
                    for b in texts[j]:
                        x, y = shingled(a), shingled(b)
                        n = sum((Counter(x) & Counter(y)).values())
                        near = n >= 0.8 * (len(x) + len(y)) / 1.8 - 1e-9 and (n := common(x, y)) / max(1, len(x) + len(y) - n) >= 0.8 - 1e-9
                        if a == b or (x and y and near):
                            u, v = find(i), find(j)
                            root[max(u, v)] = min(u, v)
    return {i: find(i) for i in ids}


@settings(max_examples=200, deadline=None, database=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_alignment_equals_full_table(a, b):
    exact = common(a, b)
    assert near_dedup.banded_common(a, b, max(len(a), len(b))) == exact
    similarity = exact / (len(a) + len(b) - exact) if a or b else 0.0
    got = near_dedup.aligned_similarity(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), 0.8)
    assert got == (pytest.approx(similarity) if similarity >= 0.8 - 1e-9 and (a and b) else 0.0)


def documents():
    draws = random.Random(9)
    rows, at = [], 0
    for _ in range(12):
        words = [f"w{draws.randrange(3000)}" for _ in range(draws.choice([6, 40, 150, 400]))]
        rows.append((at, " ".join(words)))
        for _ in range(draws.randrange(5)):
            at += 1
            other = list(words)
            for _ in range(draws.randrange(4)):
                other[draws.randrange(len(other))] = "changed"
            rows.append((at, " ".join(other)))
        at += 1
    rows += [(300, None), (301, None), (302, ""), (303, ""), (None, rows[0][1]), (304, rows[0][1]), (304, rows[0][1]), (305, "three little words"), (306, "Three little WORDS"), (307, "three words little")]
    half = [f"v{i}" for i in range(200)]
    return rows + [(310, " ".join(half)), (311, " ".join(half[100:] + half[:100]))]


def test_classes_against_brute_force(frame):
    rows = documents()
    found = near_dedup.near_duplicates(frame(rows)).collect()
    assert len(found) == len(rows)
    expected = brute_classes(rows)
    assert {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] in expected} == expected
    assert {r["class_id"] for r in found if r["doc_id"] in (300, 301)} == {300, 301}
    assert [r["class_id"] for r in found if r["doc_id"] is None] == [None]


def test_one_document_of_each_class_stays(frame):
    rows = [(*r, "x") for r in documents()] + [(400, "one id", "x"), (400, "two texts", "x")]
    docs = frame(rows, "doc_id bigint, text string, class_id string")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    expected = set(brute_classes([r[:2] for r in rows]).values())
    assert sorted(i for i in ids if i not in (None, 300, 301)) == sorted(expected) and {None, 300, 301} <= set(ids)
    assert near_dedup.keep_one(docs.limit(0)).collect() == []


def test_long_chain_is_one_class(frame):
    edges = frame([(i + 1, i) for i in range(60)] + [(100, 90)], "doc bigint, other bigint")
    assert {r["node"]: r["root"] for r in near_dedup.classes(edges).collect()} == {i: 0 for i in range(1, 61)} | {100: 90}


def test_near_copies_within_shared_boilerplate(frame):
    draws = random.Random(4)
    template = [f"t{i}" for i in range(344)]
    rows = []
    for i in range(40):
        words = template + [f"own{draws.randrange(10**6)}" for _ in range(56)]
        other = list(words)
        for at in draws.sample(range(len(words)), 6):
            other[at] = f"edit{draws.randrange(10**6)}"
        rows += [(i, " ".join(words)), (1000 - i, " ".join(other))]
    expected = brute_classes(rows)
    assert len(set(expected.values())) == 40
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(rows)).collect()} == expected


def boilerplate(share: float, groups: int, seed: int):
    """Texts of 200 words that share a template, each with a near copy."""
    draws = random.Random(seed)
    fixed = int(200 * share)
    template = [f"t{i}" for i in range(fixed)]
    rows = []
    for i in range(groups):
        words = template + [f"own{draws.randrange(10**9)}" for _ in range(200 - fixed)]
        other = list(words)
        for at in draws.sample(range(200), draws.choice([1, 2, 3])):
            other[at] = f"edit{draws.randrange(10**9)}"
        rows += [(i, " ".join(words)), (10_000 - i, " ".join(other))]
    return rows


@pytest.mark.parametrize("share", [0.6, 0.7, 0.8, 0.85, 0.9])
def test_recall_within_large_boilerplate_groups(frame, share):
    """Links of 160 documents in one bucket, on both sides of the threshold: none lost, none made up."""
    rows = boilerplate(share, 80, int(share * 100))
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(frame(rows), whole=8).collect()}
    assert found == brute_classes(rows)


def test_boilerplate_below_the_threshold_makes_no_pairs(frame):
    """Pairs to verify grow with the documents, not with the square of the group."""
    rows = [(i, i, t) for i, t in boilerplate(0.85, 300, 3)]
    pairs = near_dedup.prefix_pairs(frame(rows, "doc_id bigint, root bigint, text string"), 5, 0.8)
    assert {tuple(r) for r in pairs.collect()} >= {(10_000 - i, i) for i in range(300)} and pairs.count() <= 2 * 300


def test_long_texts_align_within_the_band():
    draws = random.Random(8)
    a = [draws.randrange(10**6) for _ in range(60_000)]
    b = [x for x in a if draws.random() > 0.002]
    assert near_dedup.banded_common(a, b, 400) == len(b)
    for _ in range(200):
        x, y = ([draws.randrange(4) for _ in range(draws.randrange(1, 12))] for _ in range(2))
        band = draws.randrange(1, 5)
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                hit = table[i][j] + 1 if x[i] == y[j] and abs(i - j) <= band else 0
                table[i + 1][j + 1] = max(hit, table[i][j + 1], table[i + 1][j])
        assert near_dedup.banded_common(x, y, band) == table[-1][-1]
