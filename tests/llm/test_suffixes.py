import random

import numpy as np
import pytest

from clauselake.llm import suffixes


def brute(rows, width):
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - width + 1 if doc_id is not None else 0):
            key = data[p : p + width]
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = set()
        for p in range(len(data) - width + 1 if doc_id is not None else 0):
            if first[data[p : p + width]] < doc_id:
                gone.update(range(p, p + width))
        runs = sum(1 for p in gone if p - 1 not in gone)
        out.append((doc_id, len(data), len(gone), runs, bytes(b for p, b in enumerate(data) if p not in gone)))
    return sorted(out, key=str)


def compare(frame, rows, width=50):
    found = suffixes.remove_repeated_bytes(frame(rows), width).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in found), key=str) == brute(rows, width)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_documents(frame, seed):
    draws = random.Random(seed)
    word = lambda: "".join(draws.choice("abeé") for _ in range(draws.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(22)) for _ in range(4)] + ["ab" * 60, "a" * 70, "\0" * 55]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(draws.randrange(6)):
            text = draws.choice(passages)
            cut = draws.randrange(len(text)) if draws.random() < 0.4 else 0
            parts.append(draws.choice([text[cut:], text[: len(text) - cut], word()]))
        rows.append((i, draws.choice(["", " ", "\n"]).join(parts)))
    compare(frame, rows)


def test_cases(frame):
    text = "the quick brown fox jumps over the lazy dog and runs away from it all day long"
    rows = [
        (1, None), (2, ""), (3, text), (4, text), (4, text), (None, text), (5, text[:49]), (6, text[:50]), (7, "x" + text[1:52] + "y"),
        (8, text * 60), (9, "é" * 200), (10, "é" * 30), (11, text + "\n" + text), (-1, text[10:70]),
    ]
    compare(frame, rows)


def test_empty_table_and_extra_columns(frame):
    assert suffixes.remove_repeated_bytes(frame([])).collect() == []
    more = frame([(1, "a b", 3, "x")], "doc_id bigint, text string, grp int, kept string")
    assert [bytes(r["kept"]) for r in suffixes.remove_repeated_bytes(more).collect()] == [b"a b"]


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 7])
def test_loser_tree_merges_with_exact_prefix_lengths(runs):
    draws = np.random.default_rng(runs)
    matrices = [np.array(sorted(map(bytes, draws.integers(0, 3, (int(draws.integers(0, 40)), 6), dtype=np.uint8)))) for _ in range(runs)]
    matrices = [np.frombuffer(b"".join(bytes(x).ljust(6, b"\0") for x in m), np.uint8).reshape(-1, 6) for m in matrices]
    coded = [suffixes.front_coded(m) for m in matrices]
    assert all((suffixes.rebuilt(s, rest, 6) == m).all() for (s, rest), m in zip(coded, matrices, strict=True))
    keys = [[row.tobytes() for row in m] for m in matrices]
    order, lengths = suffixes.merge_runs(keys, [s.tolist() for s, _ in coded])
    fronts = [iter(k) for k in keys]
    merged = [next(fronts[r]) for r in order]
    assert merged == sorted(x for k in keys for x in k)
    for a, b, n in zip(merged, merged[1:], lengths[1:], strict=False):
        assert n == next((i for i in range(6) if a[i] != b[i]), 6)
