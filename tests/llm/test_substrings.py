import random

import pytest

from clauselake.llm import substrings

SPACES = " \t\n\x0b\x0c\r"


def brute(rows, window):
    """(doc_id, text) -> (n_words, n_removed, kept text); rows without id keep everything."""
    seen = {}
    split = lambda text: (text or "").encode().split()
    for doc_id, text in rows:
        words = split(text)
        for i in range(len(words) - window + 1):
            if doc_id is not None:
                gram = tuple(words[i : i + window])
                seen[gram] = min(seen.get(gram, (doc_id, i)), (doc_id, i))
    out = []
    for doc_id, text in rows:
        words = split(text)
        gone = set()
        for i in range(len(words) - window + 1):
            if doc_id is not None and seen[tuple(words[i : i + window])] < (doc_id, i):
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        out.append((doc_id, len(words), len(gone), kept))
    return sorted(out, key=str)


def compare(frame, rows, window):
    found = substrings.remove_repeated_windows(frame(rows), window).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found), key=str) == brute(rows, window)
    for r in found:
        spans = [(s["start"], s["stop"]) for s in r["removed"]]
        assert sum(b - a for a, b in spans) == r["n_removed"]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_documents(frame, seed):
    draws = random.Random(seed)
    passages = [" ".join(draws.choice("abcdé") for _ in range(12)) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [draws.choice([*passages, "x y", " ".join(draws.choice("pqrst") for _ in range(9))]) for _ in range(draws.randrange(5))]
        rows.append((i, draws.choice(SPACES).join(parts)))
    compare(frame, rows, 5)


def test_cases(frame):
    long = " ".join(f"w{i % 97}" for i in range(3000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (5, long), (None, long), (None, "a b c d e f"), (6, "a b c d e f g"),
        (7, "z a b c d e f"), (7, "other text of seven words in all"), (8, "é ü x ñ é ü x ñ é ü x ñ"), (-3, "a b c d e"),
    ]
    compare(frame, rows, 5)


def test_empty_table_and_extra_columns(frame):
    assert substrings.remove_repeated_windows(frame([])).collect() == []
    more = frame([(1, "a b", 3, "x")], "doc_id bigint, text string, grp int, text_hash string")
    assert [(r["doc_id"], r["kept_text"]) for r in substrings.remove_repeated_windows(more).collect()] == [(1, "a b")]
