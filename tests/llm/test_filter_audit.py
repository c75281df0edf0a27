from collections import defaultdict
from itertools import permutations

from clauselake.llm.filter_audit import FILTERS, Diagram, audit, plain_changes

WORDS = " ".join(f"w{i}" for i in range(200))
LABELS = "doc_id bigint, quality int, toxic int, text string"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failed(text: str, is_copy: bool) -> set:
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    flags = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text), any(c in "#$%&*|" for c in text), is_copy]
    return {f for f, on in zip(FILTERS, flags, strict=True) if on}


def expected(rows, labels):
    parts = defaultdict(list)
    for doc_id, text, source in rows:
        text = text or ""
        is_copy = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows)
        good, toxic = (any(l[0] == doc_id and l[i] == 1 for l in labels) and doc_id is not None for i in (1, 2))
        parts[source or ""].append((failed(text, is_copy), good, toxic))
    out = []
    for part, docs in parts.items():
        lost = defaultdict(int)
        for order in permutations(FILTERS):
            left = docs
            for step, f in enumerate(order, start=1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                lost[f] += len(gone)
                out.append([
                    part, "".join(order), step, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone),
                    sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f])
        for row in out:
            if row[0] == part:
                row[-1] = lost[row[-1]] if isinstance(row[-1], str) else row[-1]
    return sorted(map(tuple, out))


def found(df):
    assert df.columns == COLUMNS
    return sorted(tuple(row) for row in df.collect())


def test_swaps_visit_every_order():
    order, seen = list("ABCDE"), {"ABCDE"}
    for i in plain_changes(5):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add("".join(order))
    assert len(seen) == 120


def test_swaps_keep_counts_and_share_nodes():
    counts = {m: (m % 3, m % 2, 0) for m in range(32)}
    diagram = Diagram(counts)
    for level in plain_changes(5):
        diagram.swap(level)
        assert diagram.weights[diagram.root][0] == sum(c[0] for c in counts.values())
    plain = Diagram({m: (1, 0, 0) for m in range(32)})
    assert len(plain.branches) == 7  # empty, one leaf and one node a level: equal subdiagrams are one


def test_all_cases(spark):
    rows = [
        (1, WORDS, "a"), (2, WORDS, "b"), (2, WORDS, "b"), (1, WORDS, "b"), (3, WORDS + " #", "a"), (4, "WORDS " * 300, "a"), (5, None, None),
        (6, "", "a"), (None, "", "a"), (None, WORDS, None), (7, "x\u000by z " * 90, ""), (8, "x " * 400 + "|", "c"), (9, WORDS, "c"),
        (10, "éA\U0001f600" * 40, "c"), (11, "y" * 200_000, "d"), (12, WORDS + "\n", "d"), (-3, "\n", "d"), (13, "\n", "d"),
    ]
    labels = [(2, 1, 0, "x"), (2, 0, 1, "x"), (3, 1, 1, None), (9, None, 1, None), (4, 1, None, None), (None, 1, 1, None), (6, 0, 1, None), (99, 1, 1, None)]
    docs = spark.createDataFrame([(*r, 1, False) for r in rows], "doc_id bigint, text string, source string, mask int, good boolean")
    assert found(audit(docs, spark.createDataFrame(labels, LABELS))) == expected(rows, labels)


def test_given_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    assert found(audit(docs, labels)) == expected(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert audit(docs, spark.createDataFrame([], LABELS)).count() == 0
