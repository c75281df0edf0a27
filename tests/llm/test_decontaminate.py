import random

from clauselake.llm import decontaminate


def fixture():
    draws = random.Random(4)
    word = lambda: draws.choice(["Ab", "ab", "éa", "É", "x1", "7", "qu", "zz"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([20, 5, 13, 1, 14, 20])]
    items += [(6, items[0][1]), (7, None), (8, ""), (9, "?!"), (None, items[2][1])]
    rows = [(i, f"{' '.join(word() for _ in range(draws.randrange(30)))}. {items[draws.randrange(7)][1]}, {word()}") for i in range(60)]
    rows += [(60, None), (61, ""), (None, rows[0][1]), (0, rows[0][1]), (62, items[0][1][: len(items[0][1]) // 2]), (63, "pad " * 4000 + items[4][1])]
    return rows, items


def judged(frame, rows, items, **settings):
    found = decontaminate.judge(frame(rows), frame(items, "item_id bigint, text string"), **settings)
    return sorted(str(r) for r in found.select("doc_id", "n_words", "n_hit", "item_ids", "spans", "contaminated").collect())


def test_joined_equals_broadcast(frame):
    rows, items = fixture()
    assert judged(frame, rows, items) == judged(frame, rows, items, broadcast_windows=0)


def test_rule_and_cases(frame):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [
        (1, "ONE-two three Four five six seven eight nine ten eleven twelve thirteen!"), (2, item[4:]), (3, item[:30]), (4, None), (5, "short item"),
        (6, "pad " * 300 + item), (7, "pad " * 200 + item), (None, item),
    ]
    found = decontaminate.judge(frame(rows), frame([(10, item), (9, "Short ITEM"), (8, None)], "item_id bigint, text string"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"], r["contaminated"]) for r in found.collect()}
    assert got[1] == (13, 13, ["10"], True) and got[2] == (13, 13, ["10"], True) and got[3][1:] == (0, [], False)
    assert got[4] == (0, 0, [], False) and got[5] == (2, 2, ["9"], True)
    assert got[6] == (314, 14, ["10"], False) and got[7] == (214, 14, ["10"], True) and got[None][3]


def test_removal_keeps_clashing_columns(frame):
    docs = frame([(1, "a b", 5, "w"), (2, None, 6, "v")], "doc_id bigint, text string, words int, spans string")
    items = frame([(1, "zz")], "item_id bigint, text string")
    assert sorted(map(tuple, decontaminate.remove_contaminated(docs, items).collect())) == [(1, "a b", 5, "w"), (2, None, 6, "v")]
    assert decontaminate.remove_contaminated(docs.limit(0), items).collect() == []
    assert decontaminate.remove_contaminated(docs, items.limit(0)).count() == 2
