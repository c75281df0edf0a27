import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauselake.llm import toxicity
from clauselake.llm.registered import QUERIES
from clauselake.llm.toxicity import OTHER, SPACE, SYMBOLS, Channel, Model, gram_counts, interpolated, score_documents

WORDS = ["idiot", "trash", "moron", "scum", "loser", "worthless"]
PLAIN = "the river runs over the old stones and a light wind moves through tall grass near our small house"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def model():
    corpus = interpolated(gram_counts([PLAIN, " ".join(WORDS)]))
    lexicon = interpolated(gram_counts(WORDS))
    return Model({w: 5.0 for w in WORDS}, np.log(0.8 * corpus + 0.2 * lexicon), (-3.0, 0.5, 0.5))


def cost_of(channel: Channel, choice) -> tuple[float, str]:
    """Cost of one path through a lattice, and what it writes."""
    state, cost, letters = (SPACE,) * 3, 0.0, ""
    for letter, price in [*choice, (" ", 0.0)]:
        cost += price
        symbol = SPACE if letter == " " else OTHER if letter == "#" else ord(letter) - 97 if letter else -1
        if symbol >= 0 and not (symbol == SPACE and state[2] == SPACE):
            cost -= channel.logs[int(np.dot([*state, symbol], [SYMBOLS**3, SYMBOLS**2, SYMBOLS, 1]))]
            state, letters = (*state[1:], symbol), letters + letter
    return cost, letters.strip()


@pytest.mark.parametrize("text", ["1d1ot", "tr@sh!", "m00r0n", "s.c.u", "a1!b", "lo$$er", "x y", "||"])
def test_viterbi_is_the_least_path(model, text):
    paths = [cost_of(model.channel, choice) for choice in product(*Channel.lattice(text))]
    least = min(paths)[0]
    assert model.channel.decode(text) in {written for cost, written in paths if cost <= least + 1e-9}


def test_probabilities_sum_to_one():
    assert np.allclose(interpolated(gram_counts([PLAIN])).reshape(-1, SYMBOLS).sum(axis=1), 1)


def test_tricks_are_restored(model):
    swaps, draw = {"i": "1!|", "o": "0", "a": "@4", "s": "$5", "t": "7+", "e": "3", "l": "1"}, random.Random(5)
    for word in WORDS:
        for _ in range(30):
            tricked = "".join(draw.choice(swaps[c]) if c in swaps and draw.random() < 0.4 else c * draw.choice([1, 1, 1, 3]) for c in word)
            assert model.weighted(tricked + draw.choice(["", ".", ",", "?"])) == (word,), tricked
        for separator in ".-_*~":
            assert model.weighted(separator.join(word)) == (word,)
        assert model.spaced(" ".join(word)) == (word,)
        assert model.weighted(word.upper()) == (word,)


def test_harmless_words_stay(model):
    for word in PLAIN.split() + ["a$$$", "100", "1984", "co2", "www.site.org", "i", "-", "$$$", "über", "naïve", "rash", "morons0"]:
        assert not [w for w in model.weighted(word) if w not in word]
    assert model.spaced("a b c d e f") == () and model.weighted("trash/old") == ("trash",) and model.weighted("trash|old") == ("trash",)


def training(count=600):
    draw = random.Random(2)
    rows, labels = [], []
    for i in range(count):
        words = [draw.choice(PLAIN.split()) for _ in range(30)]
        if i % 4 == 0:
            words[draw.randrange(30)] = draw.choice(WORDS)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


def test_cases(spark, frame):
    rows, labels = training()
    cases = [
        (1000, "the old 1d10t near our house"), (1001, "grass m o r o n wind"), (1002, None), (1003, ""), (1004, "the old house"),
        (1005, "wind " * 400_000 + "tr@@@sh"), (1005, "the old house"), (None, "you scum"), (1006, "the old 1d10t near our house"),
        (1007, "​ \x00 ퟿ \U0001f600 " + "x " * 5000), (1008, "idiot"),
    ]
    docs = spark.createDataFrame([(*r, 1.0, 7) for r in rows + cases], "doc_id bigint, text string, score double, toxic int")
    marks = spark.createDataFrame([*labels, (1008, 1, 0), (1, 0, None), (None, 1, 1), (5, 1, None)], LABELS)
    found = [(r["doc_id"], r["predicted"], r["score"]) for r in score_documents(docs, marks, F.col("doc_id") < 1000).collect()]
    assert len(found) == len(rows + cases) and all(0 <= s <= 1 and p == int(s >= 0.3) for _, p, s in found)
    assert all(p == labels[i][2] for i, p, _ in found if i is not None and i < 1000)
    flagged = {i: p for i, p, _ in found if i is None or i >= 1000 and i != 1005}
    assert flagged == {1000: 1, 1001: 1, 1002: 0, 1003: 0, 1004: 0, None: 1, 1006: 1, 1007: 0, 1008: 1}
    assert sorted(p for i, p, _ in found if i == 1005) == [0, 1]


def test_no_labels(spark, frame):
    docs = frame([(1, "idiot"), (2, None)])
    empty = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in score_documents(docs, empty, F.lit(True)).collect()] == [0, 0]
    assert score_documents(docs.limit(0), empty, F.lit(True)).count() == 0
    only = spark.createDataFrame([(1, 1, 1)], LABELS)
    assert {r["predicted"] for r in score_documents(docs, only, F.lit(True)).collect()} == {1}


def test_restored_text(frame, model):
    found = {r["doc_id"]: r["restored"] for r in toxicity.restored_text(frame([(1, "You  1d10t,\ns c u m now"), (2, None)]), model).collect()}
    assert found[2] == "" and found[1].split()[1:3] == ["idiot", "scum"]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    scored = QUERIES["op13_noisy_channel"](spark, folder).filter("held_out")
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("toxic", "predicted", "score").collect()
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    assert sum(clean) <= 0.05 * len(clean) and sum(toxic) >= 0.6 * len(toxic)  # five of 14 hold no insult
