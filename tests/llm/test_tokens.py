import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from clauselake.llm.common import Slice
from clauselake.llm.hidden_markov import score_documents
from clauselake.llm.near_dedup import near_duplicates
from clauselake.llm.substrings import remove_repeated_windows
from clauselake.llm.tokens import Words


def thue_morse(letters: str, doublings: int) -> str:
    word = letters[0]
    for _ in range(doublings):
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


PLAIN, TURNED = thue_morse("ab", 10), thue_morse("ba", 10)  # equal under every polynomial modulo 2**64 with odd base
AROUND = [f"w{i}" for i in range(19)]
PAIR = [(1, " ".join([*AROUND, PLAIN])), (2, " ".join([*AROUND, TURNED]))]


def test_hashes_tell_words_apart():
    words = ["", "a", "aa", "a" * 8, "a" * 9, "a" * 16, "a" * 255, "a" * 256, "a" * 257, "a" * 300, PLAIN, TURNED, "é", "\x00", "\x00\x00", "A"]
    part = Slice(pa.table({"text": [" ".join(words), None, "a aa", "A"]}))
    own, low = Words(part).hashes(), Words(part, lower=True).hashes()
    assert len(np.unique(own[:15])) == 15 and own[15:17].tolist() == own[:2].tolist()
    assert own[17] == own[14] and low[17] == low[15] == own[0]
    short = thue_morse("ab", 7), thue_morse("ba", 7)  # within the length that is hashed by blocks
    assert len(set(Words(Slice(pa.table({"text": list(short)}))).hashes().tolist())) == 2


def test_windows_with_regular_words(frame):
    found = {r["doc_id"]: r["n_removed"] for r in remove_repeated_windows(frame(PAIR)).collect()}
    assert found == {1: 0, 2: 0}


def test_unknown_regular_word(frame, spark):
    docs = frame([*PAIR, *[(10 + i, "w1 w2 w3") for i in range(20)]])
    found = {r["doc_id"]: r["n_known"] for r in score_documents(docs, F.col("doc_id") != 2).collect()}
    assert found[2] == 20


def test_near_copies_with_regular_words(frame):
    rows = [(1, " ".join([PLAIN] * 40)), (2, " ".join([TURNED] * 40))]
    assert {r["class_id"] for r in near_duplicates(frame(rows)).collect()} == {1, 2}
