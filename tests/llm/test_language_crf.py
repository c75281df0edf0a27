import zlib

from pyspark.sql import functions as F

from clauselake.llm import language_crf
from clauselake.llm.registered import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op1_crf_language"](spark, folder).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in truth}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def learned(frame):
    english = ["the house and the garden of the man", "this is what they think about that", "where were those things when"]
    german = ["der hund und die katze schlafen nicht", "ich möchte ein großes stück kuchen", "zwischen den häusern steht ein baum"]
    rows = [(i, f"{english[i % 3]} {english[(i + 1) % 3]}", "en") for i in range(30)] + [(100 + i, f"{german[i % 3]} {german[(i + 2) % 3]}", "de") for i in range(30)]
    return rows


def test_code_switched_text(frame):
    rows = learned(frame) + [(900, "the house and the garden of the man zwischen den häusern steht der hund und die katze", None)]
    found = language_crf.identify(frame(rows, "doc_id bigint, text string, lang string"), F.lit(True), F.lit(False))
    runs = next(r["runs"] for r in found.collect() if r["doc_id"] == 900)
    assert [r["lang"] for r in runs] == ["en", "de"] and abs(runs[0]["stop"] - 8) <= 1 and runs[-1]["stop"] == 17


def test_cases(frame):
    rows = learned(frame) + [
        (200, None, "en"), (201, "", "de"), (202, "123 ... 4!", "en"), (203, "… — ½", None), (None, "der hund und die katze", None), (204, "the man", None),
        (204, "the man", None), (205, "die katze " * 9000, None),
    ]
    docs = frame([(*r, 1) for r in rows], "doc_id bigint, text string, lang string, score int")
    found = language_crf.identify(docs, F.col("doc_id") < 200, F.col("doc_id") == 204).collect()
    assert len(found) == len(rows)
    got = {r["doc_id"]: (r["lang_pred"], r["held_out"]) for r in found}
    assert [got[i] for i in (200, 201, 202, 203)] == [("und", False)] * 4
    assert got[None] == ("de", False) and got[204] == ("en", True) and got[205] == ("de", False)
    assert all(r["score"] == 0 for r in found if r["lang_pred"] == "und")
    nothing = language_crf.identify(docs, F.lit(False), F.lit(False)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert language_crf.identify(docs.limit(0), F.lit(True), F.lit(False)).collect() == []
