import hashlib
import math
import re

import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clauselake.llm import sanitize
from clauselake.llm.registered import QUERIES

# Fixed values of the contract.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    spans = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(spans)


def base_lists(frame, texts):
    found = sanitize.base_spans(frame(enumerate(texts)))
    rows = found.select("doc_id", sanitize.span_list(list(BASE)).alias("spans")).collect()
    return [r["spans"] for r in sorted(rows)]


CASES = [
    None, "", "x", "a@b.c_d@e.f", "é😀 a.b+c@x-y.co.uk, z", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.255", "4111 1111 1111 1111",
    "4111-1111-1111-1112 4111111111111111", "+1 (988) 555-2485 +12 +1234567890123456", "9" * 5000, "a" * 5000, "1." * 3000,
    "x@y.z " * 700, "+1 ... ... 2", "1.1.1.1" * 50, "a@b@c.d@e.f",
]


def test_base_spans_of_cases(frame):
    assert base_lists(frame, CASES) == [brute(t) for t in CASES]


def test_base_spans_of_random_texts(frame):
    texts = []

    @settings(max_examples=300, database=None, suppress_health_check=list(HealthCheck))
    @given(st.text(alphabet="a1279.@+-() %_é", max_size=60))
    def gather(text):
        texts.append(text)

    gather()
    assert base_lists(frame, texts) == [brute(t) for t in texts]


def test_query_against_brute_force(spark, sf):
    rows = QUERIES["op5_disclosure"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert r["spans"].startswith(spans)
        assert [r[f"n_{kind}"] for kind in BASE] == [len(re.findall(rf"\b{kind}:", spans)) for kind in BASE]


def disclosing():
    """Three unlike contexts of one address with a telling name, among other texts."""
    rows = [(i, f"alpha{chr(97 + i)} beta{chr(97 + i)} Zorbinax ann@x.org gamma{chr(97 + i)} the end") for i in range(4)]
    rows += [(10 + i, f"the end of filler {'abcdefghij'[i % 10] * (i + 1)} again") for i in range(40)]
    rows += [(90, "Zorbinax was here"), (91, None), (None, "Zorbinax and bob@y.net"), (None, "Zorbinax and bob@y.net")]
    return rows


def named(rows):
    """(doc_id, text of the span) of all term spans."""
    return {(r["doc_id"], r["text"][s["start"] : s["stop"]]) for r in rows for s in r["term"]}


def test_terms_that_tell_an_entity(frame):
    found = sanitize.find_spans(frame(disclosing()), exposure=0.7).collect()
    assert named(found) == {(0, "Zorbinax"), (1, "Zorbinax"), (2, "Zorbinax"), (3, "Zorbinax"), (90, "Zorbinax"), (None, "Zorbinax")}
    clean = {r["doc_id"]: r["text"] for r in sanitize.sanitize(frame(disclosing()), exposure=0.7).collect()}
    assert clean[0] == "alphaa betaa [TERM] [EMAIL] gammaa the end"
    assert clean[90] == "[TERM] was here" and clean[91] is None and clean[None] == "[TERM] and [EMAIL]"


def test_terms_are_generalised_where_that_suffices(frame, monkeypatch):
    common = [(200 + i, f"Zorb{'abcdefghijkl'[i]}ot among others") for i in range(12)]
    docs = frame([*disclosing(), *common])
    clean = {r["doc_id"]: r["text"] for r in sanitize.sanitize(docs, exposure=0.7).collect()}
    assert clean[0] == "alphaa betaa zorb* [EMAIL] gammaa the end" and clean[90] == "zorb* was here"
    assert clean[200] == "Zorbaot among others"
    monkeypatch.setattr(sanitize, "BROADCAST_TERMS", 0)
    assert {r["doc_id"]: r["text"] for r in sanitize.sanitize(docs, exposure=0.7).collect()} == clean


def test_contexts_of_one_text_give_support(frame):
    part = lambda i: " ".join([f"pre{c}{i}" for c in "abcde"] + ["Zorbinax ann@x.org"] + [f"post{c}{i}" for c in "abcde"])
    part_of = lambda i: part("xyz"[i])
    rows = [(0, " ".join(part_of(i) for i in range(3)))] + [(10 + i, f"filler {'abcdefghij'[i % 10] * (i + 1)} again") for i in range(40)]
    assert named(sanitize.find_spans(frame(rows)).collect()) == {(0, "Zorbinax")}


def test_words_of_any_length_are_context(frame):
    long = "Zorbinax" * 40
    rows = [(i, f"{'abcd'[i] * 9} {long} ann@x.org {'efgh'[i] * 500} done") for i in range(4)]
    rows += [(10 + i, f"done with filler {'abcdefghij'[i % 10] * (i + 1)}") for i in range(40)]
    assert named(sanitize.find_spans(frame(rows)).collect()) == {(i, long) for i in range(4)}


def brute_terms(texts, reach=5, support=3, exposure=0.9):
    """Disclosing terms by their definition, over distinct texts."""
    word = regex.compile(r"\p{L}+")
    distinct = set(texts)
    holds, near, contexts, entity = {}, {}, {}, {}
    for text in distinct:
        words = [(m.start(), m.end(), m[0].lower()) for m in word.finditer(text or "")]
        for t in {w for _, _, w in words}:
            holds.setdefault(t, set()).add(text)
        for span in filter(None, brute(text).split(",")):
            kind, start, stop = span.split(":")
            start, stop = int(start), int(stop)
            value = (kind, text[start:stop].lower())
            entity.setdefault(value, set()).add(text)
            around = [w for w in words if w[0] < start][-reach:] + [w for w in words if w[0] >= stop][:reach]
            context = tuple(w for b, e, w in around if e <= start or b >= stop)
            for t in context:
                near.setdefault((value, t), set()).add(text)
                contexts.setdefault((value, t), set()).add(context)
    n = len(distinct)
    return {
        t for (value, t), held in near.items()
        if len(contexts[value, t]) >= support
        and math.log2(len(held) * n / (len(entity[value]) * len(holds[t]))) >= exposure * math.log2(n / len(entity[value]))
    }


def test_production_parameters_on_derived_documents(spark, sf):
    """Documents of the given table, each fifth with a note that names the account of an address."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    code = F.translate(F.pmod("doc_id", F.lit(35)).cast("string"), "0123456789", "qwertyuiop")
    note = F.concat(F.lit(" account zx"), code, F.lit(" of agent "), F.pmod("doc_id", F.lit(35)).cast("string"), F.lit("@mail.example, thanks"))
    derived = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", note)).otherwise(F.col("text")))
    texts = {r["doc_id"]: r["text"] for r in derived.collect()}
    wanted = brute_terms(texts.values())
    assert len([t for t in wanted if t.startswith("zx")]) >= 5
    rows = sanitize.find_spans(derived).collect()
    word = regex.compile(r"\p{L}+")
    for r in rows:
        text = texts[r["doc_id"]]
        base = [(s["start"], s["stop"]) for kind in BASE for s in r[kind]]
        right = [(m.start(), m.end()) for m in word.finditer(text or "") if m[0].lower() in wanted and not any(b < m.end() and m.start() < e for b, e in base)]
        assert [(s["start"], s["stop"]) for s in r["term"]] == right
    assert sum(len(r["term"]) for r in rows) >= 5


def test_many_spans_in_one_text(frame):
    text = "".join(f"n{i}@x.org and {i % 200}.1.2.3.4.5.6.7 +1 {4000000 + i}000; " for i in range(3000))
    clean = sanitize.sanitize(frame([(1, text), (2, "a@b.c")]), support=10_000).collect()
    spans = sorted((int(b), int(e), k) for k, b, e in (s.split(":") for s in brute(text).split(",")))
    out, at = [], 0
    for begin, stop, kind in spans:
        if begin >= at:
            out.append(text[at:begin] + f"[{kind.upper()}]")
        at = max(at, stop)
    assert {r["doc_id"]: r["text"] for r in clean} == {1: "".join(out) + text[at:], 2: "[EMAIL]"}


def test_joined_terms_equal_broadcast_terms(frame, monkeypatch):
    usual = sorted(map(str, sanitize.sanitize(frame(disclosing()), exposure=0.7).collect()))
    monkeypatch.setattr(sanitize, "BROADCAST_TERMS", 0)
    assert sorted(map(str, sanitize.sanitize(frame(disclosing()), exposure=0.7).collect())) == usual


def test_copies_disclose_nothing(frame):
    found = sanitize.find_spans(frame([(i, "Zorbinax ann@x.org the end") for i in range(9)]))
    assert all(r["term"] == [] for r in found.collect())


def test_extra_columns_with_clashing_names(frame):
    rows = [(i, t, "t", "w", 3, "en") for i, t in disclosing()]
    docs = frame(rows, "doc_id bigint, text string, term string, word string, merged int, lang string")
    clean = sanitize.sanitize(docs, exposure=0.7)
    assert clean.columns == docs.columns
    assert {tuple(r)[2:] for r in clean.collect()} == {("t", "w", 3, "en")}
    assert (0, "alphaa betaa [TERM] [EMAIL] gammaa the end") in {tuple(r)[:2] for r in clean.select("doc_id", "text").collect()}
    assert sanitize.sanitize(docs.limit(0)).collect() == []
    assert sanitize.find_spans(docs.limit(0).select("doc_id", "text")).collect() == []
