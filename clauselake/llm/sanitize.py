"""Personal data: fixed patterns, and terms that disclose a protected entity by corpus co-occurrence.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each distinct value is a protected entity. A
term is disclosing when the corpus shows that meeting it nearly tells the entity. All counts are of distinct texts: with
n texts, n_e and n_t those that hold the entity or the term, and n_et those that hold the term among the ``reach``
words on either side of the entity, PMI = log2(n_et * n / (n_e * n_t)) has to be at least ``exposure`` times the
entity's information content IC = log2(n / n_e), which it can never exceed. Besides, at least ``support`` distinct
contexts have to hold both, so copies alone disclose nothing. Such terms become spans of kind ``term`` wherever they
occur outside base spans.

A disclosing term is generalised where that suffices: to its first ``STEM`` letters and an asterisk, if all terms with
these letters together stay below the exposure for each entity that the term discloses. Otherwise it is removed. A term
of at most ``STEM`` letters is removed.

Only DataFrame functions run. Term frequencies are counted for the terms near entities alone; that set, and the set of
disclosing terms, are broadcast while they have at most ``BROADCAST_TERMS`` rows and joined by shuffles beyond.

Defined results: a null text has no spans and stays null; rows with a null doc_id and repeated rows are treated one by
one; an empty table gives no rows; extra columns are kept; overlapping spans of different kinds are all reported and
redacted as one. Patterns use possessive loops and word-run anchors (``\\G``), so long runs cost linear time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import carried, restored, stored
from clauselake.plans.once import compute_once

# Fixed values of the contract: kinds in order and their patterns, written so that no match attempt is repeated.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
TERM = r"\p{L}+"
BROADCAST_TERMS = 100_000
BLOCK = 256
STEM = 4
REMOVED = "[TERM]"
SPANS = "array<struct<start:int,stop:int,value:string>>"


def located(text: Column, pattern: str) -> Column:
    """Matches with their code point positions: running lengths of the pieces between and of the matches.

    The sums run in blocks, since each step of an ``aggregate`` copies the list it extends.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found,
        lambda gap, value: F.struct(F.char_length(gap).alias("gap"), F.char_length(value).alias("length"), value.alias("value")),
    )
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, BLOCK)
    )
    widths = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, m: acc + m["gap"] + m["length"]))
    offsets = F.aggregate(
        widths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, w: F.struct((acc["at"] + w).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        lambda acc: acc["all"],
    )

    def spans(block: Column, offset: Column) -> Column:
        return F.aggregate(
            block, F.struct(offset.alias("at"), F.array().cast(SPANS).alias("all")),
            lambda acc, m: F.struct(
                (acc["at"] + m["gap"] + m["length"]).alias("at"),
                F.concat(
                    acc["all"],
                    F.array(F.struct(
                        (acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + m["length"]).alias("stop"), m["value"].alias("value"))),
                ).alias("all"),
            ),
            lambda acc: acc["all"],
        )

    return F.when(F.size(found) > 0, F.flatten(F.zip_with(blocks, offsets, spans))).otherwise(F.array().cast(SPANS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        plain = F.ltrim(part, F.lit("0"))
        return (F.length(plain) <= 3) & (F.coalesce(F.substring(plain, 1, 3).try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def weighed(i: Column) -> Column:
        digit = F.substr(digits, i, F.lit(1)).cast("int")
        double = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(double - F.when(double > 9, 9).otherwise(0))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weighed), F.lit(0), lambda acc, d: acc + d)
    return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


CHECKS = {
    "email": lambda value: F.lit(True),
    "ip": _octets,
    "card": _luhn,
    "phone": lambda value: F.length(_digits(value)).between(9, 15),
}
MARKS = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with one column of spans per kind: ``email``, ``ip``, ``card``, ``phone``."""
    digit = F.col("text").rlike("[0-9]")
    found = {}
    for kind, pattern in PATTERNS.items():
        mark = MARKS[kind]
        worth = digit if kind != "email" else F.lit(True)
        worth = worth & F.contains("text", F.lit(mark)) if mark else worth
        found[kind] = F.when(worth, _checked(located(F.col("text"), pattern), CHECKS[kind])).otherwise(F.array().cast(SPANS))
    return compute_once(docs, **found)


def _checked(spans: Column, valid) -> Column:
    return F.filter(spans, lambda s: valid(s["value"]))


def term_list(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda t: F.lower(t))


def mentions(found: DataFrame, reach: int) -> DataFrame:
    """``(kind, value, text_hash, context)``: each base span with the ``reach`` terms on either side.

    The terms of a text are located once, in order; a span takes those around its place in that list, so words of any
    length count whole.
    """
    terms = compute_once(found, __terms=located(F.col("text"), TERM))
    starts = compute_once(terms, __starts=F.transform("__terms", lambda t: t["start"]))

    def side(kind: str) -> Column:
        def one(s: Column) -> Column:
            before = _place(F.col("__starts"), s["start"])  # terms that begin before the span
            after = _place(F.col("__starts"), s["stop"])
            first = F.greatest(before - reach, F.lit(0))
            words = F.concat(F.slice("__terms", first + 1, before - first), F.slice("__terms", after + 1, F.lit(reach)))
            outside = F.filter(words, lambda t: (t["stop"] <= s["start"]) | (t["start"] >= s["stop"]))
            return F.struct(F.lit(kind).alias("kind"), F.lower(s["value"]).alias("value"), F.transform(outside, lambda t: F.lower(t["value"])).alias("context"))

        return F.transform(kind, one)

    every = F.concat(*[side(kind) for kind in PATTERNS])
    return starts.select(F.xxhash64("text").alias("text_hash"), F.inline(every))


def _place(starts: Column, position: Column) -> Column:
    """How many of the ascending ``starts`` are below ``position``: 31 halvings, whatever the length."""
    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        below = F.coalesce(F.get(starts, middle) < position, F.lit(False))
        open_ = span["low"] < span["high"]
        return F.struct(
            F.when(open_ & below, middle + 1).otherwise(span["low"]).alias("low"),
            F.when(open_ & ~below, middle).otherwise(span["high"]).alias("high"),
        )

    begin = F.struct(F.lit(0).alias("low"), F.size(starts).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), begin, halve, lambda span: span["low"])


def disclosing_terms(docs: DataFrame, found: DataFrame, reach: int, support: int, exposure: float) -> DataFrame:
    """``(term, shown)``: the terms that disclose an entity and what replaces them."""
    said = stored(mentions(found, reach), "mentions")
    entities = said.groupBy("kind", "value").agg(F.count_distinct("text_hash").alias("n_e"))
    documents = F.broadcast(docs.select(F.count_distinct(F.xxhash64("text")).alias("n")))  # one row
    uses = said.select("kind", "value", "text_hash", F.xxhash64("context").alias("context_hash"), F.explode(F.array_distinct("context")).alias("term"))
    pairs = (
        uses.groupBy("kind", "value", "term")
        .agg(F.count_distinct("context_hash").alias("contexts"), F.count_distinct("text_hash").alias("n_et"))
        .filter(F.col("contexts") >= support)
    )
    # The texts that hold a term near some entity are a lower bound of n_t: most common terms fail by it alone.
    seen = uses.groupBy("term").agg(F.count_distinct("text_hash").alias("n_t"))
    pairs = pairs.join(entities, ["kind", "value"]).crossJoin(documents)
    pairs = stored(pairs.join(seen, "term").filter(_discloses(exposure)).drop("n_t"), "pairs")
    if pairs.isEmpty():
        return pairs.select("term", F.lit(REMOVED).alias("shown"))
    counted = _texts_with(docs, pairs.select("term").distinct(), "term", lambda t: t)
    pairs = stored(pairs.join(counted, "term").filter(_discloses(exposure)).drop("n_t"), "disclosing")
    stem = lambda t: F.substring(t, 1, STEM)
    longer = pairs.filter(F.char_length("term") > STEM).withColumn("stem", stem(F.col("term")))
    near = (
        uses.withColumn("stem", stem(F.col("term"))).groupBy("kind", "value", "stem").agg(F.count_distinct("text_hash").alias("n_et"))
    )
    whole = _texts_with(docs, longer.select("stem").distinct(), "stem", stem)
    told = (
        longer.drop("n_et").join(near, ["kind", "value", "stem"]).join(whole, "stem")
        .groupBy("term", "stem").agg(F.bool_or(_discloses(exposure)).alias("told"))
    )
    shown = F.when(~F.col("told"), F.concat("stem", F.lit("*"))).otherwise(F.lit(REMOVED))
    return pairs.select("term").distinct().join(told, "term", "left").select("term", shown.alias("shown"))


def _texts_with(docs: DataFrame, wanted: DataFrame, name: str, form) -> DataFrame:
    """``(name, n_t)``: in how many distinct texts the wanted terms, or forms of terms, stand."""
    known = F.broadcast(wanted) if wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else wanted
    forms = F.array_distinct(F.transform(term_list(F.col("text")), form))
    held = docs.select(F.xxhash64("text").alias("text_hash"), F.explode(forms).alias(name))
    return held.join(known, name, "left_semi").groupBy(name).agg(F.count_distinct("text_hash").alias("n_t"))


def _discloses(exposure: float) -> Column:
    pmi = F.log2(F.col("n_et") * F.col("n") / (F.col("n_e") * F.col("n_t")))
    return pmi >= exposure * F.log2(F.col("n") / F.col("n_e"))


def find_spans(docs: DataFrame, reach: int = 5, support: int = 3, exposure: float = 0.9) -> DataFrame:
    """``docs`` with spans per kind: ``email``, ``ip``, ``card``, ``phone`` and ``term``.

    The ``value`` of a base span is what it holds; that of a ``term`` span is what replaces it.
    """
    found = base_spans(docs)
    private = found.filter(F.size("email") + F.size("ip") + F.size("card") + F.size("phone") > 0)
    terms = stored(disclosing_terms(docs, private, reach, support, exposure), "terms")
    some = terms.limit(BROADCAST_TERMS + 1).count()
    if not some:
        return found.withColumn("term", F.array().cast(SPANS))
    outside = F.filter("word", lambda w: ~F.exists(F.concat("email", "ip", "card", "phone"), lambda s: (s["start"] < w["stop"]) & (w["start"] < s["stop"])))
    if some <= BROADCAST_TERMS:
        rows = sorted((row["term"], row["shown"]) for row in terms.collect())  # at most BROADCAST_TERMS terms
        removed = [term for term, shown in rows if shown == REMOVED]
        general = [term for term, shown in rows if shown != REMOVED]
        held = F.exists(term_list(F.col("text")), lambda t: t.isin(removed + general))
        word = F.filter(located(F.col("text"), TERM), lambda w: F.lower(w["value"]).isin(removed + general))
        replaced = F.transform(word, lambda w: w.withField(
            "value", F.when(F.lower(w["value"]).isin(general), F.concat(F.substring(F.lower(w["value"]), 1, STEM), F.lit("*"))).otherwise(REMOVED)))
        return compute_once(compute_once(found, word=F.when(held, replaced).otherwise(F.array().cast(SPANS))), term=outside).drop("word")
    spread = found.withColumn("row", F.xxhash64("doc_id", "text"))
    held = spread.select("row", F.inline(located(F.col("text"), TERM))).distinct().withColumn("term", F.lower("value")).join(terms, "term")
    words = held.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", F.col("shown").alias("value")))).alias("word"))
    joined = spread.join(words, "row", "left").withColumn("word", F.coalesce("word", F.array().cast(SPANS)))
    return joined.withColumn("term", outside).drop("word", "row")


def span_list(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans by kind, then start, comma-joined."""
    return F.array_join(F.concat(*[_written(kind) for kind in kinds]), ",")


def _written(kind: str) -> Column:
    return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))


def sanitize(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with every span replaced: ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]``; terms by their general form or
    by ``[TERM]``.

    Overlapping spans are replaced once, under the kind of the first.
    """
    found = compute_once(find_spans(carried(docs), **settings), every=F.array_sort(F.concat(*[_named(kind) for kind in KINDS])))
    # A span begins a new one unless an earlier span ends after its start; ``reach`` is the greatest end so far.
    found = compute_once(found, reach=_running_stops(F.col("every")))
    begins = F.filter(
        F.zip_with("every", "reach", lambda s, r: F.struct(s["start"].alias("start"), s["shown"].alias("shown"), r.alias("before"))),
        lambda s: s["start"] >= s["before"],
    )
    # The reach before the next beginning is the end of a merged span, so ends are the reaches moved by one.
    last = F.aggregate("every", F.lit(0), lambda acc, s: F.greatest(acc, s["stop"]))
    found = compute_once(found, begins=begins, last=last)
    bounds = F.transform("begins", lambda s: s["before"])  # 0, then the end of each merged span but the last
    pieces = F.zip_with("begins", bounds, lambda s, begin: F.concat(F.substr("text", begin + 1, s["start"] - begin), s["shown"]))
    tail = F.substr("text", F.col("last") + 1, F.char_length("text"))
    clean = F.when(F.size("begins") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))
    return restored(found.withColumn("text", clean), docs)


def _running_stops(spans: Column) -> Column:
    """The greatest ``stop`` before each span, 0 before the first; in blocks, as ``located`` sums."""
    stops = F.transform(spans, lambda s: s["stop"])
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(stops) - 1) / BLOCK), F.lit(0)).cast("int")),
        lambda b: F.slice(stops, b * BLOCK + 1, BLOCK),
    )
    ends = F.aggregate(
        F.transform(blocks, lambda b: F.coalesce(F.array_max(b), F.lit(0))),
        F.struct(F.lit(0).alias("most"), F.array().cast("array<int>").alias("all")),
        lambda acc, e: F.struct(F.greatest(acc["most"], e).alias("most"), F.concat(acc["all"], F.array(acc["most"])).alias("all")),
        lambda acc: acc["all"],
    )

    def within(block: Column, most: Column) -> Column:
        return F.aggregate(
            block, F.struct(most.alias("most"), F.array().cast("array<int>").alias("all")),
            lambda acc, e: F.struct(F.greatest(acc["most"], e).alias("most"), F.concat(acc["all"], F.array(acc["most"])).alias("all")),
            lambda acc: acc["all"],
        )

    return F.when(F.size(stops) > 0, F.flatten(F.zip_with(blocks, ends, within))).otherwise(F.array().cast("array<int>"))


def _named(kind: str) -> Column:
    mark = F.lit(f"[{kind.upper()}]")
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), (s["value"] if kind == "term" else mark).alias("shown")))
