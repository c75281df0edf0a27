"""Lexical retrieval over markdown sections (O31-O34, O100)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.catalog import (
    FIELD_TABLE,
    MAX_READING_SECTIONS,
    STOPWORDS,
    TOP_SECTIONS,
    literal_array,
)
from clauselake.functions.text import strip_accents, truncate
from clauselake.plans.once import compute_once
from clauselake.plans.ranking import rank_by_levels
from clauselake.plans.top_k import top_k


def _tokens(text: Column) -> Column:
    return F.split(strip_accents(F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))), "[^a-z0-9]+")


def terms(text: Column) -> Column:
    """Distinct folded terms of three letters or more, without stopwords."""
    return F.array_except(F.filter(_tokens(text), lambda t: F.length(t) >= 3), literal_array(STOPWORDS))


def known_terms(text: Column, queries: list[list[str]]) -> Column:
    """The terms of a text that any of the catalog queries holds; what no query asks for cannot score."""
    return F.array_intersect(_tokens(text), literal_array(list(dict.fromkeys(t for query in queries for t in query))))


def catalog_terms(text: str) -> list[str]:
    """The same terms of a fixed catalog text, as plan-time literals."""
    decomposed = unicodedata.normalize("NFKD", text.casefold())
    plain = "".join(c for c in decomposed if not unicodedata.combining(c))
    tokens = dict.fromkeys(t for t in re.split("[^a-z0-9]+", plain) if len(t) >= 3)
    return [t for t in tokens if t not in STOPWORDS]


def overlap_score(query_terms: Column, text_terms: Column) -> Column:
    """Share of the query terms found in the text; 0 without query terms."""
    shared = F.size(F.array_intersect(query_terms, text_terms))
    return F.when(F.size(query_terms) > 0, shared / F.size(query_terms)).otherwise(F.lit(0.0))


def _evidence_columns(quoted_chars: int | None = None) -> list[Column]:
    """Evidence of a section; ``quoted_chars`` shortens the text for display, by default it stays whole."""
    return [
        "policy_id",
        F.concat(
            F.lit("ev_md_"), F.col("policy_id"), F.lit(":p"), F.col("page_number").cast("string"),
            F.lit(":s"), F.col("section_index").cast("string"),
        ).alias("evidence_id"),
        "page_number",
        "section_index",
        F.col("title").alias("section_name"),
        (truncate(F.col("text"), quoted_chars) if quoted_chars else F.col("text")).alias("quoted_text"),
        F.lit("PP_STRUCTURE").alias("source_type"),
    ]


def rank_sections(sections: DataFrame, limit: int = TOP_SECTIONS, quoted_chars: int | None = None) -> DataFrame:
    """Best sections of a policy for every catalog field, zero scores included.

    The ten field queries are literals: each section keeps the few terms that
    any of them holds and fans out to ten (field, score) pairs without a join.
    The texts return to the winners only.
    """
    limit = max(limit, 1)
    queries = {code: catalog_terms(f"{label} {description}") for code, _, _, label, description in FIELD_TABLE}
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.col("text"))
    keyed = compute_once(sections, __terms=known_terms(text, list(queries.values()))).select("policy_id", "page_number", "section_index", "__terms")
    scored = F.array(
        *[
            F.struct(
                F.lit(code).alias("field_code"),
                overlap_score(literal_array(query), F.col("__terms")).alias("retrieval_score"),
            )
            for code, query in queries.items()
        ]
    )
    pairs = keyed.select("policy_id", "page_number", "section_index", F.inline(scored))
    best = top_k(
        pairs, ["policy_id", "field_code"],
        [F.desc("retrieval_score"), F.asc("page_number"), F.asc("section_index")], limit,
    )
    texts = sections.select(*_evidence_columns(quoted_chars))
    return best.join(texts, ["policy_id", "page_number", "section_index"]).select(
        "policy_id", "field_code", "rank", "evidence_id", "page_number", "section_name", "quoted_text",
        "retrieval_score", "source_type",
    )


def reading_order_evidence(
    sections: DataFrame, limit: int = MAX_READING_SECTIONS, quoted_chars: int | None = None
) -> DataFrame:
    """First sections of a policy in reading order, without a score."""
    first = top_k(sections, ["policy_id"], [F.asc("page_number"), F.asc("section_index")], limit)
    return first.select("rank", *_evidence_columns(quoted_chars), F.lit(None).cast("double").alias("retrieval_score"))


def section_feed(evidence: DataFrame) -> DataFrame:
    """O100: evidence -> prompt sections with their documentary reference."""
    section = F.coalesce("section_name", F.lit(""))
    source = F.concat(F.lit("doc "), F.col("document_id"), F.lit(" · pág. "), F.col("page_number").cast("string"))
    return evidence.select(
        "policy_id",
        "evidence_id",
        F.when(section != "", F.concat(source, F.lit(" · seção "), section)).otherwise(source).alias("source"),
        F.coalesce("quoted_text", F.lit("")).alias("text"),
    )


def markdown_feed(sections: DataFrame) -> DataFrame:
    """O100: markdown sections -> prompt sections; an untitled one carries its number within the policy.

    The numbers come from the keys alone, by ranges of pages; texts move once, to meet their number.
    """
    place = ["policy_id", "page_number", "section_index"]
    page = F.col("page_number")
    positions = rank_by_levels(sections.select(*place), ["policy_id"], [F.floor(page / 1024), page], [F.asc("section_index")], "position")
    numbered = sections.join(positions, place)
    number = F.concat(F.lit("seção "), F.col("position").cast("string"))
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(number)
    return numbered.select(
        "policy_id",
        "position",
        F.concat(title, F.lit(" · pág. "), F.col("page_number").cast("string")).alias("source"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
