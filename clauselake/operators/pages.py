"""Page classification, text resolution and composition (O10-O17, O118, O129).

Page table: ``policy_id, document_id, page_number, native_text, ocr_text,
ocr_confidence, regions array<struct<kind, text, order>>``; text recognition
and layout are inputs. All operators here but the aggregates are narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.catalog import ILLEGIBLE_OCR_CONFIDENCE, MIN_NATIVE_TEXT_CHARS, TABLE_MARKER
from clauselake.functions.text import is_blank, strip

PAGE_RANGE = 1024  # page numbers whose list is written first
REGIONS = "array<struct<kind:string,text:string,order:int>>"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def classify_page(text: Column) -> Column:
    """Enough native text (40 code points after trimming) or text recognition."""
    enough = F.length(strip(text)) >= MIN_NATIVE_TEXT_CHARS
    return F.when(enough, F.lit("NATIVE_TEXT")).otherwise(F.lit("PADDLEOCR"))


def is_illegible(confidence: Column) -> Column:
    """O11."""
    return F.coalesce(confidence < ILLEGIBLE_OCR_CONFIDENCE, F.lit(False))


def _by_order(regions: Column) -> Column:
    """Regions in reading order; equal orders keep their input position."""
    keyed = F.transform(
        regions, lambda r, i: F.struct(r["order"].alias("o"), i.alias("i"), r["kind"].alias("kind"), r["text"].alias("text"))
    )
    return F.array_sort(keyed)


def _table_rows(tsv: Column, start: str, end: str) -> Column:
    """Tab-separated lines -> joined cells; rows without content are dropped."""
    lines = F.split(tsv, LINE_BREAK)
    cells = F.transform(lines, lambda line: F.transform(F.split(line, "\t"), strip))
    kept = F.filter(cells, lambda row: F.exists(row, lambda cell: cell != ""))
    rows = F.transform(kept, lambda row: F.concat(F.lit(start), F.array_join(row, " | "), F.lit(end)))
    return F.array_join(rows, "\n")


def compose_page_text(regions: Column) -> Column:
    """Regions in reading order as text; tables marked and piped; empty pieces dropped."""

    def render(region: Column) -> Column:
        table = _table_rows(region["text"], "", "")
        marked = F.when(table != "", F.concat(F.lit(TABLE_MARKER + "\n"), table)).otherwise(F.lit(""))
        return F.when(region["kind"] == "table", marked).otherwise(strip(region["text"]))

    parts = F.filter(F.transform(_by_order(regions), render), lambda part: part != "")
    return F.coalesce(F.array_join(parts, "\n"), F.lit(""))


def compose_page_markdown(regions: Column) -> Column:
    """Headings as ``## title``, tables as pipe rows, paragraphs; blank line between blocks."""

    def render(region: Column) -> Column:
        text = F.coalesce(region["text"], F.lit(""))
        return (
            F.when(region["kind"] == "heading", F.concat(F.lit("## "), strip(text)))
            .when(region["kind"] == "table", _table_rows(text, "| ", " |"))
            .otherwise(strip(text))
        )

    parts = F.filter(F.transform(_by_order(regions), render), lambda part: part != "")
    return F.coalesce(F.array_join(parts, "\n\n"), F.lit(""))


def resolve_page_text(pages: DataFrame, layout_mode: str = "scanned") -> DataFrame:
    """Text and source of each page for indexing.

    Native text when there is enough, else recognised text; composed layout wins
    when it applies (``all`` pages, or pages that needed recognition) and is not
    empty. The recognition confidence is kept for recognised pages.
    """
    source = classify_page(F.coalesce("native_text", F.lit("")))
    native = source == "NATIVE_TEXT"
    composed = compose_page_text(F.col("regions"))
    applies = (F.lit(layout_mode == "all") | ~native) & (composed != "")
    return pages.select(
        "policy_id",
        "document_id",
        "page_number",
        F.when(applies, composed)
        .when(native, F.col("native_text"))
        .otherwise(F.coalesce("ocr_text", F.lit("")))
        .alias("text"),
        F.when(applies, F.lit("PP_STRUCTURE")).otherwise(source).alias("source_type"),
        F.when(~native, F.col("ocr_confidence")).alias("ocr_confidence"),
        (~native).alias("used_ocr"),
    )


def resolve_page_markdown(pages: DataFrame) -> DataFrame:
    """Markdown of each page: layout, then native text, then recognised text.

    A page whose recognition failed (null text) keeps its native text.
    """
    native = F.coalesce("native_text", F.lit(""))
    layout = strip(compose_page_markdown(F.col("regions")))
    has_layout = layout != ""
    from_ocr = (classify_page(native) == "PADDLEOCR") & F.col("ocr_text").isNotNull()
    return pages.select(
        "policy_id",
        "document_id",
        "page_number",
        F.when(has_layout, layout).when(from_ocr, strip(F.col("ocr_text"))).otherwise(strip(native)).alias("markdown"),
        F.when(has_layout, F.lit("PP_STRUCTURE"))
        .when(from_ocr, F.lit("PADDLEOCR"))
        .otherwise(F.lit("NATIVE_TEXT"))
        .alias("source_type"),
    )


def preview_pages(pages: DataFrame, max_pages: int = 2) -> DataFrame:
    """First pages with recognised text before native text, each block labelled."""

    def block(label: str, column: str) -> Column:
        return F.when(~is_blank(F.col(column)), F.concat(F.lit(f"[{label}]\n"), strip(F.col(column))))

    return pages.filter(F.col("page_number") <= max_pages).select(
        "policy_id",
        "document_id",
        "page_number",
        F.concat_ws("\n", block("OCR/visão", "ocr_text"), block("texto nativo", "native_text")).alias("text"),
    )


def page_ocr(lines: DataFrame) -> DataFrame:
    """Recognised lines -> page text and mean confidence.

    The mean is a partial aggregate; the lines of one page are bounded by the page.
    """
    kept = lines.filter(~is_blank(F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("line_number", "text")))
    found = kept.groupBy("document_id", "page_number").agg(
        F.array_join(F.transform(rows, lambda row: row["text"]), "\n").alias("ocr_text"),
        F.avg("score").alias("ocr_confidence"),
    )
    return (
        lines.select("document_id", "page_number")
        .distinct()
        .join(found, ["document_id", "page_number"], "left")
        .select("document_id", "page_number", F.coalesce("ocr_text", F.lit("")).alias("ocr_text"), "ocr_confidence")
    )


def document_status(resolved: DataFrame) -> DataFrame:
    """O118: the stages a processed document went through, one row per stage.

    Only illegible pages reach the page list. It is written per range of
    ``PAGE_RANGE`` page numbers first; a document then joins one short text per
    range, so no group holds or sorts the pages of a whole document.
    """
    illegible = F.when(is_illegible(F.col("ocr_confidence")), F.col("page_number").cast("bigint"))
    ranges = resolved.groupBy("document_id", F.floor(F.col("page_number") / PAGE_RANGE).alias("range")).agg(
        F.bool_or("used_ocr").alias("used_ocr"), F.array_join(F.array_sort(F.collect_list(illegible)), ", ").alias("pages")
    )
    parts = F.collect_list(F.when(F.col("pages") != "", F.struct("range", "pages")))
    facts = ranges.groupBy("document_id").agg(
        F.bool_or("used_ocr").alias("used_ocr"),
        F.array_join(F.transform(F.array_sort(parts), lambda part: part["pages"]), ", ").alias("illegible"),
    )

    def stage(seq: int, name: str, progress: float, keep: Column, message: Column | None = None) -> Column:
        text = F.lit(None).cast("string") if message is None else message
        return F.when(
            keep,
            F.struct(
                F.lit(seq).alias("seq"), F.lit(name).alias("stage"), F.lit(progress).alias("progress"), text.alias("message")
            ),
        )

    review = F.col("illegible") != ""
    stages = F.array_compact(
        F.array(
            stage(1, "RECEIVED", 0.0, F.lit(True)),
            stage(2, "TEXT_EXTRACTED", 0.3, F.lit(True)),
            stage(3, "OCR_COMPLETED", 0.5, F.col("used_ocr")),
            stage(4, "INDEXED", 1.0, F.lit(True)),
            stage(
                5, "REVIEW_REQUIRED", 1.0, review, F.concat(F.lit("REVIEW: páginas ilegíveis: "), F.col("illegible"))
            ),
        )
    )
    return facts.select("document_id", F.inline(stages))


def failure_status(failures: DataFrame) -> DataFrame:
    """O128: classified failures (``document_id, code, message, retriable``) as FAILED status rows."""
    flag = F.when(F.col("retriable"), F.lit("True")).otherwise(F.lit("False"))
    return failures.select(
        "document_id",
        F.lit("FAILED").alias("stage"),
        F.lit(0.0).alias("progress"),
        F.concat(F.col("code"), F.lit(": "), F.col("message"), F.lit(" (reexecutável="), flag, F.lit(")")).alias("message"),
    )


def run_profile(markdown_pages: DataFrame, facts: DataFrame) -> DataFrame:
    """O129: per policy, pages, characters, pages with a table and facts by status."""
    text = F.coalesce("markdown", F.lit(""))
    pages = markdown_pages.groupBy("policy_id").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.length(text)).alias("chars"),
        F.count_if(F.contains(text, F.lit("|")) & F.contains(text, F.lit("---"))).alias("table_pages"),
    )
    found = facts.groupBy("policy_id").agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("FOUND", "NOT_FOUND", "NEEDS_REVIEW")]
    )
    return pages.join(found, "policy_id", "full").na.fill(0)
