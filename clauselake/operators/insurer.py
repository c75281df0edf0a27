"""Insurer identification and display labels (O95-O99, O126)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.catalog import COMPANY_HINTS, INSURER_HEADER_LINES, TITLE_MARKERS, YEAR_RANGE
from clauselake.functions.text import collapse_spaces, strip
from clauselake.operators.pages import LINE_BREAK
from clauselake.plans.once import compute_once, let
from clauselake.plans.ranking import integer_levels, rank_by_levels

# fixed values: patterns of tag lines, reference years, dates and digits
TAG_LINE = r"^\[[^\]]+\]$"
YEAR_CONTEXT = r"(?iu)(?:vig[eê]ncia|emiss[aã]o|compet[eê]ncia|ap[oó]lice)[^0-9]{0,40}([0-9]{4})"
DATE_YEAR = r"(?U)\b[0-9]{2}/[0-9]{2}/([0-9]{4})\b"
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"


def content_lines(pages: DataFrame) -> DataFrame:
    """Lines of preview pages ``(policy_id, page_number, text)`` without tag lines, numbered from 1."""
    lines = F.filter(
        F.split(F.coalesce("text", F.lit("")), LINE_BREAK), lambda line: ~F.coalesce(strip(line).rlike(TAG_LINE), F.lit(False))
    )
    return pages.select("policy_id", "page_number", F.posexplode(lines).alias("position", "line")).withColumn(
        "line_number", F.col("position") + 1
    ).drop("position")


def company_name(line: Column, in_header: Column) -> Column:
    """Plausible company name in a line, else null."""
    cleaned = F.trim(collapse_spaces(F.regexp_replace(strip(line), r"(?U)^\W+", "")), F.lit(" -:|\t"))

    def any_of(needles: list[str]) -> str:
        return "|".join(needle.replace(".", "[.]") for needle in needles)

    def accepted(text: Column) -> Column:
        letters = F.regexp_count(text, F.lit(r"\p{L}"))
        plausible = (
            F.length(text).between(3, 60)
            & F.size(F.split(text, " ")).between(1, 8)
            & ~text.rlike(DIGIT)
            & (letters >= 3)
            & (letters / F.length(text) >= 0.55)
            & ~F.lower(text).rlike(any_of(TITLE_MARKERS))
            & (F.lower(text).rlike(any_of(COMPANY_HINTS)) | (in_header & text.rlike(r"^\p{Lu}")))
        )
        return F.when(plausible, text)

    return let(cleaned, accepted)


def line_year(line: Column) -> Column:
    """Reference year of a line: after a key word, else the first date in range."""
    context = F.regexp_extract(line, YEAR_CONTEXT, 1)
    years = F.filter(
        F.regexp_extract_all(line, F.lit(DATE_YEAR), 1), lambda year: year.cast("int").between(*YEAR_RANGE)
    )
    return F.when(context != "", context).otherwise(F.get(years, F.lit(0)))


def insurer_candidates(pages: DataFrame) -> DataFrame:
    """Lines that hold a candidate name or a year."""
    header = (F.col("page_number") == 1) & (F.col("line_number") <= INSURER_HEADER_LINES)
    read = compute_once(
        content_lines(pages), name=company_name(F.col("line"), header), year=line_year(F.col("line"))
    ).select("policy_id", "page_number", "line_number", "name", "year")
    return read.filter(F.col("name").isNotNull() | F.col("year").isNotNull())


def detect_insurer(pages: DataFrame) -> DataFrame:
    """Name and year where the direct reading is unambiguous.

    A single answer remains exactly when the longest candidate contains all
    others, so one aggregate finds it and a second one checks the rest.
    """
    read = insurer_candidates(pages)
    position = F.struct("page_number", "line_number")
    named = F.col("name").isNotNull()
    longest = read.groupBy("policy_id").agg(
        F.min_by(
            F.col("name"),
            F.when(named, F.struct((-F.length("name")).alias("size"), F.col("page_number"), F.col("line_number"))),
        ).alias("insurer"),
        F.min_by("year", F.when(F.col("year").isNotNull(), position)).alias("insurer_year"),
    )
    others = read.filter(named).select("policy_id", "name")
    return (
        others.join(longest.filter(F.col("insurer").isNotNull()), "policy_id")
        .groupBy("policy_id", "insurer", "insurer_year")
        .agg(F.bool_and(F.contains(F.lower("insurer"), F.lower("name"))).alias("single"))
        .filter("single")
        .select("policy_id", F.col("insurer").alias("name"), F.col("insurer_year").alias("year"))
    )


def escalate(policies: DataFrame, detected: DataFrame, answers: DataFrame) -> DataFrame:
    """Direct reading, then the model's answer (name and year together), else null."""
    return (
        policies.select("policy_id")
        .join(detected.select("policy_id", F.struct("name", "year").alias("__read")), "policy_id", "left")
        .join(answers.select("policy_id", F.struct("name", "year").alias("__answer")), "policy_id", "left")
        .withColumn("__pick", F.coalesce("__read", F.when(F.col("__answer.name") != "", F.col("__answer"))))
        .select("policy_id", "__pick.name", "__pick.year")
    )


def undecided(policies: DataFrame, detected: DataFrame) -> DataFrame:
    """Policies that still need a prompt: the cheap reading runs first."""
    return policies.join(detected.select("policy_id"), "policy_id", "left_anti")


def manual_override(info: DataFrame, manual: DataFrame) -> DataFrame:
    """O126: a typed name counts only where detection gave none; the detected year stays."""
    typed = manual.select("policy_id", F.col("name").alias("__typed"))
    joined = info.join(typed, "policy_id", "left")
    missing = F.coalesce("name", F.lit("")) == ""
    return joined.withColumn("name", F.when(missing & (F.coalesce("__typed", F.lit("")) != ""), F.col("__typed")).otherwise(F.col("name"))).drop(
        "__typed"
    )


def letter_number(number: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA, and so on."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(7)),  # 26**7 exceeds any group
        F.struct(number.cast("long").alias("rest"), F.lit("").alias("text")),
        lambda acc, _: F.when(
            acc["rest"] > 0,
            F.struct(
                F.floor((acc["rest"] - 1) / 26).cast("long").alias("rest"),
                F.concat(F.char((acc["rest"] - 1) % 26 + 65), acc["text"]).alias("text"),
            ),
        ).otherwise(acc),
        lambda acc: acc["text"],
    )


def display_labels(info: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Label per policy within a scope of policies shown together.

    ``info(policy_id, position, name, year)``. A unique name is its own label;
    shared names take their years when all are present and different, else the
    letters A to Z, AA, AB, ... in input order. Without a name the label is the
    policy id. Group sizes come from aggregates and the letters from a
    distributed rank of the keys, so a name that most policies share is no hot task.
    """
    keys = [*(scope or []), "name"]
    named = info.withColumn("name", F.coalesce("name", F.lit(""))).withColumn("year", F.coalesce("year", F.lit("")))
    groups = named.filter(F.col("name") != "").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.count_if(F.col("year") == "").alias("__no_year"),
        F.count_distinct("year").alias("__years"),
    )
    shared = groups.filter(F.col("__n") > 1).select(
        *keys, ((F.col("__no_year") == 0) & (F.col("__years") == F.col("__n"))).alias("__by_year")
    )
    marked = named.join(shared, keys, "left")
    letters = rank_by_levels(
        marked.filter(~F.col("__by_year")).select(*keys, "policy_id", "position"),
        keys, integer_levels(F.col("position")), [F.asc("position"), F.asc("policy_id")], "__letter",
    ).drop("position")
    labelled = marked.join(letters, [*keys, "policy_id"], "left")
    suffix = F.when(F.col("__by_year"), F.col("year")).when(F.col("__letter").isNotNull(), letter_number(F.col("__letter")))
    return labelled.select(
        *(scope or []),
        "policy_id",
        F.when(F.col("name") == "", F.col("policy_id")).otherwise(F.concat_ws(" ", "name", suffix)).alias("label"),
    )
