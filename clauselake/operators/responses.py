"""Answers of a model as a table boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.values import is_object
from clauselake.plans.once import compute_once

ITEM = (
    "struct<field_code:string,status:string,value:string,confidence:double,evidence_ids:array<string>,"
    "requires_human_review:boolean>"
)
INVALID = "LLM_SCHEMA_INVALID"


def _well_formed(payload: Column) -> Column:
    # Inside an object, so that anything after the value counts as malformed.
    return F.try_parse_json(F.concat(F.lit('{"v":'), payload, F.lit("}"))).isNotNull()


def parse_facts(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extraction answers ``(policy_id, payload)`` -> items, and rejects.

    The payload is a list or ``{"facts": [...]}``; anything else, or an item
    that is no object, is invalid and yields an error row instead of a failure.
    """
    wrapped = F.get_json_object("payload", "$.facts")
    body = F.when(is_object(F.col("payload")), F.coalesce(wrapped, F.col("payload"))).otherwise(F.col("payload"))
    raw_items = F.from_json("__body", "array<string>")
    prepared = (
        compute_once(answers, __body=F.when(_well_formed(F.col("payload")), body))
        .withColumn("__raw", F.when(F.ltrim("__body").startswith("["), raw_items))
    )
    well_formed = F.col("__raw").isNotNull() & ~F.exists("__raw", lambda item: ~is_object(item))
    prepared = compute_once(prepared, __valid=F.coalesce(well_formed, F.lit(False)))
    rejects = prepared.filter(~F.col("__valid")).select("policy_id", F.lit(INVALID).alias("error_code"))
    items = prepared.filter("__valid").select("policy_id", F.posexplode("__raw").alias("position", "__item"))
    parsed = items.select("policy_id", "position", F.from_json("__item", ITEM).alias("__i"))
    return parsed.select("policy_id", "position", "__i.*"), rejects


def parse_object(answers: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Answers that must be one JSON object, parsed with ``schema``; the rest are rejects."""
    valid = _well_formed(F.col("payload")) & is_object(F.col("payload"))
    keys = [name for name in answers.columns if name != "payload"]
    rejects = answers.filter(~F.coalesce(valid, F.lit(False))).select(*keys, F.lit(INVALID).alias("error_code"))
    parsed = answers.filter(valid).select(*keys, F.from_json("payload", schema).alias("__o")).select(*keys, "__o.*")
    return parsed, rejects


def complete_prompts(prompts: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Prompts with their answers; an unanswered prompt keeps a null payload, never an error."""
    return prompts.join(answers, keys, "left").withColumn("answered", F.col("payload").isNotNull())
