"""Facts: requests, guards, anchoring, rules and review state (O57-O71, O121, O123).

Fact table: ``fact_id, policy_id, field_code, field_type, status, value,
normalized_value, confidence, evidence_ids, requires_human_review,
rule_violations, anchor_violations``. Rule and anchor violations are columns of
their own. One extraction of a policy holds at most one row per catalog field,
so windows over ``policy_id`` are bounded by ten rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clauselake.catalog import (
    CITATION_KEYS,
    FACT_STATUSES,
    FIELD_CODES,
    KNOWN_CURRENCIES,
    POSITIVE_CODES,
    SCHEMA_VERSION,
    TERRITORY_TOKENS,
    field_attribute,
    field_ordinal,
)
from clauselake.functions.text import clean_optional, fold, strip
from clauselake.functions.values import normalize_once, parse_value
from clauselake.plans.once import compute_once

VIOLATIONS = "array<struct<rule:string,field_code:string,reason:string>>"
QUOTED_SEGMENT = "“[^“”]+”|[\"“”'][^\"“”']+[\"“”']"  # a passage in “…” is whole, whatever other quotes it holds
MIXED_CURRENCY = "campos monetários da mesma apólice com moedas distintas"


def request_grid(policies: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """One request per policy and field (all catalog fields by default)."""
    wanted = F.array(*[F.lit(code) for code in (codes or FIELD_CODES)])
    return policies.select("policy_id", F.explode(wanted).alias("field_code"))


def catalog_guard(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests inside the catalog, and rejects."""
    known = F.col("field_code").isin(*FIELD_CODES)
    rejects = requests.filter(~F.coalesce(known, F.lit(False))).withColumn("error_code", F.lit("UNKNOWN_FIELD_CODE"))
    return requests.filter(known), rejects


def collect_excerpts(value: Column) -> Column:
    """Literal excerpts cited in a raw value: citation keys, and quoted parts of free text."""
    cited = F.array(*[value[key] for key in CITATION_KEYS])
    quoted = [
        F.coalesce(F.regexp_extract_all(value[key], F.lit(QUOTED_SEGMENT), 0), F.array().cast("array<string>"))
        for key in ("text", "value_text")
    ]
    inner = F.transform(F.concat(*quoted), lambda part: F.substr(part, F.lit(2), F.length(part) - 2))
    return F.filter(F.transform(F.array_compact(F.concat(cited, inner)), strip), lambda excerpt: excerpt != "")


def found_excerpts(excerpts: Column, text: Column) -> Column:
    """Positions of the excerpts that are literal parts of one evidence text."""
    positions = F.transform(excerpts, lambda excerpt, i: F.when(F.contains(text, excerpt), i))
    return F.array_compact(positions)


def anchor_check(facts: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Facts with ``unknown_evidence`` and ``unanchored`` (number of excerpts without a source).

    ``facts`` needs policy_id, evidence_ids and excerpts. Each cited evidence is
    met by an equi-join; what returns to the fact are small positions, never the
    texts. A widely cited evidence is a skewed join key, which AQE splits.
    """
    payload = [name for name in facts.columns if name not in keys]
    cited = facts.withColumn("__evidence_id", F.explode_outer(F.array_distinct("evidence_ids")))
    known = evidence.select(
        "policy_id", F.col("evidence_id").alias("__evidence_id"), F.col("quoted_text").alias("__text")
    )
    met = cited.join(known, ["policy_id", "__evidence_id"], "left")
    nothing = F.array().cast("array<int>")
    return (
        met.withColumn("__found", F.coalesce(found_excerpts(F.col("excerpts"), F.col("__text")), nothing))
        .withColumn("__unknown", F.col("__evidence_id").isNotNull() & F.col("__text").isNull())
        .groupBy(*keys)
        .agg(
            F.first(F.struct(*payload)).alias("__fact"),
            F.bool_or("__unknown").alias("unknown_evidence"),
            F.size(F.array_distinct(F.flatten(F.collect_list("__found")))).alias("__anchored"),
        )
        .select(*keys, "__fact.*", "unknown_evidence", "__anchored")
        .withColumn("unanchored", F.coalesce(F.size("excerpts") - F.col("__anchored"), F.lit(0)))
        .drop("__anchored")
    )


def _violation(rule: str, code: Column, reason: str, broken: Column) -> Column:
    return F.when(
        broken, F.struct(F.lit(rule).alias("rule"), code.alias("field_code"), F.lit(reason).alias("reason"))
    )


def field_rules(code: Column, field_type: Column, value: Column) -> Column:
    """Rules on one normalised value, as an array of violations."""
    amount = F.when(field_type == "money", value["amount"]).when(field_type == "number", value["number"])
    territory = fold(value["text"])
    return F.coalesce(
        F.array_compact(
            F.array(
                _violation("valor_positivo", code, "valor negativo é inválido", amount < 0),
                _violation(
                    "valor_positivo", code, "campo exige valor estritamente positivo",
                    code.isin(*POSITIVE_CODES) & (amount == 0),
                ),
                _violation(
                    "moeda_conhecida", code, "moeda fora do conjunto conhecido",
                    (field_type == "money") & ~value["currency"].isin(*KNOWN_CURRENCIES),
                ),
                _violation(
                    "vigencia_ordem", code, "início posterior ao fim",
                    (field_type == "period") & (value["start"] > value["end"]),
                ),
                _violation(
                    "enum_base_territorial", code, "valor fora do enum de extensão territorial",
                    (code == "extensao_territorial") & ~territory.isin(*TERRITORY_TOKENS),
                ),
            )
        ).cast(VIOLATIONS),
        F.array().cast(VIOLATIONS),
    )


def cross_field_rules(facts: DataFrame, batch: list[str] | None = None) -> DataFrame:
    """Money facts of one extraction must share their currency; otherwise all are demoted."""
    window = Window.partitionBy(*(batch or ["policy_id"]))
    money = (F.col("field_type") == "money") & (F.col("status") == "FOUND")
    currency = F.when(money, F.col("normalized_value")["currency"])
    mixed = F.min(currency).over(window) != F.max(currency).over(window)
    demoted = F.coalesce(mixed & currency.isNotNull(), F.lit(False))
    violation = F.struct(
        F.lit("moeda_consistente").alias("rule"), F.col("field_code"), F.lit(MIXED_CURRENCY).alias("reason")
    )
    return (
        facts.withColumn("__demoted", demoted)
        .withColumn(
            "rule_violations",
            F.when(F.col("__demoted"), F.array_append("rule_violations", violation)).otherwise(F.col("rule_violations")),
        )
        .withColumn("status", F.when(F.col("__demoted"), F.lit("NEEDS_REVIEW")).otherwise(F.col("status")))
        .withColumn("requires_human_review", F.col("requires_human_review") | F.col("__demoted"))
        .drop("__demoted")
    )


def complete_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their answer; the last answer of a field wins, none means NOT_FOUND."""
    columns = ["status", "value", "confidence", "evidence_ids", "requires_human_review"]
    order = F.col("position") if "position" in responses.columns else F.lit(0)
    last = (
        responses.groupBy("policy_id", "field_code")
        .agg(F.max_by(F.struct(*columns), order).alias("answer"))
        .withColumn("answered", F.lit(True))
    )
    joined = requests.join(last, ["policy_id", "field_code"], "left")
    return joined.select(
        "policy_id",
        "field_code",
        F.coalesce("answered", F.lit(False)).alias("answered"),
        F.when(F.col("answered"), F.col("answer.status")).otherwise(F.lit("NOT_FOUND")).alias("status"),
        F.col("answer.value").alias("value_json"),
        F.coalesce("answer.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("answer.evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"),
        F.coalesce("answer.requires_human_review", F.lit(False)).alias("requires_human_review"),
    )


def contract_error(status: Column, confidence: Column, evidence_ids: Column) -> Column:
    """Error code of a fact that breaks its contract, else null."""
    valid = (
        F.coalesce(status.isin(*FACT_STATUSES), F.lit(False))
        & F.coalesce(confidence.between(0, 1), F.lit(False))
        & ((status == "NOT_FOUND") | (F.size(evidence_ids) > 0))
    )
    return F.when(~valid, F.lit("LLM_SCHEMA_INVALID"))


def build_facts(requests: DataFrame, responses: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers -> facts, all or nothing per policy; returns (facts, rejects).

    ``rejects`` has one row per rejected policy with the first error in catalog
    order. No fact of such a policy is returned.
    """
    rejects = batch_rejects(requests, responses, evidence)
    tagged = _guarded(requests, responses, evidence)
    facts = tagged.filter(F.col("batch_error").isNull()).drop("batch_error", "excerpts")
    return cross_field_rules(facts), rejects


def batch_rejects(requests: DataFrame, responses: DataFrame, evidence: DataFrame) -> DataFrame:
    """The first error of each policy in catalog order, an unknown evidence before a broken contract.

    Rules and anchors turn FOUND into NEEDS_REVIEW only, which no contract
    refuses, so neither values nor texts are read and only ids are shuffled.
    """
    answered = complete_requests(requests, responses.withColumn("value", F.lit(None).cast("string")))
    cited = answered.select(
        "policy_id", "field_code", F.explode_outer(F.array_distinct("evidence_ids")).alias("evidence_id"),
        contract_error(F.col("status"), F.col("confidence"), F.col("evidence_ids")).alias("broken"),
    )
    offered = evidence.select("policy_id", "evidence_id", F.col("quoted_text").isNotNull().alias("quoted"))
    known = F.col("evidence_id").isNull() | F.coalesce("quoted", F.lit(False))
    error = F.when(~known, F.lit("EVIDENCE_UNKNOWN")).otherwise(F.col("broken"))
    first = F.struct(
        field_ordinal(F.col("field_code")).alias("ordinal"), "field_code", known.alias("known"), error.alias("error_code")
    )
    met = cited.join(offered, ["policy_id", "evidence_id"], "left").filter(error.isNotNull())
    return met.groupBy("policy_id").agg(F.min(first).alias("e")).select("policy_id", "e.field_code", "e.error_code")


def _guarded(requests: DataFrame, responses: DataFrame, evidence: DataFrame) -> DataFrame:
    field_type = field_attribute(F.col("field_code"), "field_type")
    raw = complete_requests(requests, responses).withColumn("field_type", field_type)
    raw = compute_once(raw, value=parse_value(F.col("field_type"), F.col("value_json")))
    given = F.col("value_json").isNotNull() & (F.trim("value_json") != "null")
    unreadable = (F.col("status") == "FOUND") & given & F.col("value").isNull()
    found = (F.col("status") == "FOUND") & F.col("value").isNotNull()
    raw = normalize_once(raw, "normalized_value", F.col("field_type"), F.col("value"), found)
    raw = compute_once(raw, excerpts=F.coalesce(collect_excerpts(F.col("value")), F.array().cast("array<string>")))
    demoted = unreadable | (found & F.col("normalized_value").isNull())
    raw = (
        raw.withColumn("__demoted", F.coalesce(demoted, F.lit(False)))
        .withColumn("status", F.when(F.col("__demoted"), F.lit("NEEDS_REVIEW")).otherwise(F.col("status")))
        .withColumn("requires_human_review", F.col("requires_human_review") | F.col("__demoted"))
        .drop("__demoted", "value_json")
    )
    checked = anchor_check(raw, evidence, ["policy_id", "field_code"])

    fact_found = F.col("status") == "FOUND"
    rules = F.when(
        fact_found & F.col("normalized_value").isNotNull(),
        field_rules(F.col("field_code"), F.col("field_type"), F.col("normalized_value")),
    ).otherwise(F.array().cast(VIOLATIONS))
    ruled = compute_once(checked, rule_violations=rules)
    broken = fact_found & ((F.col("unanchored") > 0) | (F.size("rule_violations") > 0))
    ruled = (
        ruled.withColumn("__broken", F.coalesce(broken, F.lit(False)))
        .withColumn("status", F.when(F.col("__broken"), F.lit("NEEDS_REVIEW")).otherwise(F.col("status")))
        .withColumn("requires_human_review", F.col("requires_human_review") | F.col("__broken"))
    )
    error = F.when(F.col("unknown_evidence"), F.lit("EVIDENCE_UNKNOWN")).otherwise(
        contract_error(F.col("status"), F.col("confidence"), F.col("evidence_ids"))
    )
    first_error = F.min(
        F.when(
            error.isNotNull(),
            F.struct(field_ordinal(F.col("field_code")).alias("ordinal"), "field_code", error.alias("error_code")),
        )
    ).over(Window.partitionBy("policy_id"))
    return ruled.select(
        F.concat(F.lit("FAC-"), F.col("policy_id"), F.lit("-"), F.col("field_code")).alias("fact_id"),
        "policy_id",
        "field_code",
        "field_type",
        "status",
        "value",
        "normalized_value",
        F.col("confidence").cast("double").alias("confidence"),
        "evidence_ids",
        "requires_human_review",
        "rule_violations",
        F.col("unanchored").alias("anchor_violations"),
        "excerpts",
        first_error.alias("batch_error"),
    )


def validate_normalized(facts: DataFrame) -> DataFrame:
    """O64-O69 for facts that already carry a normalised value: rules, demotion, cross rule."""
    rules = F.when(
        (F.col("status") == "FOUND") & F.col("normalized_value").isNotNull(),
        field_rules(F.col("field_code"), F.col("field_type"), F.col("normalized_value")),
    ).otherwise(F.array().cast(VIOLATIONS))
    ruled = compute_once(facts, rule_violations=rules)
    broken = F.size("rule_violations") > 0
    ruled = ruled.withColumn("status", F.when(broken, F.lit("NEEDS_REVIEW")).otherwise(F.col("status"))).withColumn(
        "requires_human_review", F.col("requires_human_review") | broken
    )
    return cross_field_rules(ruled)


def with_review_state(facts: DataFrame, run_id: Column, schema_version: str = SCHEMA_VERSION) -> DataFrame:
    """Facts as first persisted: pending when flagged, confirmed otherwise; no decision yet."""
    null = F.lit(None).cast("string")
    return facts.select(
        "*",
        F.when(F.col("requires_human_review"), F.lit("PENDENTE")).otherwise(F.lit("CONFIRMADO")).alias("revisao_status"),
        null.alias("revisao_decisao"),
        null.alias("revisao_por"),
        null.alias("revisao_em"),
        run_id.cast("string").alias("run_id"),
        F.lit(schema_version).alias("schema_version"),
    )


def scan_facts(facts: DataFrame, policy_id: str, field_code: str | None = None) -> DataFrame:
    """O121: facts of a policy in field order; both conditions reach the scan."""
    found = facts.filter(F.col("policy_id") == policy_id)
    if field_code is not None:
        found = found.filter(F.col("field_code") == field_code)
    return found.orderBy("field_code")


FINDING = "struct<label:string,value:string,detail:string,evidence_ids:array<string>>"


def extra_findings(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Validated findings outside the catalog.

    ``answers(policy_id, findings array<FINDING>)``, ``known(policy_id,
    evidence_ids array<string>)``: the evidence offered with the prompt, at most
    twenty per policy. A finding needs a label, a value and only known ids; ids
    keep their order without repeats; numbering counts the kept ones.
    """
    offered = F.coalesce("__known", F.array().cast("array<string>"))
    joined = answers.join(known.select("policy_id", F.col("evidence_ids").alias("__known")), "policy_id", "left")
    valid = F.filter(
        "findings",
        lambda f: clean_optional(f["label"], null_words=True).isNotNull()
        & f["value"].isNotNull()
        & F.coalesce(F.size(f["evidence_ids"]) > 0, F.lit(False))
        & F.coalesce(~F.exists(f["evidence_ids"], lambda e: e.isNull()), F.lit(False))
        & (F.size(F.array_except(f["evidence_ids"], offered)) == 0),
    )
    return joined.select("policy_id", F.posexplode(valid).alias("position", "finding")).select(
        F.format_string("EXF-%s-%03d", "policy_id", "position").alias("finding_id"),
        "policy_id",
        clean_optional(F.col("finding.label"), null_words=True).alias("label"),
        F.col("finding.value").alias("value"),
        clean_optional(F.col("finding.detail"), null_words=True).alias("detail"),
        F.array_distinct("finding.evidence_ids").alias("evidence_ids"),
    )


def scan_findings(findings: DataFrame, policy_id: str) -> DataFrame:
    """O123: findings of a policy in id order, JSON id lists decoded."""
    found = findings.filter(F.col("policy_id") == policy_id)
    if dict(found.dtypes)["evidence_ids"] == "string":
        found = found.withColumn("evidence_ids", F.from_json("evidence_ids", "array<string>"))
    return found.orderBy("finding_id")
