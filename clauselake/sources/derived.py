"""Operator inputs derived from the driver's tables.

Every view is a pure function of whole tables; arithmetic on keys only injects
the states that the operators must handle (scanned pages, missing facts, mixed
currencies). No view drops rows to become small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.catalog import CRITERION_CODES, FIELD_CODES, REPORT_CATEGORIES, REPORT_FIELD_TABLE, field_attribute, sql_text
from clauselake.functions.text import strip
from clauselake.functions.values import normalize_once, normalize_value, parse_value
from clauselake.operators.facts import validate_normalized
from clauselake.operators.pages import REGIONS
from clauselake.plans.once import compute_once
from clauselake.sources.tables import partition_by, table


def text(column: Column) -> Column:
    return column.cast("string")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as pages: one policy and document per source, page number from the document id.

    Every third page opens with a clause marker; every seventh is a scan whose
    text came from recognition, and every second scan also has layout regions.
    """
    doc = F.col("doc_id")
    scanned = doc % 7 == 0
    marked = F.when(doc % 3 == 0, F.concat(F.lit("Cláusula "), text(doc), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    regions = F.array(
        F.struct(F.lit("heading").alias("kind"), F.concat(F.lit("Artigo "), text(doc)).alias("text"), F.lit(0).alias("order")),
        F.struct(F.lit("text").alias("kind"), marked.alias("text"), F.lit(1).alias("order")),
    ).cast(REGIONS)
    return table(spark, folder, "documents").select(
        F.col("source").alias("policy_id"),
        F.col("source").alias("document_id"),
        (doc + 1).alias("page_number"),
        F.when(scanned, F.concat(F.lit("p. "), text(doc))).otherwise(marked).alias("native_text"),
        F.when(scanned, marked).alias("ocr_text"),
        F.when(scanned, (doc % 100) / 100.0).alias("ocr_confidence"),
        F.when(doc % 14 == 0, regions).alias("regions"),
    )


def single_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as policies of one page each, without markers."""
    doc = text(F.col("doc_id"))
    return table(spark, folder, "documents").select(
        doc.alias("policy_id"),
        doc.alias("document_id"),
        F.lit(1).alias("page_number"),
        F.col("text"),
        F.lit("NATIVE_TEXT").alias("source_type"),
        F.lit(None).cast("double").alias("ocr_confidence"),
    )


def line_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a document as layout regions in reverse storage order: headings, tables and texts by position."""
    lines = F.split("text", "\n")
    kind = lambda i: F.when(i % 5 == 0, F.lit("heading")).when(i % 5 == 3, F.lit("table")).otherwise(F.lit("text"))
    body = lambda line, i: F.when(i % 5 == 3, F.replace(line, F.lit(". "), F.lit("\t"))).otherwise(line)
    regions = F.transform(lines, lambda line, i: F.struct(kind(i).alias("kind"), body(line, i).alias("text"), i.alias("order")))
    return table(spark, folder, "documents").select("doc_id", F.reverse(regions).cast(REGIONS).alias("regions"))


def section_policy() -> Column:
    """Eight documents in a row make a policy, so policies and their sections grow with the corpus."""
    return F.concat(F.lit("pol"), text(F.floor(F.col("doc_id") / 8)))


def markdown_pages(spark: SparkSession, folder: str, policy: Column | None = None) -> DataFrame:
    """Documents as markdown pages of a policy: lines that start with D, E or L become headings of level 2."""
    policy = section_policy() if policy is None else policy
    return table(spark, folder, "documents").select(
        policy.alias("policy_id"),
        policy.alias("document_id"),
        (F.col("doc_id") + 1).alias("page_number"),
        F.regexp_replace("text", "(?m)^([DEL])", "## $1").alias("markdown"),
    )


def money_text(amount: Column, form: Column) -> Column:
    """Amount printed in one of three ways: R$ 1.234,50 / 1,234.50 / 1234.50."""
    grouped = F.format_number(amount, 2)
    brazilian = F.concat(F.lit("R$ "), F.translate(grouped, ",.", ".,"))
    return F.when(form == 0, brazilian).when(form == 1, grouped).otherwise(text(amount))


TERRITORIES = {
    "AMERICA": "América do Sul", "EUROPE": " EUROPA ", "AFRICA": "Exterior",
    "ASIA": "Ásia", "MIDDLE EAST": "Oriente  Médio",
}


def raw_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Ten raw facts per customer, as a model would answer them: JSON values in mixed notations."""
    money = "decimal(38,2)"
    price = F.col("o_totalprice").cast(money)
    orders = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(price).cast(money).alias("total"), F.max(price).alias("largest"), F.min(price).alias("smallest"),
        F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"),
    )
    places = (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    )
    base = table(spark, folder, "customer").join(orders, "c_custkey", "left").join(places, "c_nationkey", "left")
    key = F.col("c_custkey")
    currency = F.element_at(F.array(*[F.lit(c) for c in ("BRL", "USD", "EUR", "XXX")]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    other = F.when(currency == "BRL", F.lit("USD")).otherwise(F.lit("BRL"))
    territory = None
    for name, label in TERRITORIES.items():
        territory = (F if territory is None else territory).when(F.col("r_name") == name, F.lit(label))

    def amount(column: str, ordinal: int, code: Column) -> Column:
        printed = money_text(F.col(column).cast(money), (key + ordinal) % 3)
        return F.when(F.col(column).isNotNull(), F.to_json(F.struct(printed.alias("amount"), code.alias("currency"))))

    period = F.concat(F.date_format("first", "dd/MM/yyyy"), F.lit(" a "), F.date_format("last", "dd/MM/yyyy"))
    values = [
        amount("total", 1, currency),
        amount("largest", 2, currency),
        amount("smallest", 3, F.when(key % 11 == 0, other).otherwise(currency)),
        F.when(F.col("n") > 0, F.concat(F.lit('"'), period, F.lit('"'))),
        F.when(F.col("n") > 0, text(F.col("n"))),
        F.to_json(F.struct(territory.alias("text"))),
        F.to_json(F.struct(F.concat(F.lit(" Exclusão  "), F.col("c_mktsegment")).alias("text"))),
        amount("c_acctbal", 8, currency),
        F.when(F.col("n") > 0, F.to_json(F.struct(F.date_format("first", "d-M-yyyy").alias("date")))),
        F.to_json(F.struct(F.concat(text(key % 7), F.lit(",50%")).alias("number"))),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("ordinal"), F.lit(code).alias("field_code"), value.alias("value_json"))
            for i, (code, value) in enumerate(zip(FIELD_CODES, values), start=1)
        ]
    )
    # One row per policy is shuffled here, before it becomes ten: the windows and
    # aggregates over a policy that follow find this partitioning and add none.
    exploded = partition_by(base.withColumn("policy_id", text(key)), "policy_id").select(
        "policy_id", "c_custkey", rows.alias("rows")  # printed here, since generators do not compile what they hold
    ).select("policy_id", "c_custkey", F.inline("rows"))
    place = key + F.col("ordinal")
    status = (
        F.when((place % 17 == 0) | F.col("value_json").isNull(), F.lit("NOT_FOUND"))
        .when(place % 13 == 0, F.lit("AMBIGUOUS"))
        .otherwise(F.lit("FOUND"))
    )
    ids = F.array(F.concat(F.lit("ev_"), text(key), F.lit("_"), text(F.col("ordinal"))))
    return exploded.select(
        "policy_id",
        "field_code",
        "ordinal",
        status.alias("status"),
        "value_json",
        ((place % 10) / 10.0).alias("confidence"),
        F.when(status == "NOT_FOUND", F.array().cast("array<string>")).otherwise(ids).alias("evidence_ids"),
        (place % 19 == 0).alias("requires_human_review"),
    )


def parsed_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Raw facts with their type and raw value."""
    return compute_once(
        raw_facts(spark, folder).withColumn("field_type", field_attribute(F.col("field_code"), "field_type")),
        value=parse_value(F.col("field_type"), F.col("value_json")),
    )


def fact_id() -> Column:
    return F.concat(F.lit("FAC-"), F.col("policy_id"), F.lit("-"), F.col("field_code"))


def review_targets(spark: SparkSession, folder: str) -> DataFrame:
    """What a decision needs of a fact: id, field and raw value; no rule or normalised value takes part."""
    return parsed_facts(spark, folder).select(fact_id().alias("fact_id"), "field_code", "value")


def normalized_facts(spark: SparkSession, folder: str) -> DataFrame:
    raw = parsed_facts(spark, folder)
    found = F.col("status") == "FOUND"
    normalized = normalize_once(raw, "normalized_value", F.col("field_type"), F.col("value"), found)
    return compute_once(normalized, fact_id=fact_id())


def checked_facts(spark: SparkSession, folder: str) -> DataFrame:
    return validate_normalized(normalized_facts(spark, folder))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring customers as ordered pairs."""
    keys = table(spark, folder, "customer").select("c_custkey")
    following = keys.select((F.col("c_custkey") - 1).alias("c_custkey"))
    return keys.join(following, "c_custkey", "left_semi").select(
        text(F.col("c_custkey")).alias("policy_id_a"), text(F.col("c_custkey") + 1).alias("policy_id_b")
    )


def fx_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("USD", "5.25"), ("eur", "6.10")], "currency string, rate string")


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Review decisions from events: the user is the policy, the event picks field, decision and value."""
    event = F.col("event_id")
    code = F.element_at(F.array(*[F.lit(c) for c in FIELD_CODES]), (event % 10 + 1).cast("int"))
    kind = field_attribute(code, "field_type")
    amount = text(F.col("value").cast("decimal(18,2)"))
    value = (
        F.when(kind == "money", F.concat(F.lit('"R$ '), F.translate(amount, ".", ","), F.lit('"')))
        .when(kind == "number", amount)
        .when(kind == "period", F.concat(F.lit('"01/01/2024 a '), F.date_format("ts", "dd/MM/yyyy"), F.lit('"')))
        .when(kind == "date", F.concat(F.lit('{"date":"'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"}')))
        .otherwise(F.when(event % 2 == 0, F.lit('"Brasil"')).otherwise(F.lit('{"text":"  "}')))
    )
    decision = (
        F.when(F.col("event_type") == "click", F.lit("CONFIRMADO"))
        .when(F.col("event_type").isin("purchase", "error"), F.lit("CORRIGIDO"))
        .when(F.col("event_type") == "view", F.lit("DIVERGENTE"))
        .otherwise(F.lit("OUTRO"))
    )
    prefix = F.when(event % 50 == 49, F.lit("FAC-x-")).otherwise(F.concat(F.lit("FAC-"), text(F.col("user_id")), F.lit("-")))
    return table(spark, folder, "events").select(
        F.concat(prefix, code).alias("fact_id"),
        decision.alias("decision"),
        F.concat(F.lit("rev"), text(F.col("user_id") % 5)).alias("decided_by"),
        F.when(F.col("event_type").isin("click", "purchase"), value).alias("value_json"),
        F.when(event % 3 == 0, F.lit("nota")).alias("note"),
        F.col("ts").alias("decided_at"),
        event.alias("seq"),
    )


def last_line(column: str = "text") -> Column:
    """Last non-empty line."""
    return strip(F.element_at(F.split(strip(F.col(column)), "\n"), -1))


def document_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Three answers per document that quote its last line, and, for some, the words of a conversation."""
    talks = table(spark, folder, "conversations").filter("turn = 0").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("said"))
    docs = table(spark, folder, "documents").join(talks, "doc_id", "left")
    doc = F.col("doc_id")
    last_chunk = F.greatest(F.lit(0), F.ceil((F.length(strip(F.col("text"))) - 800) / F.lit(700))).cast("string")
    chunk = lambda index: F.concat(F.lit("ev_"), text(doc), F.lit(":p1:c"), index)
    ids = F.array(chunk(F.lit("0")), chunk(last_chunk), F.when(doc % 29 == 0, F.lit("ev_x")))
    ids = F.array_compact(ids)
    quote = last_line()
    values = [
        ("limite_agregado", F.to_json(F.struct(text(F.col("n_chars")).alias("amount"), quote.alias("raw_text"), F.col("said").alias("trecho")))),
        ("prazo_notificacao_sinistro", text(F.col("n_chars"))),
        ("exclusoes_chave", F.to_json(F.struct(F.concat(F.lit("diz “"), quote, F.lit("” e mais")).alias("text")))),
    ]
    items = F.array(*[F.struct(F.lit(c).alias("field_code"), v.alias("value")) for c, v in values])
    return docs.select("doc_id", ids.alias("evidence_ids"), F.posexplode(items).alias("position", "item")).select(
        text(doc).alias("policy_id"),
        "position",
        "item.field_code",
        F.lit("FOUND").alias("status"),
        "item.value",
        F.when((doc % 31 == 0) & (F.col("position") == 1), F.lit(1.5)).otherwise(F.lit(0.5)).alias("confidence"),
        "evidence_ids",
        F.lit(False).alias("requires_human_review"),
    )


ANSWERED_FIELDS = ["limite_agregado", "prazo_notificacao_sinistro", "exclusoes_chave"]


def usage(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    model = F.when(k % 3 == 0, F.lit("gemini-2.0-flash")).when(k % 3 == 1, F.lit("xiaomi/mimo-v2.6-pro")).otherwise(F.lit("outro"))
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("kind"),
        model.alias("model_name"),
        F.floor(F.col("value") * 100).cast("bigint").alias("request_tokens"),
        F.floor(F.col("value") * 10).cast("bigint").alias("response_tokens"),
        (k * 3).alias("latency_ms"),
        F.col("event_id").alias("seq"),
    )


STAGE_OF_EVENT = {
    "click": "RECEIVED", "view": "TEXT_EXTRACTED", "signup": "OCR_COMPLETED", "purchase": "INDEXED", "error": "FAILED",
}


def status_events(events: DataFrame) -> DataFrame:
    stage = None
    for name, label in STAGE_OF_EVENT.items():
        stage = (F if stage is None else stage).when(F.col("event_type") == name, F.lit(label))
    progress = (
        F.when(stage == "TEXT_EXTRACTED", F.lit(0.3)).when(stage == "OCR_COMPLETED", F.lit(0.5)).when(stage == "INDEXED", F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return events.select(
        F.concat(F.lit("doc"), text(F.col("user_id"))).alias("document_id"),
        F.col("event_id").alias("seq"),
        stage.alias("stage"),
        progress.alias("progress"),
        F.when(stage == "FAILED", F.lit("OCR: erro")).alias("message"),
    )


def expected_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as a reference set: quality 1 expects a number, 0 expects nothing."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, folder, "labels").join(docs, "doc_id")
    found = F.col("quality") == 1
    return labels.select(
        F.concat(F.lit("caso"), text(F.col("doc_id"))).alias("case_id"),
        text(F.col("doc_id")).alias("policy_id"),
        F.lit("prazo_notificacao_sinistro").alias("field_code"),
        F.when(found, F.lit("FOUND")).otherwise(F.lit("NOT_FOUND")).alias("status"),
        F.when(found, F.to_json(F.struct(text(F.col("n_chars")).alias("number")))).alias("expected_value"),
        F.when(found, last_line()).alias("evidence_quote"),
    )


def extracted_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Extraction results for the labelled documents; toxic ones are off by one, every eleventh is missing."""
    doc = F.col("doc_id")
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars").join(table(spark, folder, "labels"), "doc_id")
    status = F.when(doc % 5 == 0, F.lit("NOT_FOUND")).when(doc % 5 == 1, F.lit("AMBIGUOUS")).otherwise(F.lit("FOUND"))
    number = F.concat(text(F.col("n_chars") + F.col("toxic")), F.lit(",0"))
    value = F.to_json(F.struct(number.alias("number")))
    kind = F.lit("number")
    last_chunk = F.greatest(F.lit(0), F.ceil((F.length(strip(F.col("text"))) - 800) / F.lit(700))).cast("string")
    return docs.filter(doc % 11 != 0).select(
        text(doc).alias("policy_id"),
        F.lit("prazo_notificacao_sinistro").alias("field_code"),
        status.alias("status"),
        F.when(status == "FOUND", normalize_value(kind, parse_value(kind, value))).alias("normalized_value"),
        F.array(F.concat(F.lit("ev_"), text(doc), F.lit(":p1:c"), last_chunk)).alias("evidence_ids"),
    )


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """Eight notes per supplier; the nation of the supplier is the report."""
    items = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("criterion")) for i, c in enumerate(CRITERION_CODES, start=1)])
    return table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", F.inline(items)).select(
        F.col("s_nationkey").alias("report_key"),
        text(F.col("s_suppkey")).alias("policy_id"),
        F.col("s_suppkey").alias("input_pos"),
        "criterion",
        (((F.col("s_suppkey") * 7 + F.col("ordinal") * 3) % 101) / 10.0).alias("nota"),
    )


def supplier_reports(spark: SparkSession, folder: str) -> DataFrame:
    """One report per nation over its suppliers; the order in the report is the supplier key."""
    return table(spark, folder, "supplier").select(
        F.concat(F.lit("r"), text(F.col("s_nationkey"))).alias("report_id"),
        text(F.col("s_suppkey")).alias("policy_id"),
        F.col("s_suppkey").alias("doc_order"),
        F.lit("comparacao_documental").alias("profile_mode"),
    )


CELL_STATUSES = ["Previsto", "EXCLUIDO", "condicionado", "Não localizado", "ambiguo", "Talvez", "NAO_APLICAVEL"]


def cell_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Matrix answers per supplier and category, in the three accepted shapes."""
    statuses = ", ".join(sql_text(status) for status in CELL_STATUSES)
    payloads = []
    for number, (category, _) in enumerate(REPORT_CATEGORIES):
        fields = [(i, row[0]) for i, row in enumerate(REPORT_FIELD_TABLE, start=1) if row[1] == category]
        names = ", ".join(f"named_struct('o', {i}, 'c', {sql_text(code)})" for i, code in fields)
        listed = f"""transform(filter(array({names}), f -> (s_suppkey + f.o) % 4 != 1), f -> named_struct(
            'field_code', f.c,
            'status', element_at(array({statuses}), cast((s_suppkey + f.o) % 7 + 1 as int)),
            'limite_franquia', if((s_suppkey + f.o) % 3 = 0, concat(' até ', s_suppkey + f.o), null),
            'exclusoes_condicoes', if((s_suppkey + f.o) % 4 = 0, ' | ressalva\\n', null),
            'referencia', if((s_suppkey + f.o) % 5 != 0, concat('doc ', s_suppkey, ' · pág. ', f.o), null),
            'origem', case (s_suppkey + f.o) % 6 when 0 then 'Interpretacao' when 1 then 'suposição' end))"""
        shapes = [
            listed,
            f"named_struct('cells', {listed})",
            f"map_from_entries(transform({listed}, c -> named_struct('k', c.field_code, 'v', c)))",
        ]
        payloads.append(f"named_struct('category', {sql_text(category)}, 'payload', to_json({shapes[number % 3]}))")
    rows = F.expr("array(" + ", ".join(payloads) + ")")
    return table(spark, folder, "supplier").select(text(F.col("s_suppkey")).alias("policy_id"), F.inline(rows))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """User turns as questions over all policies."""
    return table(spark, folder, "conversations").filter("role = 'user'").select(
        F.concat_ws("-", text(F.col("conv_id")), text(F.col("turn"))).alias("query_id"),
        F.col("conv_id"),
        F.col("text").alias("query"),
    )


def order_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates in the accepted notations and in three that must be refused."""
    key = F.col("o_orderkey")
    day = F.col("o_orderdate")
    printed = (
        F.when(key % 6 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(key % 6 == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(key % 6 == 2, F.concat(F.lit(" "), F.date_format(day, "d-M-yyyy"), F.lit(" ")))
        .when(key % 6 == 3, F.date_format(day, "yyyy/MM/dd"))
        .when(key % 6 == 4, F.concat(F.lit("31/02/"), F.date_format(day, "yyyy")))
        .otherwise(F.date_format(day, "dd/MM-yyyy"))
    )
    return table(spark, folder, "orders").select("o_orderkey", printed.alias("raw"))


def order_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals in mixed notations, with refused and glued ones."""
    key = F.col("o_orderkey")
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    printed = (
        F.when(key % 7 < 3, money_text(amount, key % 7))
        .when(key % 7 == 3, F.concat(text(amount), F.lit(" % ou "), text(key % 10)))
        .when(key % 7 == 4, F.concat(F.lit("1.000."), text(key)))
        .when(key % 7 == 5, F.concat(F.lit("-"), F.translate(text(amount), ".", ",")))
        .otherwise(F.lit("sem valor"))
    )
    return table(spark, folder, "orders").select("o_orderkey", printed.alias("raw"))
