"""Report matrix, special sections, checklist (O56, O101-O105, O110, O111).

Reports are keyed: ``reports(report_id, policy_id, doc_order)`` lists the
policies of each report, so any number of reports runs in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.catalog import (
    CHECKLIST,
    CONCLUSION_TITLES,
    COVERAGE_STATUSES,
    NEEDS_CONFIRMATION,
    NOT_LOCATED,
    ORIGINS,
    REPORT_CATEGORIES,
    REPORT_FIELD_TABLE,
    SCENARIO_CAVEAT,
    literal_array,
    literal_map,
    sql_text,
)
from clauselake.functions.ids import report_id
from clauselake.functions.text import clean_optional, strip
from clauselake.functions.values import is_object
from clauselake.plans.once import compute_once

CELL_KEYS = [
    "field_code", "status", "limite_franquia", "exclusoes_condicoes", "impacto_pratico", "impacto_financeiro",
    "referencia", "origem",
]
CELL = "struct<" + ",".join(f"{key}:string" for key in CELL_KEYS) + ">"
REPORT_CODES = [row[0] for row in REPORT_FIELD_TABLE]


def with_report_id(policy_lists: DataFrame, prefix: str = "report:") -> DataFrame:
    """O111: id of each ordered list of policies, and the profile mode."""
    mode = F.when(F.coalesce("has_profile", F.lit(False)), F.lit("com_documentos_perfil")).otherwise(
        F.lit("comparacao_documental")
    )
    return policy_lists.withColumn("report_id", report_id(F.col("policy_ids"), prefix)).withColumn("profile_mode", mode)


def parse_cells(payload: Column) -> Column:
    """Cells of a payload: a list, ``{code: cell}``, or either under ``cells``; else an empty list."""
    wrapped = F.get_json_object(payload, "$.cells")
    body = F.coalesce(wrapped, payload)
    by_code = F.transform(
        F.map_entries(F.from_json(body, f"map<string,{CELL}>")),
        lambda entry: entry["value"].withField("field_code", entry["key"]),
    )
    listed = F.from_json(body, f"array<{CELL}>")
    cells = F.when(is_object(body), by_code).otherwise(listed)
    return F.coalesce(F.filter(cells, lambda cell: cell.isNotNull()), F.array().cast(f"array<{CELL}>"))


def parse_status(text: Column) -> Column:
    """O102: label or enum name; anything else needs confirmation."""
    raw = strip(F.coalesce(text, F.lit("")))
    status = None
    for name, label in COVERAGE_STATUSES:
        status = (F if status is None else status).when((raw == label) | (F.upper(raw) == name), F.lit(label))
    return status.otherwise(F.lit(NEEDS_CONFIRMATION))


def parse_origin(text: Column, status: Column) -> Column:
    """O102."""
    raw = F.lower(strip(F.coalesce(text, F.lit(""))))
    default = F.when(status == NOT_LOCATED, F.lit("nao_localizado")).otherwise(F.lit("fato"))
    return F.when(raw.isin(*ORIGINS), raw).otherwise(default)


def guarded_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """O102/O103: typed cells; a statement without a reference needs confirmation."""
    status = parse_status(F.col("status"))
    reference = clean_optional(F.col("referencia"))
    unsourced = (status != NOT_LOCATED) & reference.isNull()
    texts = ["limite_franquia", "exclusoes_condicoes", "impacto_pratico", "impacto_financeiro"]
    return cells.select(
        *keys,
        F.when(unsourced, F.lit(NEEDS_CONFIRMATION)).otherwise(status).alias("status"),
        *[clean_optional(F.col(name)).alias(name) for name in texts],
        reference.alias("referencia"),
        F.when(unsourced, F.lit("requer_confirmacao")).otherwise(parse_origin(F.col("origem"), status)).alias("origem"),
    )


def fill_matrix(policies: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O101: (ninety cells per policy, rejects).

    ``payloads(policy_id, category, payload)``: one answer per category and
    policy. A cell outside the catalog rejects its policy as a whole; a field
    without an answer is not located. The answer for a field's own category, or
    for a later one, counts; the last wins.
    """
    parsed = compute_once(payloads, cells=parse_cells(F.col("payload")))
    rejects = parsed.filter(_foreign_cell(F.col("cells"))).select("policy_id", "category", F.lit("LLM_SCHEMA_INVALID").alias("error_code"))
    # The answers of a policy, one per category, meet in one row, so its cells are never exchanged one by one.
    met = payloads.groupBy("policy_id").agg(
        F.array_sort(F.collect_list(F.struct(_category_ordinal(F.col("category")), "payload"))).alias("answers")
    )
    answers = F.transform("answers", lambda a: F.struct(a["c"].alias("c"), parse_cells(a["payload"]).alias("cells")))
    met = compute_once(met, answers=answers)
    own_category = literal_map({code: category for code, category, _, _ in REPORT_FIELD_TABLE})

    def counting(answer: Column) -> Column:
        return F.filter(answer["cells"], lambda cell: answer["c"] >= _category_ordinal(F.try_element_at(own_category, cell["field_code"])))

    met = compute_once(
        met,
        foreign=F.exists("answers", lambda a: _foreign_cell(a["cells"])),
        answers=F.reverse(F.flatten(F.transform("answers", counting))),
    )
    met = compute_once(met, codes=F.transform("answers", lambda cell: cell["field_code"]))
    last = F.filter("answers", lambda cell, i: F.array_position("codes", cell["field_code"]) == i + 1)
    met = compute_once(met, latest=F.map_from_entries(F.transform(last, lambda cell: F.struct(cell["field_code"], cell))))
    # Spark's estimate of a row knows nothing of the ninety cells in it: neither side may be taken for a small one.
    found = met.select("policy_id", "foreign", "latest").hint("merge")
    accepted = policies.select("policy_id").join(found, "policy_id", "left").filter(~F.coalesce("foreign", F.lit(False)))
    fields = F.expr(
        "array("
        + ", ".join(
            f"named_struct('field_code', {sql_text(code)}, 'ordinal', {i}, 'category', {sql_text(category)})"
            for i, (code, category, _, _) in enumerate(REPORT_FIELD_TABLE, start=1)
        )
        + ")"
    )
    grid = accepted.select("policy_id", "latest", F.inline(fields))
    grid = compute_once(grid, cell=F.try_element_at("latest", F.col("field_code")))
    keys = ["policy_id", "field_code", "ordinal", "category"]
    values = [F.col(f"cell.{name}").alias(name) for name in CELL_KEYS if name != "field_code"]
    answered = F.col("answered")
    cells = (
        guarded_cells(grid.select(*keys, F.col("cell").isNotNull().alias("answered"), *values), [*keys, "answered"])
        .withColumn("status", F.when(answered, F.col("status")).otherwise(F.lit(NOT_LOCATED)))
        .withColumn("origem", F.when(answered, F.col("origem")).otherwise(F.lit("nao_localizado")))
        .drop("answered")
    )
    return cells, rejects


def _foreign_cell(cells: Column) -> Column:
    """Whether a cell's field is outside the catalog."""
    known = literal_array(REPORT_CODES)
    return F.exists(cells, lambda cell: ~F.coalesce(F.array_contains(known, cell["field_code"]), F.lit(False)))


def _category_ordinal(category: Column) -> Column:
    return F.array_position(literal_array([code for code, _ in REPORT_CATEGORIES]), category).alias("c")


IDENTIFICATION = (
    "struct<seguradora:string,produto:string,processo_susep:string,versao_data:string,publico_alvo:string,"
    "empresa_aberta_fechada:string,secoes_natureza:array<string>,num_paginas:string,"
    "coberturas_descritas:array<string>,limitacoes:array<string>,ausentes:string>"
)


def identification(answers: DataFrame) -> DataFrame:
    """O104: identification answers ``(policy_id, payload)`` -> typed attributes."""
    parsed = answers.select("policy_id", F.from_json(F.coalesce("payload", F.lit("{}")), IDENTIFICATION).alias("i"))
    company = clean_optional(F.col("i.empresa_aberta_fechada"))
    pages = F.when(F.col("i.num_paginas").rlike("^-?[0-9]+$"), F.col("i.num_paginas").try_cast("int"))
    empty = F.array().cast("array<string>")
    absent = F.from_json("i.ausentes", "array<string>")
    plain = ["seguradora", "produto", "processo_susep", "versao_data", "publico_alvo"]
    lists = ["secoes_natureza", "coberturas_descritas", "limitacoes"]
    return parsed.select(
        "policy_id",
        *[clean_optional(F.col(f"i.{name}")).alias(name) for name in plain],
        F.when(company.isin("aberta", "fechada", "ambas"), company).alias("empresa_aberta_fechada"),
        pages.alias("num_paginas"),
        *[F.coalesce(F.col(f"i.{name}"), empty).alias(name) for name in lists],
        F.when(F.col("i.ausentes").startswith("["), F.array_join(absent, ", ")).otherwise(F.col("i.ausentes")).alias(
            "ausentes"
        ),
    )


def special_tables(answers: DataFrame, reports: DataFrame) -> DataFrame:
    """O105: special tables: one row per table row and policy of the report; blank cells are null."""
    schema = "array<struct<code:string,title:string,rows:array<struct<label:string,cells:map<string,string>>>>>"
    tables = answers.select(
        "report_id", F.posexplode(F.from_json("payload", schema)).alias("table_order", "table")
    )
    rows = tables.select(
        "report_id", "table_order",
        F.coalesce("table.code", F.lit("")).alias("code"),
        F.coalesce("table.title", F.lit("")).alias("title"),
        F.posexplode("table.rows").alias("row_order", "row"),
    )
    return rows.join(reports, "report_id").select(
        "report_id", "table_order", "code", "title", "row_order",
        F.coalesce("row.label", F.lit("")).alias("label"), "policy_id", "doc_order",
        clean_optional(F.try_element_at("row.cells", F.col("policy_id"))).alias("cell"),
    )


def scenario_findings(answers: DataFrame, reports: DataFrame) -> DataFrame:
    """O105: hypothetical scenarios per policy, always with the fixed caveat."""
    schema = "array<struct<name:string,policy_findings:map<string,string>>>"
    scenarios = answers.select("report_id", F.posexplode(F.from_json("payload", schema)).alias("scenario_order", "s"))
    return scenarios.join(reports, "report_id").select(
        "report_id", "scenario_order", F.coalesce("s.name", F.lit("")).alias("name"), "policy_id", "doc_order",
        F.coalesce(F.try_element_at("s.policy_findings", F.col("policy_id")), F.lit("")).alias("finding"),
        F.lit(SCENARIO_CAVEAT).alias("caveat"),
    )


def conclusions(answers: DataFrame) -> DataFrame:
    """O105: the eight fixed conclusion keys of each report; a missing key is an empty list."""
    payload = F.from_json("payload", "map<string,string>")
    keys = F.array(
        *[
            F.struct(F.lit(i).alias("key_order"), F.lit(key).alias("key"), F.lit(title).alias("title"))
            for i, (key, title) in enumerate(CONCLUSION_TITLES, start=1)
        ]
    )
    return answers.select("report_id", payload.alias("__payload"), F.inline(keys)).select(
        "report_id", "key_order", "key", "title",
        F.coalesce(F.try_element_at("__payload", F.col("key")), F.lit("[]")).alias("value_json"),
    )


def checklist(cells: DataFrame, reports: DataFrame, flags: DataFrame, identifications: DataFrame) -> DataFrame:
    """O110: the fourteen checks of every report.

    ``flags(report_id, <external flags>, dados_financeiros_disponiveis,
    informative_only)``. Cells reduce to per-report sums by partial aggregates;
    no report collects its cells.
    """
    member = reports.select("report_id", "policy_id")
    filled = F.col("status") != NOT_LOCATED
    code = F.col("field_code")
    notices = ["base_ocorrencia_claims_made", "notificacao_quem_prazo_forma"]
    must_fill = ["lmg", "lmi", "limite_agregado", "sublimites", "protecao_direta_administrador_ab_side", "protecao_sociedade_c_side"]
    sums = cells.join(member.hint("merge"), "policy_id").groupBy("report_id").agg(
        F.count_distinct("policy_id").alias("policies"),
        *[F.count_if(filled & (code == name)).alias(f"n_{name}") for name in [*must_fill, *notices]],
        F.count_if(
            (F.col("category") == "coberturas_extensoes") & (F.col("status") == "Previsto") & F.col("referencia").isNull()
        ).alias("bad_extensions"),
        F.count_if((F.col("category") == "custos_defesa") & filled).alias("n_defense"),
        F.count_if((F.col("category") == "exclusoes") & F.col("exclusoes_condicoes").isNotNull()).alias("n_conditions"),
        F.count_if(~filled & (F.col("origem") != "nao_localizado")).alias("bad_gaps"),
    )
    companies = (
        member.join(identifications.select("policy_id", "empresa_aberta_fechada"), "policy_id")
        .groupBy("report_id")
        .agg(F.bool_and(F.col("empresa_aberta_fechada").isNotNull()).alias("companies_known"))
    )
    joined = flags.join(sums, "report_id", "left").join(companies, "report_id", "left")

    def all_filled(names: list[str]) -> Column:
        result = F.lit(True)
        for name in names:
            result = result & (F.col(f"n_{name}") > 0)
        return result

    enough = F.least(F.lit(2), F.col("policies"))
    computed = {
        "computed:extensoes": F.coalesce(F.col("bad_extensions") == 0, F.lit(True)),
        "computed:limites": all_filled(must_fill[:4]),
        "computed:custos": F.col("n_defense") > 0,
        "computed:notificacoes": (F.col(f"n_{notices[0]}") >= enough) & (F.col(f"n_{notices[1]}") >= enough),
        "computed:exclusoes": F.col("n_conditions") > 0,
        "computed:sociedade": all_filled(must_fill[4:]),
        "computed:empresa": F.col("companies_known"),
        "computed:financeiro": F.coalesce("dados_financeiros_disponiveis", F.lit(False))
        | F.coalesce("informative_only", F.lit(False)),
        "computed:lacunas": F.coalesce(F.col("bad_gaps") == 0, F.lit(True)),
    }
    items = F.array(
        *[
            F.struct(
                F.lit(i).alias("item_order"),
                F.lit(item).alias("item"),
                F.coalesce(computed[source] if source in computed else F.col(source), F.lit(False)).alias("ok"),
            )
            for i, (source, item) in enumerate(CHECKLIST, start=1)
        ]
    )
    return joined.select("report_id", F.inline(items))
