"""Markdown and JSON exports.

An export is first a table of lines with a sort key, which any number of
documents share; a document is assembled only when it is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.catalog import field_attribute
from clauselake.functions.values import value_pairs
from clauselake.plans.assemble import ordered_text
from clauselake.sources.bundles import write_bundles

DASH = "—"
PIECE_KEYS = 1024


def comparison_markdown(comparisons: DataFrame) -> DataFrame:
    """One Markdown document per comparison; a comparison has ten fields."""
    label = field_attribute(F.col("field_code"), "label")

    def value(name: str) -> Column:
        return F.coalesce(value_pairs(F.col("field_type"), F.col(f"valor_{name}")), F.lit("ausente"))

    def ids(name: str) -> Column:
        return F.when(F.size(f"evidencias_{name}") > 0, F.array_join(f"evidencias_{name}", ", ")).otherwise(F.lit(DASH))

    block = F.concat(
        F.lit("## "), label, F.lit(" (`"), F.col("field_code"), F.lit("`)\n\n- **Resultado:** "),
        F.coalesce("resultado", F.lit(DASH)), F.lit(" (direção: "), F.coalesce("direcao", F.lit(DASH)), F.lit(")\n- **Valor A:** "),
        value("a"), F.lit("\n- **Valor B:** "), value("b"),
        F.lit("\n- **Evidências A:** "), ids("a"), F.lit("\n- **Evidências B:** "), ids("b"),
        F.lit("\n- **Explicação:** "), F.when(F.coalesce("explicacao", F.lit("")) != "", F.col("explicacao")).otherwise(F.lit("pendente")),
        F.lit("\n"),
    )
    head = F.concat(
        F.lit("# Comparação de Apólices D&O — Resumo da Análise\n\n- **ComparisonId:** `"), F.col("comparison_id"),
        F.lit("`\n- **Apólice A:** "), F.col("policy_id_a"), F.lit("\n- **Apólice B:** "), F.col("policy_id_b"), F.lit("\n\n"),
    )
    return (
        comparisons.groupBy("comparison_id", "policy_id_a", "policy_id_b")
        .agg(ordered_text(F.col("ordinal"), block).alias("__fields"))
        .select("comparison_id", F.concat(head, F.col("__fields")).alias("markdown"))
    )


def write_documents(documents: DataFrame, path: str, key: str, text: str = "markdown") -> DataFrame:
    """Documents in bundle files; returns the index that tells where each one stands."""
    return write_bundles(documents, path, key, text)


def escape_cell(text: Column) -> Column:
    """Table cell: pipes escaped, line breaks as blanks; missing is a dash."""
    shown = F.when(F.coalesce(text, F.lit("")) == "", F.lit(DASH)).otherwise(text)
    return F.replace(F.replace(shown, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def row_line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def number_cell(number: Column) -> Column:
    """Two decimals with a comma."""
    return F.replace(F.format_string("%.2f", number.cast("double")), F.lit("."), F.lit(","))


def _line(section: int, order: list[Column], text: Column) -> list[Column]:
    """Section number, three sort keys and the line."""
    keys = [*order, *[F.lit(-1)] * (3 - len(order))]
    return [
        "report_id", F.lit(section).alias("section"),
        *[F.coalesce(k.cast("bigint"), F.lit(-1)).alias(f"k{i}") for i, k in enumerate(keys, start=1)],
        text.alias("line"),
    ]


def _at(number: Column) -> Column:
    return number.cast("bigint")


LAST = 1 << 62  # sort key behind all numbers
MATRIX_HEADERS = [
    "Categoria", "Campo", "Importância", "Documento", "Status de contratação", "Limite/franquia",
    "Exclusões e condições", "Impacto prático", "Impacto financeiro", "Referência documental",
]
IDENTIFICATION_FIELDS = [
    ("seguradora", "Seguradora"), ("produto", "Produto"), ("processo_susep", "Processo SUSEP"),
    ("versao_data", "Versão/data"), ("publico_alvo", "Público-alvo"),
    ("empresa_aberta_fechada", "Empresa aberta/fechada"), ("num_paginas", "Nº de páginas"),
    ("secoes_natureza", "Seções/natureza"), ("coberturas_descritas", "Coberturas descritas"),
    ("limitacoes", "Limitações"), ("ausentes", "Ausentes"),
]
# The note on traceability that closes every report, line by line.
TRACE_LINES = [
    "",
    "Toda célula com status diferente de \"Não localizado\" carrega referência documental",
    "(arquivo/página/seção); célula sem lastro documental foi rebaixada para",
    "\"Requer confirmação\" — nada de afirmação sem fonte.",
    "",
    "- **fato:** trecho localizado no documento analisado;",
    "- **interpretacao:** leitura do texto pelo analista/agente (com referência);",
    "- **inferencia:** derivada de outros trechos — revisar antes de decidir;",
    "- **nao_localizado:** ausência no conjunto de documentos analisados — a ausência",
    "  é sempre relativa aos documentos analisados (rótulo oficial \"Não localizado\");",
    "- **requer_confirmacao:** sem lastro documental suficiente; confirmar com o corretor.",
    "",
]
HEADINGS = {
    1: "## 1. Identificação dos documentos analisados",
    5: "## 5. Matriz principal de comparação",
    6: "## 6. Tabelas especiais",
    7: "## 7. Cenários hipotéticos",
    8: "## 8. Ranking informativo (critérios e pesos)",
    9: "## 9. Conclusões",
    11: "## 11. Checklist de verificação final",
    12: "## 10. Nota de rastreabilidade",
}


def _gathered(order: str, cell: Column) -> Column:
    """Cells of one row in document order."""
    shown = F.when(F.coalesce(cell, F.lit("")) == "", F.lit(DASH)).otherwise(cell)
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), shown.alias("c")))), lambda s: s["c"])


def _wide_line(*first: Column, last: Column | None = None) -> Column:
    """A table line: some first cells, the gathered ones, perhaps a last one."""
    ends = [last] if last is not None else []
    return row_line(*first, F.array_join("cells", " | "), *ends)


def _wide_rule(first: int, cells: Column) -> Column:
    return F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), (cells + first).cast("int")))


def _ranking_lines(ids: DataFrame, members: DataFrame, ranking: DataFrame, contributions: DataFrame) -> list[DataFrame]:
    """Section 8: criteria as rows, two columns per ranked document, the base ranking with a column for the total.

    Documents stand in the order of their rank. Keys: 0 base, 1 note, 2 heading of 8.1, then the scenarios.
    """
    ranked = ranking.select("report_id", "scenario", "policy_id", "total", "rank").join(members, ["report_id", "policy_id"])
    number = F.concat(F.lit("Doc "), F.col("doc_order").cast("string"))
    place = F.when(F.col("scenario_ordinal") == 0, F.lit(0)).otherwise(F.col("scenario_ordinal") + 2)
    scored = contributions.join(ranked, ["report_id", "scenario", "policy_id"])
    base = F.col("scenario_ordinal") == 0

    def lines(rows: DataFrame, key: Column, *first: Column, last: Column) -> DataFrame:
        wide = F.concat(_wide_line(*first), F.when(base, F.concat(F.lit(" "), last, F.lit(" |"))).otherwise(F.lit("")))
        return rows.select(*_line(8, [_at(place), key], wide))

    def pair(left: Column, right: Column) -> Column:
        return _gathered("rank", F.concat(left, F.lit(" | "), right)).alias("cells")

    by_criterion = scored.groupBy("report_id", "scenario", "scenario_ordinal", "ordinal", "label", "weight").agg(
        pair(number_cell(F.col("nota")), number_cell(F.col("contribution")))
    )
    sums = contributions.select("report_id", "scenario", "scenario_ordinal", "ordinal", "weight").distinct().groupBy(
        "report_id", "scenario", "scenario_ordinal").agg(F.sum("weight").alias("weight"))
    per_scenario = ranked.join(sums, ["report_id", "scenario"]).groupBy("report_id", "scenario", "scenario_ordinal", "weight")
    heads = per_scenario.agg(pair(F.concat(F.lit("Nota "), number), F.concat(F.lit("Contribuição "), number)))
    totals = per_scenario.agg(pair(F.lit(DASH), number_cell(F.col("total"))))
    columns = F.size("cells") * 2 + F.when(base, 1).otherwise(0)
    return [
        ids.select(*_line(8, [F.lit(2)], F.lit("\n### 8.1 Cenários de sensibilidade\n"))),
        heads.filter(~base).select(*_line(8, [_at(place), F.lit(0)], F.concat(F.lit("\n#### Cenário: "), F.col("scenario"), F.lit("\n")))),
        lines(heads, F.lit(1), F.lit("Critério"), F.lit("Peso"), last=F.lit("Total")),
        heads.select(*_line(8, [_at(place), F.lit(2)], _wide_rule(2, columns))),
        lines(by_criterion, _at(F.col("ordinal") + 2), escape_cell(F.col("label")), number_cell(F.col("weight")), last=F.lit(DASH)),
        lines(totals, F.lit(LAST), F.lit("**Total**"), number_cell(F.col("weight")), last=F.lit(DASH)),
    ]


def report_lines(
    reports: DataFrame,
    cells: DataFrame,
    fields: DataFrame,
    checklist: DataFrame,
    identifications: DataFrame | None = None,
    tables: DataFrame | None = None,
    scenarios: DataFrame | None = None,
    ranking: DataFrame | None = None,
    contributions: DataFrame | None = None,
    guard: DataFrame | None = None,
    conclusions: DataFrame | None = None,
) -> DataFrame:
    """The report as lines ``(report_id, section, k1, k2, k3, line)``.

    ``reports(report_id, policy_id, doc_order, profile_mode)``. Sorting by the
    five keys gives the document, so a report of any width is written without
    gathering it: each line is produced where its data lies. ``fields`` is the
    fixed table of ninety fields. Documents are numbered 1 to N within their
    report; tables and ranking have one column per document of the report, so
    a line of theirs gathers the cells of one row.

    ``ranking(report_id, scenario, policy_id, total, rank)``; ``contributions
    (report_id, scenario, scenario_ordinal, ordinal, label, weight, policy_id,
    nota, contribution)``, scenario ordinal 0 being the base ranking.
    """
    in_report = Window.partitionBy("report_id").orderBy("doc_order", "policy_id")
    reports = reports.withColumn("doc_order", F.row_number().over(in_report))
    members = reports.select("report_id", "policy_id", "doc_order")
    number = F.concat(F.lit("Doc "), F.col("doc_order").cast("string"))
    label = F.concat(number, F.lit(" ("), F.col("policy_id"), F.lit(")"))
    ids = reports.select("report_id", "profile_mode").distinct()
    title = F.array(
        *[
            F.struct(F.lit(i).alias("o"), text.alias("t"))
            for i, text in enumerate(
                [
                    F.lit("# Relatório D&O — Comparação de Apólices"),
                    F.lit(""),
                    F.concat(F.lit("- **ReportId:** `"), F.col("report_id"), F.lit("`")),
                    F.concat(F.lit("- **Modo de perfil:** "), F.col("profile_mode")),
                ]
            )
        ]
    )
    parts = [
        ids.select("report_id", F.inline(title)).select(*_line(0, [_at(F.col("o"))], F.col("t"))),
        reports.select(*_line(0, [_at(F.lit(9)), _at(F.col("doc_order"))], F.concat(F.lit("- **Documento:** "), label))),
    ]
    for section, text in HEADINGS.items():
        heading = F.concat(F.lit("\n" + text + "\n"))
        parts.append(ids.select(*_line(section, [F.lit(-1)], heading)))

    header = row_line(*[F.lit(h) for h in MATRIX_HEADERS])
    rule = F.lit("|" + "|".join([" --- "] * len(MATRIX_HEADERS)) + "|")
    parts.append(ids.select(*_line(5, [_at(F.lit(0))], header)))
    parts.append(ids.select(*_line(5, [_at(F.lit(0)), F.lit(1)], rule)))
    named = cells.drop("category", "ordinal").join(F.broadcast(fields), "field_code").join(reports, "policy_id")
    matrix = row_line(
        escape_cell(F.col("category_label")), escape_cell(F.col("label")), escape_cell(F.col("importance")),
        escape_cell(label), escape_cell(F.col("status")),
        *[
            escape_cell(F.col(c))
            for c in ("limite_franquia", "exclusoes_condicoes", "impacto_pratico", "impacto_financeiro", "referencia")
        ],
    )
    parts.append(named.select(*_line(5, [_at(F.col("ordinal")), _at(F.col("doc_order"))], matrix)))

    if identifications is not None:
        joined = reports.join(identifications.withColumn("__read", F.lit(True)), "policy_id", "left")
        unread = F.col("__read").isNull()
        lines = [F.struct(F.lit(0).alias("o"), F.concat(F.lit("\n### "), number, F.lit(" — "), F.col("policy_id"), F.lit("\n")).alias("t"))]
        lines.append(F.struct(F.lit(1).alias("o"), F.when(unread, F.lit("- **Situação:** identificação não localizada")).alias("t")))
        kinds = dict(identifications.dtypes)
        for i, (name, text) in enumerate(IDENTIFICATION_FIELDS, start=2):
            value = F.array_join(name, ", ") if kinds[name].startswith("array") else F.col(name).cast("string")
            shown = F.when(F.coalesce(value, F.lit("")) == "", F.lit("Não localizado")).otherwise(value)
            lines.append(F.struct(F.lit(i).alias("o"), F.when(~unread, F.concat(F.lit(f"- **{text}:** "), shown)).alias("t")))
        parts.append(
            joined.select("report_id", "doc_order", F.inline(F.array(*lines))).filter(F.col("t").isNotNull()).select(
                *_line(1, [_at(F.col("doc_order")), _at(F.col("o"))], F.col("t"))
            )
        )
    if tables is not None:
        heads = tables.select("report_id", "table_order", "title", "code").distinct()
        title = F.concat(F.lit("\n### "), F.col("title"), F.lit(" (`"), F.col("code"), F.lit("`)\n"))
        parts.append(heads.select(*_line(6, [_at(F.col("table_order")), F.lit(-3)], title)))
        columns = members.groupBy("report_id").agg(_gathered("doc_order", escape_cell(label)).alias("cells"))
        wide = heads.select("report_id", "table_order").join(columns, "report_id")
        parts.append(wide.select(*_line(6, [_at(F.col("table_order")), F.lit(-2)], _wide_line(F.lit("Item")))))
        parts.append(wide.select(*_line(6, [_at(F.col("table_order")), F.lit(-1)], _wide_rule(1, F.size("cells")))))
        rows = tables.drop("doc_order").join(members, ["report_id", "policy_id"]).groupBy("report_id", "table_order", "row_order", "label").agg(
            _gathered("doc_order", escape_cell(F.col("cell"))).alias("cells")
        )
        parts.append(
            rows.select(*_line(6, [_at(F.col("table_order")), _at(F.col("row_order"))], _wide_line(escape_cell(F.col("label")))))
        )
    if scenarios is not None:
        scenarios = scenarios.drop("doc_order").join(members, ["report_id", "policy_id"])
        heads = scenarios.select("report_id", "scenario_order", "name", "caveat").distinct()
        parts.append(heads.select(*_line(7, [_at(F.col("scenario_order"))], F.concat(F.lit("### "), F.col("name")))))
        parts.append(heads.select(*_line(7, [_at(F.col("scenario_order")), F.lit(LAST)], F.concat(F.lit("> "), F.col("caveat")))))
        shown = F.when(F.col("finding") == "", F.lit(DASH)).otherwise(F.col("finding"))
        finding = F.concat(F.lit("- **"), label, F.lit(":** "), shown)
        parts.append(scenarios.select(*_line(7, [_at(F.col("scenario_order")), _at(F.col("doc_order"))], finding)))
    if ranking is not None and contributions is not None:
        parts += _ranking_lines(ids, members, ranking, contributions)
    if guard is not None:
        note = F.concat(F.lit("> **Ranking informativo, sem vencedora geral** — "), F.col("reason"))
        parts.append(guard.filter("informative_only").select(*_line(8, [F.lit(1)], F.concat(F.lit("\n"), note))))
    if conclusions is not None:
        parts.append(
            conclusions.select(
                *_line(9, [_at(F.col("key_order"))], F.concat(F.lit("### "), F.col("title"), F.lit(" (`"), F.col("key"), F.lit("`)")))
            )
        )
        items = F.from_json("value_json", "array<string>")
        pairs = F.transform(
            F.map_entries(F.from_json("value_json", "map<string,string>")),
            lambda e: F.concat(F.lit("**"), e["key"], F.lit(":** "), e["value"]),
        )
        listed = (
            F.when(F.col("value_json").startswith("["), items)
            .when(F.col("value_json").startswith("{"), pairs)
            .otherwise(F.array("value_json"))
        )
        filled = F.when(F.size(F.coalesce(listed, F.array().cast("array<string>"))) > 0, listed).otherwise(F.array(F.lit(DASH)))
        parts.append(
            conclusions.select("report_id", "key_order", F.posexplode(filled).alias("o", "t")).select(
                *_line(9, [_at(F.col("key_order")), _at(F.col("o"))], F.concat(F.lit("- "), F.col("t")))
            )
        )
    mark = F.when(F.col("ok"), F.lit("✓")).otherwise(F.lit("✗"))
    parts.append(
        checklist.select(*_line(11, [_at(F.col("item_order"))], F.concat(F.lit("- "), mark, F.lit(" "), F.col("item"))))
    )
    trace = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(t).alias("t")) for i, t in enumerate(TRACE_LINES)])
    parts.append(ids.select("report_id", F.inline(trace)).select(*_line(12, [_at(F.col("o"))], F.col("t"))))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines


def write_report_lines(lines: DataFrame, path: str) -> DataFrame:
    """Report lines in bundle files; a section is cut every ``PIECE_KEYS`` values of its first key. Returns the index."""
    piece = F.col("section").cast("bigint") * 2**40 + F.floor((F.col("k1") + 1) / PIECE_KEYS)
    return write_bundles(lines, path, "report_id", "line", ["section", "k1", "k2", "k3"], piece)


def write_evaluation(entries: DataFrame, path: str, run_id: str) -> None:
    """Evaluation entries as JSON under ``evaluation_{run_id}.json``."""
    entries.write.mode("overwrite").json(f"{path}/evaluation_{run_id}.json")
