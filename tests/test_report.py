import json
import random

from pyspark.sql import functions as F

from clauselake import catalog
from clauselake.operators import section_search
from clauselake.operators import insurer, ranking, report, usage
from clauselake.plans.ranking import integer_levels, rank_by_levels

C = F.col
NOTES = "policy_id string, input_pos int, criterion string, nota double"


def notes(spark, table):
    rows = [(p, i, c, n) for i, (p, values) in enumerate(table.items()) for c, n in zip(catalog.CRITERION_CODES, values) if n is not None]
    return spark.createDataFrame(rows, NOTES)


def test_ranking_formula_ties_and_rejects(spark):
    table = {"p1": [5.0] * 8, "p2": [8.0] * 8, "p3": [5.0] * 8, "ruim": [11.0] + [5.0] * 7, "falta": [5.0] * 7 + [None]}
    weights = catalog.default_weights(spark)
    got = ranking.compute_ranking(notes(spark, table), weights).orderBy("rank").collect()
    assert [(r["policy_id"], float(r["total"]), r["rank"]) for r in got] == [("p2", 80.0, 1), ("p1", 50.0, 2), ("p3", 50.0, 3)]
    rejects = {tuple(r) for r in ranking.ranking_rejects(notes(spark, table), weights, []).collect()}
    assert rejects == {("base", "ruim", "NOTE_OUT_OF_RANGE"), ("base", "falta", "CRITERION_WITHOUT_NOTE")}
    off = weights.withColumn("weight", C("weight") + 1)
    assert ranking.compute_ranking(notes(spark, table), off).count() == 0
    assert "WEIGHT_SUM_NOT_100" in {r["error_code"] for r in ranking.ranking_rejects(notes(spark, table), off, []).collect()}
    scaled, bad = ranking.normalize_weights(catalog.scenario_weights(spark))
    assert {round(r[0], 9) for r in scaled.groupBy("scenario").agg(F.sum("weight")).select("sum(weight)").collect()} == {100.0} and bad.count() == 0
    sensitivity = ranking.compute_sensitivity(notes(spark, {"a": [10.0] + [0.0] * 7}), catalog.scenario_weights(spark))
    assert {r["scenario_ordinal"]: float(r["total"]) for r in sensitivity.collect()} == {1: 33.333333, 2: round(2500 / 105, 6)}


def test_rank_by_levels_equals_a_plain_sort_with_one_huge_group(spark):
    rng = random.Random(2)
    rows = [(None if rng.random() < 0.1 else "g" if rng.random() < 0.8 else f"k{i % 7}", rng.choice([0, 1, 2, 3, None]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(6)
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    ranked = rank_by_levels(df, ["k"], [F.col("v"), *integer_levels(F.col("i"), 10)], [F.asc("i")], "n")
    assert len(jobs.getJobIdsForGroup(None)) == before  # a plan, no action
    got = {r["i"]: r["n"] for r in ranked.collect()}
    expected, seen = {}, {}
    for k, v, i in sorted(rows, key=lambda r: (r[0] or "", -1 if r[1] is None else r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        expected[i] = seen[k]
    assert got == expected


def test_feed_numbers_carry_no_texts(spark):
    rows = [("p", page, s, None if s % 2 else f"t{s}", f"text {page} {s}") for page in (3, 1, 2000, 5000) for s in range(3)] + [("q", 1, 4, None, "only")]
    sections = spark.createDataFrame(rows, "policy_id string, page_number int, section_index int, title string, text string")
    feed = section_search.markdown_feed(sections)
    got = {(r["policy_id"], r["text"]): (r["position"], r["source"]) for r in feed.collect()}
    ordered = sorted(r for r in rows if r[0] == "p")
    assert all(got["p", r[4]][0] == n for n, r in enumerate(ordered, start=1)) and got["q", "only"] == (1, "seção 1 · pág. 1")
    plan = feed._jdf.queryExecution().optimizedPlan().toString()
    assert all("text" not in line for line in plan.split("\n") if "Window" in line)


def test_guard_names_what_is_missing(spark):
    codes = [code for code, _ in catalog.GUARD_FACTS]
    rows = [("cheio", *[True] * 7, True), ("perfil", *[True] * 7, False), ("nada", None, *[True] * 6, True)]
    df = spark.createDataFrame(rows, "id string, " + ", ".join(f"{c} boolean" for c in codes) + ", profile_complete boolean")
    got = {r["id"]: (r["informative_only"], r["reason"]) for r in ranking.no_winner_guard(df, ["id"]).collect()}
    assert got["cheio"] == (False, None)
    assert "dados de perfil do contratante (" in got["perfil"][1] and "dados de prêmio (" in got["nada"][1]


def test_matrix_shapes_guard_and_rejects(spark):
    cell = {"status": "PREVISTO", "referencia": "pág. 1"}
    payloads = [
        ("a", "limites_exposicao", json.dumps([{"field_code": "lmg", **cell}, {"field_code": "lmi", "status": "Previsto"}])),
        ("a", "exclusoes", json.dumps({"exclusao_dolo": {"status": "excluído", "referencia": "x"}, "exclusao_fraude": {"status": "Excluído", "referencia": "x"}})),
        ("a", "procedimentos", json.dumps({"cells": {"cooperacao_segurado": {"status": "Não localizado", "origem": "FATO"}}})),
        ("a", "custos_defesa", json.dumps({"cells": [{"field_code": "lmg", "status": "Ambíguo", "referencia": "depois"}]})),
        ("a", "estrutura_protecao", json.dumps([{"field_code": "retroatividade", **cell}])),
        ("b", "exclusoes", json.dumps([{"field_code": "inventado"}])),
    ]
    policies = spark.createDataFrame([("a",), ("b",), ("c",)], "policy_id string")
    cells, rejects = report.fill_matrix(policies, spark.createDataFrame(payloads, "policy_id string, category string, payload string"))
    got = {(r["policy_id"], r["field_code"]): (r["status"], r["origem"], r["referencia"]) for r in cells.collect()}
    assert len(got) == 180 and [tuple(r) for r in rejects.collect()] == [("b", "exclusoes", "LLM_SCHEMA_INVALID")]
    assert got["a", "lmg"] == ("Ambíguo", "fato", "depois")
    assert got["a", "lmi"] == ("Requer confirmação", "requer_confirmacao", None)
    assert got["a", "exclusao_fraude"] == ("Excluído", "fato", "x") and got["a", "exclusao_dolo"][0] == "Requer confirmação"
    assert got["a", "cooperacao_segurado"] == ("Não localizado", "fato", None)
    assert got["a", "retroatividade"][0] == "Não localizado" and got["c", "lmg"] == ("Não localizado", "nao_localizado", None)


def test_checklist_of_an_empty_and_a_filled_report(spark):
    policies = spark.createDataFrame([("a",), ("b",)], "policy_id string")
    cell = {"status": "Previsto", "referencia": "x", "exclusoes_condicoes": "sim"}
    payloads = [("a", c, json.dumps({r[0]: cell for r in catalog.REPORT_FIELD_TABLE if r[1] == c})) for c, _ in catalog.REPORT_CATEGORIES]
    cells, _ = report.fill_matrix(policies, spark.createDataFrame(payloads, "policy_id string, category string, payload string"))
    reports = spark.createDataFrame([("cheio", "a"), ("vazio", "b"), ("ambos", "a"), ("ambos", "b")], "report_id string, policy_id string")
    names = [s for s, _ in catalog.CHECKLIST if not s.startswith("computed:")]
    flags = spark.createDataFrame([(r, *[True] * 5, False, False) for r in ("cheio", "vazio", "ambos")], "report_id string, " + ", ".join(f"{n} boolean" for n in names) + ", dados_financeiros_disponiveis boolean, informative_only boolean")
    found = report.identification(spark.createDataFrame([("a", '{"empresa_aberta_fechada": "aberta", "num_paginas": 3}'), ("b", '{"empresa_aberta_fechada": "mista"}')], "policy_id string, payload string"))
    got = {}
    for r in report.checklist(cells, reports, flags, found).collect():
        got.setdefault(r["report_id"], {})[r["item_order"]] = r["ok"]
    assert {k for k, ok in got["cheio"].items() if not ok} == {11}
    assert {k for k, ok in got["vazio"].items() if ok} == {1, 2, 3, 10, 12, 13, 14}
    assert not got["ambos"][6] and not got["ambos"][9] and got["ambos"][4]


def test_insurer_reading(spark):
    texts = {
        "um": "[OCR/visão]\nPorto Seguro\nCondições Gerais de Seguro\nVigência: 01/01/2025 a 2026\nporto seguro s.a.", "dois": "Alfa Seguros\nBeta Seguros S.A.",
        "nenhum": "apólice 123\n12345\nlinha em minúsculas", "tarde": "a1\nb2\nc3\nd4\ne5\nMarca Nova\nemitida em 05/07/2024",
    }
    df = spark.createDataFrame([(k, 1, t) for k, t in texts.items()], "policy_id string, page_number int, text string")
    got = {r["policy_id"]: (r["name"], r["year"]) for r in insurer.detect_insurer(df).collect()}
    assert got == {"um": ("porto seguro s.a.", "2025")}
    labels = [("a", 0, "X", "2024"), ("b", 1, "X", "2025"), ("c", 2, None, None), ("d", 3, "Y", None), ("e", 4, "Y", "2020"), ("f", 5, "Z", "1")]
    labels += [(f"n{i:02d}", 10 + i, "Comum", None) for i in range(30)]
    info = spark.createDataFrame(labels, "policy_id string, position int, name string, year string")
    shown = {r["policy_id"]: r["label"] for r in insurer.display_labels(info).collect()}
    assert [shown[k] for k in "abcdef"] == ["X 2024", "X 2025", "c", "Y A", "Y B", "Z"]
    assert shown["n00"] == "Comum A" and shown["n25"] == "Comum Z" and shown["n26"] == "Comum AA" and shown["n29"] == "Comum AD" and len(shown) == 36


def test_usage(spark):
    rows = [("r1", "EXTRACT", "gemini-2.0-flash", 1_000_000, 500_000, 10, 1), ("r1", "EXPLAIN", "outro", 1, 1, 5, 2), ("r0", "EMBED", "outro", 3, 4, 1, 3)]
    df = spark.createDataFrame(rows, "run_id string, kind string, model_name string, request_tokens long, response_tokens long, latency_ms long, seq long")
    for prices in (None, catalog.price_table(spark)):
        got = {r["run_id"]: (r["kind"], r["calls"], r["cost_usd"]) for r in usage.summarize_runs(usage.with_cost(df, prices)).collect()}
        assert got == {"r1": ("EXTRACT", 2, 0.3), "r0": ("EMBED", 1, None)}
    assert usage.last_run(df).first()[0] == "r0"


def test_report_prompts_grow_with_documents(spark, sf):
    from registered_queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    expected = {f"{r['lang']}-{r['doc_id'] // 64}" for r in docs}
    found = QUERIES["report_prompts"](spark, sf).collect()
    assert len(found) == 4 * len(expected) and {r["report_id"] for r in found} == expected


def test_matrix_broadcasts_no_cells(spark):
    cell = '{"field_code": "lmg", "status": "Previsto", "referencia": "%s"}'
    payloads = [("p1", "limites_exposicao", f"[{cell % 'a'}, {cell % 'b'}]"), ("p1", "procedimentos", f"[{cell % 'c'}]"), ("p1", "estrutura_protecao", f"[{cell % 'd'}]"),
                ("p2", "procedimentos", '[{"field_code": "x"}]'), ("p2", "limites_exposicao", f"[{cell % 'a'}]"), (None, "procedimentos", f"[{cell % 'e'}]")]
    policies = spark.createDataFrame([("p1",), ("p2",), ("p3",), (None,)], "policy_id string")
    cells, rejects = report.fill_matrix(policies, spark.createDataFrame(payloads, "policy_id string, category string, payload string"))
    assert "Broadcast" not in cells._jdf.queryExecution().executedPlan().toString()
    got = {(r["policy_id"], r["field_code"]): (r["status"], r["referencia"], r["origem"]) for r in cells.collect()}
    assert len(got) == 270 and got["p1", "lmg"] == ("Previsto", "c", "fato")
    assert {v for k, v in got.items() if k != ("p1", "lmg")} == {("Não localizado", None, "nao_localizado")}
    assert [r["policy_id"] for r in rejects.collect()] == ["p2"]
