import json

from pyspark.sql import functions as F

from clauselake.operators import evaluation, facts, status
from clauselake.sources import derived, exports, html, tables
from clauselake.streaming import ingest

C = F.col


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_upsert_is_idempotent_and_replaces_by_key(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "k string, i int, v string")
    first = make([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("c", 1, "x")])
    tables.upsert(first, path, ["k"], buckets=3)
    for _ in range(2):
        tables.upsert(make([("a", 9, "novo"), ("d", 1, "novo")]), path, ["k"], buckets=3)
        got = rows_of(tables.read_upserted(spark, path, ["k"]))
        assert got == rows_of(make([("a", 9, "novo"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "novo")]))
    gone = spark.createDataFrame([("b",), ("c",)], "k string")
    tables.upsert(make([]), path, ["k"], buckets=3, replaced=gone)
    assert rows_of(tables.read_upserted(spark, path, ["k"])) == rows_of(make([("a", 9, "novo"), ("d", 1, "novo")]))


def test_intake(spark, tmp_path):
    for name, body in (("a.pdf", b"%PDF-1.7 x"), ("b.PDF", b"%PDF-"), ("c.pdf", b"nada"), ("d.txt", b"%PDF-"), ("e.pdf", b"%PDF-" + b"x" * 100)):
        (tmp_path / name).write_bytes(body)
    got = {r["path"][-5]: r["accepted"] for r in tables.document_intake(spark, str(tmp_path), max_bytes=50).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False, "e": False}


def test_reference_set_evaluation_and_run_id(spark, tmp_path):
    expected_facts = [
        {"field_code": "franquia", "status": "FOUND", "expected_value": {"amount": "10"}, "evidence_quote": "dez reais"},
        {"field_code": "vigencia", "status": "NOT_FOUND"},
        {"field_code": "limite_agregado", "status": "FOUND", "expected_value": {"amount": "1"}, "evidence_quote": "não há"},
        {"field_code": "retroatividade", "status": "FOUND", "expected_value": {"date": "2020-01-01"}},
        {"field_code": "indice_reajuste", "status": "FOUND", "expected_value": {"number": "5"}},
    ]
    case = {"case_id": "c1", "policy_id": "p", "chunks": [{"chunk_id": "k", "page_number": 1, "text": "são dez reais"}], "expected_facts": expected_facts}
    (tmp_path / "s.json").write_text(json.dumps({"reference_version": "1", "oq_02": "substring", "cases": [case]}))
    chunks, expected, violations = tables.load_reference_set(spark, str(tmp_path / "s.json"))
    assert violations.count() == 0 and chunks.count() == 1
    answers = [("p", 0, "franquia", "FOUND", '{"amount": "10,00"}'), ("p", 1, "vigencia", "FOUND", '"01/01/2024 a 01/01/2025"'), ("p", 2, "limite_agregado", "FOUND", '{"amount": 2}'), ("p", 3, "indice_reajuste", "AMBIGUOUS", "5")]
    responses = spark.createDataFrame([(*a, 0.5, ["e"], False) for a in answers], "policy_id string, position int, field_code string, status string, value string, confidence double, evidence_ids array<string>, requires_human_review boolean")
    evidence = chunks.select("policy_id", F.lit("e").alias("evidence_id"), C("text").alias("quoted_text"))
    built, _ = facts.build_facts(responses.select("policy_id", "field_code"), responses, evidence)
    got = {r["field_code"]: (r["result"], r["evidence_ok"]) for r in evaluation.evaluate(expected, built, evidence).collect()}
    assert got == {
        "franquia": ("correto", True), "vigencia": ("divergente", True), "limite_agregado": ("divergente", False),
        "retroatividade": ("nao_avaliado", None), "indice_reajuste": ("inconclusivo", True),
    }
    total = evaluation.totals(evaluation.evaluate(expected, built, evidence)).first()
    assert tuple(total) == (5, 1, 2, 0, 1, 1, 3)
    ids = {evaluation.run_id(expected.repartition(n)).first()[0] for n in (1, 4)}
    assert len(ids) == 1 and len(ids.pop()) == len("eval_") + 12
    again = expected.unionByName(expected.limit(1)).withColumn("expected_value", F.when(C("status") == "NOT_FOUND", F.lit("{\"x\":1}")))
    assert {r["violation"] for r in tables.expected_violations(again).collect()} == {"FOUND_WITHOUT_VALUE", "NOT_FOUND_WITH_VALUE", "FIELD_CODE_REPEATED"}
    exports.write_evaluation(evaluation.evaluate(expected, built, evidence), str(tmp_path / "out"), "x")
    assert spark.read.json(str(tmp_path / "out" / "evaluation_x.json")).count() == 5


def test_bundles(spark, tmp_path):
    bundle = {
        "policy": {"policy_id": "p", "seguradora": "S"}, "documents": [{"document_id": "d", "policy_id": "p", "nome_fonte": "f"}],
        "evidences": [{"evidence_id": "e", "policy_id": "p", "document_id": "d", "page_number": 1, "quoted_text": "t", "source_type": "NATIVE_TEXT"}],
        "llm_output": [{"field_code": "franquia", "status": "FOUND", "value": {"amount": "1"}, "confidence": 0.5, "evidence_ids": ["e"], "requires_human_review": False}],
    }
    (tmp_path / "b.json").write_text(json.dumps(bundle))
    loaded = tables.load_bundles(spark, str(tmp_path / "b.json"))
    built, rejects = facts.build_facts(loaded["responses"].select("policy_id", "field_code"), loaded["responses"], loaded["evidence"])
    assert built.first()["status"] == "FOUND" and rejects.count() == 0 and loaded["documents"].count() == 1


def test_stream_equals_batch(spark, sf, tmp_path):
    pages = derived.pages(spark, sf).filter("policy_id in ('src1', 'src2')")
    source = str(tmp_path / "in")
    half = C("page_number") % 2 == 0
    pages.filter(half).write.parquet(source)
    run = lambda: ingest.ingest_stream(ingest.stream_pages(spark, source, pages.schema), str(tmp_path / "p"), str(tmp_path / "c"), str(tmp_path / "k"), 4).awaitTermination()
    run()
    rest = pages.filter(~half)
    outdated = rest.withColumn("native_text", F.lit("an outdated version of the page"))
    outdated.unionAll(rest).coalesce(1).write.mode("append").parquet(source)  # each page twice in one batch
    run()
    columns = ["chunk_id", "section_name", "content_fingerprint", "vector"]
    got = ingest.ingested_tables(str(tmp_path / "p"), str(tmp_path / "c"), 4)[1].read(spark).select(*columns)
    assert rows_of(got) == rows_of(ingest.index_documents(pages).select(*columns))


def test_status_stream_equals_batch(spark, sf, tmp_path):
    events = tables.table(spark, sf, "events")
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = derived.status_events(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    ingest.status_stream(stream, str(tmp_path / "now"), str(tmp_path / "k"), 4).awaitTermination()
    found = tables.read_upserted(spark, str(tmp_path / "now"), ["document_id"])
    assert rows_of(found) == rows_of(status.current_status(derived.status_events(events)))


def test_report_lines_sort_into_a_document(spark, sf, tmp_path):
    from registered_queries import QUERIES

    lines = QUERIES["report_markdown"](spark, sf)
    report = lines.groupBy("report_id").count().orderBy("report_id").first()["report_id"]
    ordered = [r["line"] for r in lines.filter(C("report_id") == report).orderBy("section", "k1", "k2", "k3").collect()]
    assert ordered[0] == "# Relatório D&O — Comparação de Apólices" and ordered[-2].startswith("- **requer_confirmacao")
    assert sum(line.startswith("- ✓") or line.startswith("- ✗") for line in ordered) == 14
    assert sum("Crítica |" in line for line in ordered) > 0


def test_report_lines_sort_by_number(spark):
    keys = [9, 10, 99_999_999, 100_000_000, 1_234_567_890]
    rows = spark.createDataFrame([(k,) for k in reversed(keys)], "n bigint")
    lines = rows.withColumn("report_id", F.lit("r")).select(*exports._line(5, [exports._at(C("n"))], C("n").cast("string")))
    assert [int(r["line"]) for r in lines.orderBy("section", "k1", "k2", "k3").collect()] == keys


def test_nested_and_unclosed_tables():
    page = "<table><tr><td>a<td>b<tr><th>c</th><td>x<table><tr><td>n1<td>n2</table>y</td></table><h2>T</h2>p<br>q<script>no</script>"
    assert [(r["kind"], r["text"]) for r in html.parse_regions(page)] == [
        ("table", "a\tb\nc\tx n1 n2 y"), ("heading", "T"), ("text", "p"), ("text", "q")]
    assert html.parse_regions("<table><tr><td>open")[0]["text"] == "open" and html.parse_regions(None) == []


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 1490


def test_broken_documents_are_rejects_without_their_text(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"reference_version": "1",\n "cases": [{"case_id": "c", "policy_id": "p", "chunks": [], "expected_facts": [{"field_code": "franquia", "status": "FOUND", "expected_value": "1"}]}]}')
    (tmp_path / "cut.json").write_text('{"reference_version": "1", "cases": [')
    (tmp_path / "blank.json").write_text(" \n")
    _, expected, violations = tables.load_reference_set(spark, str(tmp_path))
    assert expected.count() == 1 and [tuple(r) for r in violations.collect()] == [("cut.json", None, "JSON_INVALID")]
    loaded = tables.load_bundles(spark, str(tmp_path / "cut.json"))
    assert loaded["policies"].count() == 0 and [tuple(r) for r in loaded["rejects"].collect()] == [("cut.json", "JSON_INVALID")]


def test_intake_of_contents(spark):
    rows = [("a.pdf", b"%PDF-1"), ("b.PDF", b"%PDF-"), ("c.pdf", b"nada"), ("d.txt", b"%PDF-"), ("e.pdf", b"%PDF-" + b"x" * 100), ("f.pdf", None), (None, b"%PDF-"), ("g.pdf", b"")]
    found = tables.intake_contents(spark.createDataFrame(rows, "path string, content binary"), max_bytes=50)
    assert {r["path"]: r["accepted"] for r in found.collect()} == {"a.pdf": True, "b.PDF": True, "c.pdf": False, "d.txt": False, "e.pdf": False, "f.pdf": False, None: False, "g.pdf": False}
