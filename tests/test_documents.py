import random

from pyspark.sql import functions as F

from clauselake.operators import chunks, pages
from clauselake.plans.carry import carry_forward
from clauselake.sources.html import html_regions

C = F.col


def cut(text, size=800, overlap=100):
    """Brute force windows."""
    body, out, start = text.strip(), [], 0
    while body:
        piece = body[start : start + size].strip()
        out += [piece] if piece else []
        if start + size >= len(body):
            break
        start += size - overlap
    return out


def test_chunks_equal_brute_force(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choice("ab \né\U0001f600") for _ in range(n)) for n in (0, 1, 799, 800, 801, 1500, 1650, 5000)]
    rows += [" " * 900 + "x" + " " * 900 + "y"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    for size, overlap in ((800, 100), (50, 40), (10, 0)):
        got = [r[1] for r in df.select("i", chunks.chunk_text(C("t"), size, overlap)).orderBy("i").collect()]
        assert got == [cut(r, size, overlap) for r in rows]


def test_page_classification_counts_code_points(spark):
    df = spark.createDataFrame([("x" * 40,), (" " + "é" * 39 + " ",), ("a" + " " * 38 + "b",), ("",)], "t string")
    assert [r[0] for r in df.select(pages.classify_page(C("t"))).collect()] == ["NATIVE_TEXT", "PADDLEOCR", "NATIVE_TEXT", "PADDLEOCR"]


def page_rows(spark, texts):
    rows = [("p", "d", i, t, "NATIVE_TEXT", None) for i, t in texts]
    return spark.createDataFrame(rows, "policy_id string, document_id string, page_number int, text string, source_type string, ocr_confidence double")


def test_sections_cross_pages_and_own_marker_counts(spark):
    texts = [(1, "intro"), (2, "Cláusula 1 - Objeto\ntexto"), (3, "segue"), (4, "antes\nARTIGO 2\nfim"), (2000, "depois"), (2001, "  Seção III\nx")]
    got = chunks.chunk_pages(page_rows(spark, texts)).orderBy("page_number").select("section_name").collect()
    assert [r[0] for r in got] == [None, "Cláusula 1 - Objeto", "Cláusula 1 - Objeto", "Cláusula 1 - Objeto", "ARTIGO 2", "Seção III"]


def test_carry_forward_equals_a_plain_loop_at_any_width(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.choice([None, None, f"m{i}"])) for k in "ab" for i in rng.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "k string, pos int, v string")
    expected = {}
    for key in "ab":
        last = None
        for _, pos, value in sorted(r for r in rows if r[0] == key):
            expected[key, pos] = last
            last = value or last
    for width in (1, 7, 1024):
        got = {(r["k"], r["pos"]): r["out"] for r in carry_forward(df, ["k"], "pos", "v", "out", width).collect()}
        assert got == expected


def test_markdown_sections(spark):
    md = "abertura\n# Um\ncorpo\n## Vazia\n### Dois \nmais\n##### não\n#semespaco"
    df = spark.createDataFrame([("p", 1, md), ("p", 2, "só texto"), ("p", 3, " ")], "policy_id string, page_number int, markdown string")
    got = [tuple(r) for r in chunks.split_markdown_sections(df).select("page_number", "section_index", "title", "text").orderBy("page_number", "section_index").collect()]
    assert got == [(1, 0, None, "abertura"), (1, 1, "Um", "corpo"), (1, 2, "Dois", "mais\n##### não\n#semespaco"), (2, 0, None, "só texto")]


def test_composition_orders_regions_and_renders_tables(spark):
    regions = [("table", "a\tb\n\t\n c \td", 2), ("heading", " T ", 0), ("text", "x", 1), ("text", " ", 3)]
    df = spark.createDataFrame([(regions,)], f"r {pages.REGIONS}")
    row = df.select(pages.compose_page_text(C("r")).alias("t"), pages.compose_page_markdown(C("r")).alias("m")).first()
    assert row["t"] == "T\nx\n[TABELA]\na | b\nc | d"
    assert row["m"] == "## T\n\nx\n\n| a | b |\n| c | d |"


def full_pages(spark):
    rows = [
        ("p", "d", 1, "n" * 50, None, None, None),
        ("p", "d", 2, "curto", "texto lido", 0.3, None),
        ("p", "d", 3, "", "outro", 0.9, [("heading", "H", 0), ("text", "corpo", 1)]),
        ("p", "d", 4, "resto", None, None, None),
    ]
    return spark.createDataFrame(rows, "policy_id string, document_id string, page_number int, native_text string, ocr_text string, ocr_confidence double, regions " + pages.REGIONS)


def test_page_resolution_and_status(spark):
    resolved = pages.resolve_page_text(full_pages(spark)).orderBy("page_number")
    assert [(r["source_type"], r["text"]) for r in resolved.collect()] == [
        ("NATIVE_TEXT", "n" * 50), ("PADDLEOCR", "texto lido"), ("PP_STRUCTURE", "H\ncorpo"), ("PADDLEOCR", ""),
    ]
    stages = [(r["stage"], r["progress"], r["message"]) for r in pages.document_status(resolved).orderBy("seq").collect()]
    assert stages == [
        ("RECEIVED", 0.0, None), ("TEXT_EXTRACTED", 0.3, None), ("OCR_COMPLETED", 0.5, None), ("INDEXED", 1.0, None),
        ("REVIEW_REQUIRED", 1.0, "REVIEW: páginas ilegíveis: 2"),
    ]
    markdown = pages.resolve_page_markdown(full_pages(spark)).orderBy("page_number").collect()
    assert [(r["source_type"], r["markdown"]) for r in markdown][1:] == [("PADDLEOCR", "texto lido"), ("PP_STRUCTURE", "## H\n\ncorpo"), ("NATIVE_TEXT", "resto")]
    previews = [r["text"] for r in pages.preview_pages(full_pages(spark)).orderBy("page_number").collect()]
    assert previews[1] == "[OCR/visão]\ntexto lido\n[texto nativo]\ncurto" and len(previews) == 2


def test_html_regions(spark):
    html = "<html><head><title>t</title></head><body><h1>Um &amp; dois</h1><p>a <b>b</b></p><script>x</script><table><tr><th>A</th><td> b  c</td></tr><tr><td></td></tr></table><p>fim"
    rows = html_regions(spark.createDataFrame([(1, html)], "id int, html string")).first()["regions"]
    assert [(r["kind"], r["text"], r["order"]) for r in rows] == [("heading", "Um & dois", 0), ("text", "a b", 1), ("table", "A\tb c", 2), ("text", "fim", 3)]


def test_fingerprint_audit_reports_only_changed_texts(spark):
    made = chunks.chunk_pages(page_rows(spark, [(1, "a"), (2, "b"), (3, "c")]))
    stored = made.withColumn("text", F.when(C("page_number") == 2, F.lit("x")).otherwise(C("text"))).withColumn(
        "content_fingerprint", F.when(C("page_number") == 3, F.lit(None)).otherwise(C("content_fingerprint"))
    )
    assert [r["chunk_id"] for r in chunks.fingerprint_audit(stored).collect()] == ["d:p2:c0"]


def test_status_of_a_document_with_a_million_illegible_pages(spark):
    many = spark.range(1, 1_000_001).select(F.lit("big").alias("document_id"), C("id").cast("int").alias("page_number"), F.lit(0.1).alias("ocr_confidence"), F.lit(True).alias("used_ocr"))
    few = spark.createDataFrame([("small", 2000, 0.1, False), ("small", 3, 0.2, False), ("small", None, 0.1, False), ("fine", 1, None, False)], "document_id string, page_number int, ocr_confidence double, used_ocr boolean")
    rows = pages.document_status(many.repartition(6).unionByName(few)).filter("stage = 'REVIEW_REQUIRED'").collect()
    found = {r["document_id"]: r["message"].removeprefix("REVIEW: páginas ilegíveis: ") for r in rows}
    assert found == {"big": ", ".join(map(str, range(1, 1_000_001))), "small": "3, 2000"}


def test_an_arriving_batch_makes_each_chunk_once(spark, tmp_path, monkeypatch):
    from clauselake.streaming import ingest

    made = spark.sparkContext.accumulator(0)

    def count(text):
        made.add(1)
        return text

    counted = F.udf(count, "string").asNondeterministic()
    plain = ingest.chunk_pages
    monkeypatch.setattr(ingest, "chunk_pages", lambda pages: plain(pages).withColumn("text", counted("text")).filter("text <> 'x'"))
    rows = [("p", "d", i, f"Artigo {i}\n" + "texto da apólice " * 20, None, None, None) for i in range(40)]
    schema = "policy_id string, document_id string, page_number int, native_text string, ocr_text string, ocr_confidence double, regions array<struct<kind:string,text:string,order:int>>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_pages(spark, str(tmp_path / "in"), spark.createDataFrame(rows, schema).schema)
    ingest.ingest_stream(stream, str(tmp_path / "p"), str(tmp_path / "c"), str(tmp_path / "k"), buckets=2).awaitTermination()
    assert ingest.ingested_tables(str(tmp_path / "p"), str(tmp_path / "c"), 2)[1].read(spark).count() == 40
    assert made.value == 40
