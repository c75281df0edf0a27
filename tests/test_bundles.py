import time
from pathlib import Path

from pyspark.sql import functions as F

from clauselake.sources import bundles, exports

TEXTS = [("a", "line\nline"), ("b", ""), ("c", None), ("d", "é😀\r\nx"), (None, "no key"), ("e/f=1", "x" * 5000)]


def files(path):
    return sorted(p for p in Path(path).rglob("part-*") if "files" in p.parts)


def test_round_trip_and_byte_ranges(spark, tmp_path):
    path = str(tmp_path / "out")
    docs = spark.createDataFrame(TEXTS + [(f"k{i}", f"text {i} ü\n" * (i % 50)) for i in range(3000)], "id string, markdown string")
    index = bundles.write_bundles(docs, path, "id", "markdown", bundle_bytes=100_000)
    wanted = {r["id"]: r["markdown"] or "" for r in docs.collect()}
    assert {r["id"]: r["markdown"] for r in bundles.read_bundles(spark, path, index, "id", "markdown").collect()} == wanted
    size = sum(len(t.encode()) + 1 for t in wanted.values())
    assert len(files(path)) <= size // 100_000 + 1 < len(wanted) / 100
    assert sum(p.stat().st_size for p in files(path)) == size
    for r in index.filter("id in ('d', 'k77') or id is null").collect():
        content = Path(r["file"].removeprefix("file:")).read_bytes()
        assert content[r["offset"] : r["offset"] + r["length"]].decode() == wanted[r["id"]] + "\n"
    (one,) = bundles.read_document(spark, path, index, "id", "k77", "markdown").collect()
    assert (one["id"], one["markdown"]) == ("k77", wanted["k77"])
    assert bundles.read_document(spark, path, index, "id", "none", "markdown").collect() == []


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "out")
    index = exports.write_documents(spark.createDataFrame([], "id string, markdown string"), path, "id")
    assert index.collect() == [] and bundles.read_bundles(spark, path, index, "id", "markdown").collect() == []


def test_wide_report_spans_bundles_in_order(spark, tmp_path):
    path = str(tmp_path / "out")
    lines = spark.range(20_000).select(
        F.when(F.col("id") % 10 == 0, "small").otherwise("wide").alias("report_id"), (F.col("id") % 3).cast("int").alias("section"),
        (F.col("id") - 1).alias("k1"), F.lit(-1).cast("bigint").alias("k2"), F.lit(-1).cast("bigint").alias("k3"),
        F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"),
    )
    index = exports.write_report_lines(lines.repartition(5), path)
    for name in ("wide", "small"):
        parts = bundles.read_document(spark, path, index, "report_id", name, "line").collect()
        assert len(parts) > 10
        ordered = lines.filter(F.col("report_id") == name).orderBy("section", "k1", "k2", "k3").collect()
        assert "\n".join(p["line"] for p in parts) == "\n".join(r["line"] for r in ordered)


def test_a_file_is_not_copied_for_every_piece(spark, tmp_path):
    rows = spark.range(6000).select("id", F.repeat(F.lit("x"), 2500).alias("text"))  # one file of 15 MB
    index = bundles.write_bundles(rows, str(tmp_path / "b"), "id", "text")
    assert index.select("file").distinct().count() == 1
    begin = time.perf_counter()
    assert bundles.read_bundles(spark, str(tmp_path / "b"), index, "id", "text").filter("length(text) = 2500").count() == 6000
    assert time.perf_counter() - begin < 10  # 6000 copies of the file take far longer
