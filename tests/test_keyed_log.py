import random

import pytest
from pyspark.sql import functions as F

from clauselake.operators import comparison
from clauselake.sources import derived
from clauselake.sources.keyed_log import KeyedLog
from clauselake.streaming import ingest

SHAPE = "k string, i int, v string"


def contents(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_a_dictionary(spark, tmp_path):
    """Random commits, repeats, deletions and compactions against a plain map of keys to rows."""
    draw, held = random.Random(4), {}
    log = KeyedLog(str(tmp_path / "t"), ("k",), buckets=3, fanout=3)
    for commit in range(9):
        rows = [(draw.choice(["a", "b", "c", "d", None]), draw.randrange(3), f"v{commit}") for _ in range(draw.randrange(4))]
        gone = [(draw.choice(["a", "b", "c", "d", "e", None]),) for _ in range(draw.randrange(3))]
        batch, deleted = spark.createDataFrame(rows, SHAPE), spark.createDataFrame(gone, "k string")
        assert log.append(batch, commit, gone=deleted)
        assert not log.append(batch.withColumn("v", F.lit("again")), commit)
        for key in {r[0] for r in rows} | {g[0] for g in gone}:
            held[key] = [r for r in rows if r[0] == key]
        log.compact(spark)
        assert contents(log.read(spark)) == sorted((r for kept in held.values() for r in kept), key=str)
    assert len(log.runs(spark)) < 9 and not log.append(batch, 2)
    before = contents(log.read(spark))
    assert log.vacuum(spark) > 0 and contents(log.read(spark)) == before
    wanted = spark.createDataFrame([("a",), (None,), ("z",)], "k string")
    assert contents(log.read(spark, wanted)) == [r for r in before if r[0] in ("a", None)]


def test_small_batches_write_little(spark, tmp_path):
    log = KeyedLog(str(tmp_path / "t"), ("k",), buckets=4)
    log.append(spark.range(200_000).select(F.col("id").cast("string").alias("k"), F.md5(F.col("id").cast("string")).alias("v")), 0)
    log.append(spark.createDataFrame([("5", "new"), ("x", "new")], "k string, v string"), 1)
    old, new = log.runs(spark)
    assert new.size * 100 < old.size
    assert log.read(spark).count() == 200_001 and log.read(spark).filter("v = 'new'").count() == 2
    assert not log.compact(spark)  # the old run is much larger than what came since


def test_lost_runs_are_ignored_and_overwritten(spark, tmp_path):
    log = KeyedLog(str(tmp_path / "t"), ("k",), buckets=2)
    log.append(spark.createDataFrame([("a", 1, "x")], SHAPE), 0)
    log.append(spark.createDataFrame([("a", 2, "half")], SHAPE), 1)
    (tmp_path / "t" / "run-000000000001-000000000001" / "_SUCCESS").unlink()
    assert contents(log.read(spark)) == [("a", 1, "x")]
    assert log.append(spark.createDataFrame([("a", 3, "whole")], SHAPE), 1)
    assert contents(log.read(spark)) == [("a", 3, "whole")]


def test_writers_count_from_where_they_came(spark, tmp_path):
    log = KeyedLog(str(tmp_path / "t"), ("k",))
    with pytest.raises(ValueError):
        log.read(spark)
    assert log.first_commit(spark, "one") == 0
    log.append(spark.createDataFrame([("a", 1, "x")], SHAPE), 0)
    assert (log.first_commit(spark, "one"), log.first_commit(spark, "two")) == (0, 1)


def test_stream_survives_a_killed_batch(spark, sf, tmp_path, monkeypatch):
    """The batch dies between its two writes; the restarted stream ends with the chunks of a batch run."""
    arriving = derived.pages(spark, sf).limit(60)
    arriving = spark.createDataFrame(arriving.collect(), arriving.schema)
    paths = [str(tmp_path / name) for name in ("arrived", "pages", "chunks", "checkpoint")]
    arriving.repartition(3, "page_number").write.parquet(paths[0])
    run = lambda: ingest.ingest_stream(ingest.stream_pages(spark, paths[0], arriving.schema, 1), *paths[1:], buckets=2)
    whole, calls = ingest.index_documents, []

    def dying(pages):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return whole(pages)

    monkeypatch.setattr(ingest, "index_documents", dying)
    with pytest.raises(Exception, match="killed"):
        run().awaitTermination()
    monkeypatch.setattr(ingest, "index_documents", whole)
    run().awaitTermination()
    run().awaitTermination()  # nothing new
    page_log, chunk_log = ingest.ingested_tables(paths[1], paths[2], 2)
    assert page_log.read(spark).count() == 60
    columns = ["chunk_id", "section_name", "content_fingerprint", "source_type"]
    assert contents(chunk_log.read(spark).select(*columns)) == contents(whole(arriving).select(*columns))


def test_recomparison_equals_a_full_one(spark, sf):
    """Only touched pairs are computed; the merged rows are those of a full comparison, explanations kept."""
    pairs, facts, rates = derived.pairs(spark, sf), derived.checked_facts(spark, sf), derived.fx_rates(spark)
    stored = comparison.compare_policies(pairs, facts, rates).withColumn("explicacao", F.concat(F.lit("t"), "field_code"))
    changed = spark.createDataFrame([("5",), ("6",), ("40",), ("none",)], "policy_id string")
    hit = F.col("policy_id").isin("5", "6", "40")
    after = facts.withColumn("requires_human_review", F.when(hit, F.lit(True)).otherwise(F.col("requires_human_review")))
    fresh, merged = comparison.recompare(stored, pairs, changed, after, rates)
    expected = comparison.compare_policies(pairs, after, rates, previous=stored)
    columns = ["policy_id_a", "policy_id_b", "field_code", "resultado", "direcao", "error_code", "explicacao"]
    assert contents(merged.select(*columns)) == contents(expected.select(*columns))
    touched = {(a, b) for a, b, *_ in contents(fresh.select(*columns))}
    assert touched == {("4", "5"), ("5", "6"), ("6", "7"), ("39", "40"), ("40", "41")} and fresh.count() == 50
