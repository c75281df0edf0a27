"""Models learn from every row that may teach, not from a sample."""

import numpy as np
from pyspark.sql import functions as F

from clauselake.llm import common, hidden_markov, toxicity


def test_ids_by_bitmap(spark):
    docs = spark.range(0, 5000).select(F.when(F.col("id") % 11 != 0, F.col("id") - 2500).alias("doc_id"), F.col("id").cast("string").alias("text"))
    ids = spark.range(-2600, 2600, 7).select(F.col("id").alias("doc_id"))
    expected = {(r["doc_id"], r["text"]) for r in docs.join(ids, "doc_id").collect()}
    assert expected and {(r["doc_id"], r["text"]) for r in common.with_ids(docs, ids).collect()} == expected
    assert common.with_ids(docs, ids.filter("false")).count() == 0
    plan = common.with_ids(docs, ids)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("doc_id") < plan.index("__bucket#") and "LeftSemi" not in plan  # the join on ids is above the bitmap


def test_start_of_the_hidden_markov_model_reads_all(spark):
    texts = [f"w{i % 7} w{i % 5} only{i}" for i in range(900)]
    learned = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = hidden_markov.start_model(learned, 2, 64, 11)
    found = hidden_markov.Model.random(2, np.ones(65), 11)
    parts = [hidden_markov.symbols(h, c, 64) for _, h, c in hidden_markov.word_hashes(learned.select("text").toArrow())]
    for _ in range(hidden_markov.START_STEPS):
        found = hidden_markov.Model.from_counts(sum(found.expected(t, n) for t, n in parts))
    assert np.allclose(model.emit, found.emit) and np.allclose(model.move, found.move)


def test_every_labelled_text_teaches(spark):
    rows = 20_500  # the fit once ended at 20,000
    docs = spark.range(rows).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 9 == 0).cast("int").alias("toxic"))
    assert toxicity.labelled(docs, labels, F.lit(True)).count() == rows
