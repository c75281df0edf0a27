import corpus_pipeline


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
        assert docs.columns[: len(columns)] == columns
    assert docs.columns[5:] == ["size", "source_size", "target", "times", "taken"]
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4] >= sizes[5] > 0
    rows = docs.collect()
    assert all(r["n_chars"] == len(r["text"]) and r["taken"] == r["times"] * r["size"] and r["times"] in (1, 2) for r in rows)
    again = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_empty_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []
