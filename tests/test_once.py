"""Costly expressions run once, in projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.functions import values


def test_values_are_parsed_below_the_generator_and_once(spark):
    rows = [("money", '{"amount":"R$ 1.234,50","currency":"usd"}'), ("number", "7,5"), ("period", '"01/02/2024 a 2024-01-01"'),
            ("period", '"01/01/2024 a 2024-02-01"'), ("text", '" Ação "'), ("date", "null"), ("money", '{"amount":"x"}')]
    df = spark.createDataFrame(rows, "kind string, json string").repartition(1)
    raw = df.withColumn("raw", values.parse_value(F.col("kind"), F.col("json"))).withColumn("one", values.normalize_value(F.col("kind"), F.col("raw")))
    once = values.normalize_once(raw, "n", F.col("kind"), F.col("raw"), F.lit(True))
    assert once.filter(~F.col("n").eqNullSafe(F.col("one"))).count() == 0
    shown = once.select("json", values.value_pairs(F.col("kind"), F.col("n")).alias("v")).collect()
    assert {r["json"]: r["v"] for r in shown} == dict(zip((j for _, j in rows), [
        "amount=1234.50, currency=USD", "number=7.5", None, "duration_days=31, end=2024-02-01, start=2024-01-01", "text=acao", None, None]))
    plan = values.normalize_once(df.select("kind", F.struct(*[F.col("json").alias(k) for k in values.RAW_KEYS]).alias("raw")), "n", F.col("kind"), F.col("raw"), F.lit(True))
    lines = plan._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [line for line in lines if "Generate" in line and "regexp" in line]
