"""Usage metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.catalog import PRICE_REFERENCE_DATE, PRICE_TABLE
from clauselake.plans.broadcasting import checked_broadcast


def with_cost(usage: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Cost in USD rounded half up to six digits; a model without a price gives null.

    Prices are per million tokens, so tokens times price is the cost in
    millionths and the rounding is exact in decimals. The built-in prices are
    literals; a price table of the caller is broadcast while it is small.
    """
    if prices is None:
        price_in = price_out = None
        for model, first, second in PRICE_TABLE:
            price_in = (F if price_in is None else price_in).when(F.col("model_name") == model, F.lit(first))
            price_out = (F if price_out is None else price_out).when(F.col("model_name") == model, F.lit(second))
        priced = usage.withColumn("__in", price_in).withColumn("__out", price_out)
    else:
        priced = usage.join(
            checked_broadcast(
                prices.select("model_name", F.col("usd_per_1m_in").alias("__in"), F.col("usd_per_1m_out").alias("__out"))
            ),
            "model_name",
            "left",
        )

    def part(tokens: str, price: str) -> Column:
        return F.col(tokens).cast("decimal(18,0)") * F.col(price).cast("decimal(12,6)")

    millionths = F.round(part("request_tokens", "__in") + part("response_tokens", "__out"), 0)
    return priced.withColumn("cost_usd", millionths.cast("double") / 1_000_000).drop("__in", "__out")


def summarize_runs(usage: DataFrame) -> DataFrame:
    """One row per run. Costs add up as decimals, so the sum has no order."""
    return usage.groupBy("run_id").agg(
        F.min_by("kind", "seq").alias("kind"),
        F.count(F.lit(1)).alias("calls"),
        F.sum("request_tokens").alias("request_tokens"),
        F.sum("response_tokens").alias("response_tokens"),
        F.sum("latency_ms").alias("latency_ms"),
        F.sum(F.col("cost_usd").cast("decimal(28,6)")).cast("double").alias("cost_usd"),
        F.lit(PRICE_REFERENCE_DATE).alias("price_reference_date"),
    )


def last_run(usage: DataFrame) -> DataFrame:
    """The run that was opened last (its first record is the latest first record)."""
    opened = usage.groupBy("run_id").agg(F.min("seq").alias("opened"))
    return opened.agg(F.max_by("run_id", "opened").alias("run_id"))


def format_summary(summary: DataFrame) -> DataFrame:
    """Labelled strings for a reader."""
    cost = F.when(F.col("cost_usd").isNull(), F.lit("n/d (modelo fora da tabela de preços)")).otherwise(
        F.format_string("US$ %.6f", "cost_usd")
    )
    return summary.select(
        F.col("run_id").cast("string").alias("ID da execução"),
        F.col("calls").cast("string").alias("chamadas de LLM"),
        F.col("request_tokens").cast("string").alias("tokens de entrada"),
        F.col("response_tokens").cast("string").alias("tokens de saída"),
        F.concat(F.col("latency_ms").cast("string"), F.lit(" ms")).alias("latência total"),
        cost.alias("custo estimado"),
        F.coalesce("price_reference_date", F.lit("n/d")).alias("tabela de preços (ref.)"),
    )
