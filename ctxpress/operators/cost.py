"""What fewer input tokens save, by model: a small price table joined by broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# USD for 1000 tokens (input, output).
PRICES = {
    "gpt-5": (0.00125, 0.0100),
    "gpt-4o": (0.00250, 0.0100),
    "gpt-5.4": (0.00250, 0.0150),
    "gpt-5-mini": (0.00025, 0.0020),
    "claude-opus-4.8": (0.00500, 0.0250),
    "claude-sonnet-4.6": (0.00300, 0.0150),
    "claude-haiku-4.5": (0.00100, 0.0050),
    "gemini-2.5-pro": (0.00125, 0.0050),
    "gemini-1.5-pro": (0.00125, 0.0050),
    "gemini-2.5-flash": (0.000075, 0.00030),
    "gemini-2.5-flash-lite": (0.00010, 0.0004),
    "mistral-large-3": (0.00100, 0.00300),
    "mistral-small-4": (0.00010, 0.0003),
    "deepseek-v3": (0.00014, 0.00028),
    "deepseek-r1.5": (0.00055, 0.00219),
}


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, i, o) for m, (i, o) in PRICES.items()], "model string, input_price double, output_price double")


def with_savings(df: DataFrame, original: str = "original_tokens", compressed: str = "compressed_tokens", models: tuple[str, ...] | None = None, requests_per_day: int = 1000) -> DataFrame:
    """A row for each row and model: tokens_saved, reduction_percent, daily_savings, monthly_savings (30 days), annual_savings (365)."""
    if unknown := set(models or ()) - PRICES.keys():
        raise ValueError(f"unknown models: {sorted(unknown)}")
    table = prices(df.sparkSession).drop("output_price")  # 15 rows
    table = table.where(F.col("model").isin(*models)) if models else table
    saved = F.greatest(F.lit(0), F.col(original) - F.col(compressed))
    daily = F.col("tokens_saved") * requests_per_day / 1000 * F.col("input_price")
    return (
        df.withColumn("tokens_saved", saved)
        .withColumn("reduction_percent", F.when(F.col(original) > 0, F.bround(saved / F.col(original) * 100, 1)).otherwise(0.0))
        .crossJoin(F.broadcast(table))
        .withColumn("daily_savings", F.bround(daily, 4))
        .withColumn("monthly_savings", F.bround(daily * 30, 2))
        .withColumn("annual_savings", F.bround(daily * 365, 2))
    )


def list_supported_models() -> list[str]:
    return sorted(PRICES)


def savings_summary() -> Column:
    """A line of text for each row of :func:`with_savings`."""
    return F.format_string("%s: %d tokens saved (%.1f%%), $%.2f a day, $%.2f a month, $%.2f a year", "model", F.col("tokens_saved").cast("long"), "reduction_percent", "daily_savings", "monthly_savings", "annual_savings")
