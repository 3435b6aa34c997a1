"""Prices, costs of a switch and verdict summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priced(df: DataFrame, rates: DataFrame, key: str, out: str) -> DataFrame:
    """The rate of an exact key; an unknown key has none. ``rates`` is a price list."""
    return df.join(rates.select(F.col("provider_key").alias(key), F.col("usd_per_minute").alias(out)), key, "left")


def cost_columns(production: Column, challenger: Column, minutes: Column, fx: Column, monthly_minutes: float) -> dict[str, Column]:
    """Amounts of both sides and their difference; any missing part leaves NULL."""
    p, c = production * fx, challenger * fx
    return {
        "per_call_production": p * minutes, "per_call_challenger": c * minutes, "per_minute_difference": c - p, "per_minute_percent": (c - p) / F.nullif(p, F.lit(0)),
        "per_month_difference": (c - p) * monthly_minutes, "per_year_difference": (c - p) * monthly_minutes * 12,
    }


def evaluation_cost(components: DataFrame) -> DataFrame:
    """By session, the sum of what was priced and whether everything was; one run in
    two roles (same run_id) is billed once."""
    once = components.dropDuplicates(["session_id", "run_id"])
    return once.groupBy("session_id").agg(F.sum("amount").alias("total"), F.count("*").alias("components"), (F.count("*") == F.count("amount")).alias("complete"))


def risk_summary(verdicts: DataFrame) -> DataFrame:
    """Verdicts, skipped turns and tokens of each session."""
    return verdicts.groupBy("session_id").agg(
        F.count_if(F.col("verdict").isNotNull()).alias("evaluated"), F.count_if(F.col("verdict").isNull()).alias("skipped"), *(F.count_if(F.col("verdict") == v).alias(v) for v in ("none", "minor", "major")), F.sum("tokens").alias("tokens")
    )
