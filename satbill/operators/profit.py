"""Profit by customer and month."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WIDE = "decimal(20,2)"
RATE = "decimal(20,12)"


def profit_by_period(
    report: DataFrame, revenue: DataFrame, rates: DataFrame, on_missing_rate: str = "one"
) -> DataFrame:
    """Cost in units against revenue in house currency per customer, code and month.

    Customers without a name or an external code drop out of the join; a month without a rate
    counts at 1, or stays empty with ``on_missing_rate="null"``.
    """
    cost = report.groupBy("financial_period", "customer_name", "ext_code").agg(
        F.sum(F.col("calculated_overage") + F.col("billed_amount") + F.col("fees_total")).cast(WIDE).alias("expenses_usd")
    )
    earned = (
        revenue.groupBy(F.col("period").alias("financial_period"), "customer_name", "ext_code")
        .agg(F.sum("revenue_total").cast("decimal(24,6)").alias("revenue_rub"))
        .filter(F.col("revenue_rub") > 0)
    )
    rate = F.col("rate").cast(RATE)
    rate = F.coalesce(rate, F.lit(1).cast(RATE)) if on_missing_rate == "one" else rate
    spent = F.col("expenses_usd") * rate
    share = lambda part: (part.cast("double") / F.col("revenue_rub").cast("double")) * 100
    rows = (
        cost.join(earned, ["financial_period", "customer_name", "ext_code"])
        .join(rates.withColumnRenamed("period", "financial_period"), "financial_period", "left")
        .withColumn("expenses_rub", spent.cast("decimal(32,10)"))
        .withColumn("profit_rub", (F.col("revenue_rub") - F.col("expenses_rub")).cast("decimal(32,10)"))
        .withColumn("_margin", share(F.col("profit_rub")))
    )
    return rows.select(
        F.col("financial_period").alias("period"), "customer_name", "ext_code", "expenses_usd", "expenses_rub",
        "revenue_rub", "profit_rub",
        F.round("_margin", 2).alias("margin_pct"),
        F.round(share(F.col("expenses_rub")), 2).alias("cost_pct"),
        F.when(F.col("revenue_rub") < F.col("expenses_rub"), F.lit("UNPROFITABLE"))
        .when(F.col("_margin") < 10, F.lit("LOW_MARGIN"))
        .otherwise(F.lit("PROFITABLE")).alias("status"),
    )


def profit_trend(profit: DataFrame) -> DataFrame:
    """Change against the customer's previous month; a window holds at most one row per month."""
    by_customer = Window.partitionBy("customer_name", "ext_code").orderBy("period")
    prev, now = F.col("prev_profit_rub"), F.col("profit_rub")
    return (
        profit.withColumn("prev_profit_rub", F.lag("profit_rub").over(by_customer))
        .withColumn("profit_change", now - prev)
        .withColumn(
            "profit_change_pct",
            F.round(F.try_divide(F.col("profit_change").cast("double"), prev.cast("double")) * 100, 2),
        )
        .withColumn("trend", F.when(now < prev, F.lit("DECREASE")).when(now > prev, F.lit("INCREASE")))
    )


def unprofitable(profit: DataFrame) -> DataFrame:
    """Customers in loss or at low margin. The alert reads the rounded margin, the status the exact one."""
    return profit.filter(F.col("status").isin("UNPROFITABLE", "LOW_MARGIN")).withColumn(
        "alert_type",
        F.when(F.col("profit_rub") < 0, F.lit("LOSS"))
        .when(F.col("margin_pct") < 10, F.lit("LOW_MARGIN"))
        .otherwise(F.lit("PROFITABLE")),
    )
