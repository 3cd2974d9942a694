"""Revenue over time and by payment method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.functions.expressions import mean, money_sum
from platter.plans.views import paid, top
from platter.schema import TOTAL, Tables


def daily_revenue(t: Tables, k: int | None = 30) -> DataFrame:
    """Paid orders and revenue of the last ``k`` days that had any, oldest first."""
    days = (
        paid(t.orders)
        .groupBy(F.to_date("order_date").alias("order_day"))
        .agg(
            F.count("*").alias("order_count"),
            money_sum("total_amount").alias("daily_revenue"),
            mean("total_amount").alias("avg_order_value"),
        )
    )
    return top(days, k, F.col("order_day").desc()).orderBy("order_day")


def period_summary(t: Tables, k: int | None = 30) -> DataFrame:
    """Total, mean, best and worst day of that period."""
    return daily_revenue(t, k).agg(
        F.sum("daily_revenue").cast(TOTAL).alias("total_revenue"),
        mean("daily_revenue").alias("average_daily_revenue"),
        F.max("daily_revenue").alias("highest_daily_revenue"),
        F.min("daily_revenue").alias("lowest_daily_revenue"),
    )


def revenue_by_payment_method(t: Tables) -> DataFrame:
    return (
        paid(t.orders)
        .groupBy("payment_method")
        .agg(F.count("*").alias("order_count"), money_sum("total_amount").alias("total_revenue"))
        .orderBy(F.col("total_revenue").desc(), "payment_method")
    )
