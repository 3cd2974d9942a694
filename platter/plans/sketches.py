"""Distinct counts that add up: one sketch per day and group, merged for any range of days.

A distinct count cannot be had from the distinct counts of its parts, so a report over another
range of days has to go through the lines again. A sketch can: the sketches of
days, regions or later deliveries unite to the sketch of them all, a few
kilobytes each, whatever they stand for. ``daily_orders`` and ``daily_buyers`` go
through the facts once; what they return is a table like any other (save it, append the
next day's rows) and ``over_days`` answers from it.

Counts are estimates. Their standard error is about 1.04 / sqrt(2^``precision``); up to
a few hundred values a sketch counts all but exactly. ``error_bound`` is
four times that, relative. Sums beside the sketches are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.functions.expressions import money_sum
from platter.plans.views import paid, with_category
from platter.schema import TOTAL, Tables

PRECISION = 12


def error_bound(precision: int = PRECISION) -> float:
    """Four standard errors of a merged estimate, relative."""
    return 4 * 1.04 / sqrt(2**precision)


def daily_orders(t: Tables, precision: int = PRECISION) -> DataFrame:
    """Per day and category: a sketch of its orders (``sketch``), quantity and revenue.

    Sketches are built in the map tasks, so what is shuffled is one sketch per task, day and category.
    """
    lines = t.order_items.select("order_id", "item_id", "quantity", "subtotal")
    placed = lines.join(t.menu_items.select("item_id", "category_id"), "item_id").join(
        t.orders.select("order_id", F.to_date("order_date").alias("order_day")), "order_id"
    )
    return placed.groupBy("order_day", "category_id").agg(
        F.hll_sketch_agg("order_id", precision).alias("sketch"),
        F.sum("quantity").cast("bigint").alias("quantity"),
        money_sum("subtotal").alias("revenue"),
    )


def daily_buyers(t: Tables, precision: int = PRECISION) -> DataFrame:
    """Per day and user type: a sketch of the users who paid (``sketch``), their paid orders and spending."""
    buying = paid(t.orders).select("user_id", "total_amount", F.to_date("order_date").alias("order_day"))
    return (
        buying.join(t.users.select("user_id", "user_type"), "user_id")
        .groupBy("order_day", "user_type")
        .agg(
            F.hll_sketch_agg("user_id", precision).alias("sketch"),
            F.count("*").alias("orders"),
            money_sum("total_amount").alias("spent"),
        )
    )


def over_days(
    daily: DataFrame, *by: str, sums: Sequence[str] = (), since: date | None = None, until: date | None = None
) -> DataFrame:
    """The daily rows from ``since`` to before ``until`` brought together per ``by``: the estimate (``distinct``) and the sums."""
    if since is not None:
        daily = daily.where(F.col("order_day") >= F.lit(since))
    if until is not None:
        daily = daily.where(F.col("order_day") < F.lit(until))
    types = dict(daily.dtypes)
    totals = [F.sum(c).cast(TOTAL if types[c].startswith("decimal") else "bigint").alias(c) for c in sums]
    return daily.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"), *totals)


def category_sales_sketched(t: Tables, daily: DataFrame, since: date | None = None, until: date | None = None) -> DataFrame:
    """Sales by category from daily sketches: the order count is an estimate, quantity and revenue are exact."""
    figures = over_days(daily, "category_id", sums=("quantity", "revenue"), since=since, until=until)
    return with_category(figures, t.categories).select(
        "category_name", F.col("distinct").alias("order_count"), F.col("quantity").alias("total_quantity"), F.col("revenue").alias("total_revenue")
    )
