"""Counts and headline figures."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.functions.expressions import mean, money_sum, on_day
from platter.plans.views import (
    count_where,
    latest_first,
    paid,
    popular_items,
    side_by_side,
    summarised,
    top,
    top_joined,
    with_category,
)
from platter.schema import LOW_STOCK, PENDING_NARROW, PENDING_WIDE, TOTAL, Tables

# Table labels as they are shown.
TABLE_LABELS = {
    "users": "Users",
    "categories": "Categories",
    "menu_items": "Menu_Items",
    "orders": "Orders",
    "order_items": "Order_Items",
}


def table_counts(t: Tables, names: Sequence[str] = tuple(TABLE_LABELS)) -> DataFrame:
    """Rows per table."""
    counts = [
        getattr(t, name).agg(F.count("*").alias("record_count")).select(
            F.lit(TABLE_LABELS[name]).alias("table_name"), "record_count"
        )
        for name in names
    ]
    return reduce(DataFrame.unionByName, counts)


def _or_zero(amount):
    return F.coalesce(amount, F.lit(0).cast(TOTAL))


def day_overview(t: Tables, as_of: date, pending: Sequence[str] = PENDING_WIDE) -> DataFrame:
    """Revenue and orders of one day, pending orders, available items."""
    today = on_day("order_date", as_of)
    settled = F.col("payment_status") == "completed"
    orders = t.orders.agg(
        _or_zero(money_sum(F.when(today & settled, F.col("total_amount")))).alias("revenue"),
        count_where(today).alias("today_orders"),
        count_where(F.col("order_status").isin(*pending)).alias("pending_orders"),
    )
    menu = t.menu_items.agg(count_where(F.col("is_available")).alias("available_items"))
    return side_by_side(orders, menu)


def day_sales(t: Tables, as_of: date) -> DataFrame:
    """Orders and paid revenue of one day only; the day filter reaches the scan."""
    settled = F.col("payment_status") == "completed"
    return t.orders.where(on_day("order_date", as_of)).agg(
        F.count("*").alias("today_orders"),
        _or_zero(money_sum(F.when(settled, F.col("total_amount")))).alias("today_revenue"),
    )


def kpis(t: Tables) -> DataFrame:
    """Paid revenue, orders, completed orders, mean paid order, users."""
    amount = F.when(F.col("payment_status") == "completed", F.col("total_amount"))
    orders = t.orders.agg(
        _or_zero(money_sum(amount)).alias("revenue"),
        F.count("*").alias("orders"),
        count_where(F.col("order_status") == "completed").alias("completed_orders"),
        F.coalesce(mean(amount), F.lit(0.0)).alias("avg_order_value"),
    )
    users = t.users.agg(F.count("*").alias("users"))
    return side_by_side(orders, users)


def menu_stats(t: Tables, low: int = LOW_STOCK) -> DataFrame:
    """Items by availability and stock level, in one pass."""
    stock = F.col("stock")
    return t.menu_items.agg(
        F.count("*").alias("total_items"),
        count_where(F.col("is_available")).alias("available_items"),
        count_where(~F.col("is_available")).alias("unavailable_items"),
        count_where((stock > 0) & (stock <= low)).alias("low_stock_items"),
        count_where(stock == 0).alias("out_of_stock_items"),
    )


def order_counts(t: Tables, pending: Sequence[str] = PENDING_NARROW) -> DataFrame:
    """Orders in total, pending and completed."""
    status = F.col("order_status")
    return t.orders.agg(
        F.count("*").alias("total_orders"),
        count_where(status.isin(*pending)).alias("pending_orders"),
        count_where(status == "completed").alias("completed_orders"),
    )


def user_counts(t: Tables) -> DataFrame:
    """Users in total, with orders and without.

    Orders always point at a user, so the difference of the two counts is
    the number of users without orders.
    """
    buyers = t.orders.agg(F.countDistinct("user_id").alias("users_with_orders"))
    users = t.users.agg(F.count("*").alias("total_users"))
    return side_by_side(users, buyers).select(
        "total_users",
        "users_with_orders",
        (F.col("total_users") - F.col("users_with_orders")).alias("users_without_orders"),
    )


def recent_orders(t: Tables, k: int = 5) -> DataFrame:
    """The latest orders."""
    newest = top_joined(t.orders, latest_first("order_date", "order_id"), k, lambda o: summarised(o, t.users))
    return newest.select("order_id", "customer_name", "total_amount", "order_status", "order_date")


def recent_paid_revenue(t: Tables) -> DataFrame:
    """Paid revenue over the whole history."""
    return paid(t.orders).agg(_or_zero(money_sum("total_amount")).alias("revenue"))


def table_sample(t: Tables, table: str, k: int = 5) -> DataFrame:
    """The first ``k`` rows of a table or view by its key; ``menu`` is the menu with its categories."""
    if table == "order_summary":
        return top_joined(t.orders, [F.col("order_id")], k, lambda o: summarised(o, t.users))
    if table == "popular_items":
        return top(popular_items(t), k, F.col("item_id"))
    if table == "menu":
        listed = top(with_category(t.menu_items, t.categories), k, F.col("item_id"))
        return listed.select("item_name", "category_name", "price", "is_available")
    frame = getattr(t, table)
    return top(frame, k, F.col(frame.columns[0]))
