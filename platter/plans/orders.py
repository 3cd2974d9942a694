"""Order listings, details and distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.functions.expressions import all_of, contains_text, money_sum, status_label
from platter.plans.views import SUMMARY, latest_first, order_summary, top_joined, with_category, with_customer
from platter.schema import PENDING_NARROW, TERMINAL, Tables


def order_search(
    t: Tables, term: str | None = None, order_status: str | None = None, payment_status: str | None = None
) -> DataFrame:
    """Orders of customers whose name or number contains ``term``, by status.

    The status filters work on the orders and the text filter on the users,
    each before the join.
    """
    orders = t.orders.where(
        all_of(
            [
                F.col("order_status") == order_status if order_status else None,
                F.col("payment_status") == payment_status if payment_status else None,
            ]
        )
    )
    users = t.users.where(contains_text(term, "name", "srn")) if term else t.users
    return (
        order_summary(t.with_(orders=orders, users=users))
        .orderBy(*latest_first("order_date", "order_id"))
        .select(*SUMMARY, status_label().alias("status_display"))
    )


def all_orders(t: Tables) -> DataFrame:
    return order_summary(t).orderBy(*latest_first("order_date", "order_id"))


def open_orders(t: Tables, statuses: Sequence[str] = PENDING_NARROW) -> DataFrame:
    """Orders that items can still be added to."""
    orders = t.orders.where(F.col("order_status").isin(*statuses))
    return (
        with_customer(orders, t.users, "name")
        .orderBy(*latest_first("order_date", "order_id"))
        .select("order_id", "name", "order_status", "total_amount")
    )


def unfinished_orders(t: Tables) -> DataFrame:
    """Orders that are neither completed nor cancelled."""
    orders = t.orders.where(~F.col("order_status").isin(*TERMINAL))
    return (
        with_customer(orders, t.users, "name")
        .orderBy(*latest_first("order_date", "order_id"))
        .select("order_id", "name", "order_status", "payment_status")
    )


def order_headers(t: Tables, ids: DataFrame) -> DataFrame:
    """Summary rows of the given order ids."""
    wanted = t.orders.join(ids.select("order_id").distinct(), "order_id", "left_semi")
    return order_summary(t.with_(orders=wanted))


def order_lines(t: Tables, ids: DataFrame) -> DataFrame:
    """Lines of the given order ids with item and category."""
    lines = t.order_items.join(ids.select("order_id").distinct(), "order_id", "left_semi")
    named = lines.join(t.menu_items.select("item_id", "item_name", "category_id"), "item_id")
    return with_category(named, t.categories).select(
        "order_id",
        "order_item_id",
        "item_name",
        "category_name",
        "quantity",
        "unit_price",
        "subtotal",
        "special_requests",
    )


def line_detail(t: Tables, k: int | None = 10) -> DataFrame:
    """Lines with order, customer, item and category, the latest orders first."""
    lines = t.order_items.select("order_item_id", "order_id", "item_id", "quantity", "unit_price", "subtotal")
    customers = t.users.select("user_id", F.col("name").alias("customer_name"), "srn")
    items = t.menu_items.select("item_id", "item_name", "category_id")

    def detailed(orders: DataFrame) -> DataFrame:
        joined = lines.join(orders, "order_id").join(customers, "user_id").join(items, "item_id")
        return with_category(joined, t.categories)

    return top_joined(
        t.orders.select("order_id", "user_id", "order_date", "order_status"),
        latest_first("order_date", "order_id"),
        k,
        detailed,
        then=[F.col(c) for c in ("order_item_id", "item_id", "quantity", "subtotal")],
    ).select(
        "order_id",
        "customer_name",
        "srn",
        "item_name",
        "category_name",
        "quantity",
        "unit_price",
        "subtotal",
        "order_status",
    )


def status_distribution(t: Tables) -> DataFrame:
    return (
        t.orders.groupBy("order_status")
        .agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "order_status")
    )


def _payment_figures() -> tuple[Column, Column]:
    return F.count("*").alias("n"), money_sum("total_amount").alias("total_amount")


def payment_breakdown(t: Tables) -> DataFrame:
    """Orders and amount per payment status and method."""
    return (
        t.orders.groupBy("payment_status", "payment_method")
        .agg(*_payment_figures())
        .orderBy(F.col("total_amount").desc(), "payment_status", "payment_method")
    )


def payment_hierarchy(t: Tables) -> DataFrame:
    """The same with a total per payment status and a grand total (null keys).

    The orders are summed to the few cells first, and only those are rolled up.
    """
    cells = t.orders.groupBy("payment_status", "payment_method").agg(*_payment_figures())
    return cells.rollup("payment_status", "payment_method").agg(
        F.sum("n").cast("bigint").alias("n"), money_sum("total_amount").alias("total_amount")
    )


def hourly_pattern(t: Tables) -> DataFrame:
    """Orders per hour of the day."""
    return (
        t.orders.groupBy(F.hour("order_date").alias("hour"))
        .agg(F.count("*").alias("order_count"))
        .orderBy("hour")
    )


def pending_wallet_orders(t: Tables, k: int | None = 5) -> DataFrame:
    """Wallet orders that are still to be paid, with the balance they would draw on."""
    orders = t.orders.where((F.col("payment_method") == "wallet") & (F.col("payment_status") == "pending"))
    first = top_joined(
        orders, [F.col("order_id")], k, lambda o: with_customer(o, t.users, "name", "wallet_balance")
    )
    return first.select("order_id", "name", "total_amount", "wallet_balance")


def cancelled_orders(t: Tables, k: int | None = 10) -> DataFrame:
    """Cancelled orders, the latest change first."""
    orders = t.orders.where(F.col("order_status") == "cancelled")
    users = t.users.withColumnRenamed("name", "customer_name")
    newest = top_joined(
        orders, latest_first("updated_at", "order_id"), k, lambda o: with_customer(o, users, "customer_name")
    )
    return newest.select("order_id", "customer_name", "total_amount", "order_status", "updated_at")


_LATEST = ("order_id", "order_date", "total_amount", "order_status", "payment_method", "payment_status")


def latest_orders(t: Tables) -> DataFrame:
    """The newest order (highest id) of every user, without ranking all of them."""
    newest = F.max(F.struct(*_LATEST)).alias("newest")
    return t.orders.groupBy("user_id").agg(newest).select("user_id", *(f"newest.{c}" for c in _LATEST))


def latest_order_lines(t: Tables) -> DataFrame:
    """The lines of every user's newest order."""
    newest = t.orders.groupBy("user_id").agg(F.max("order_id").alias("order_id"))
    return t.order_items.join(newest, "order_id").select(
        "user_id", "order_id", "order_item_id", "item_id", "quantity", "unit_price", "subtotal"
    )
