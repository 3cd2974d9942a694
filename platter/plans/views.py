"""The two standing views and the pieces that several reports share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.functions.expressions import money_sum
from platter.schema import Tables

SUMMARY = (
    "order_id",
    "customer_name",
    "srn",
    "order_date",
    "total_amount",
    "order_status",
    "payment_method",
    "payment_status",
)


def paid(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("payment_status") == "completed")


def top(df: DataFrame, k: int | None, *order: Column | str) -> DataFrame:
    """Sorted, and cut to ``k`` rows unless ``k`` is None."""
    ordered = df.orderBy(*order)
    return ordered if k is None else ordered.limit(k)


def top_joined(
    facts: DataFrame,
    order: Sequence[Column],
    k: int | None,
    attach: Callable[[DataFrame], DataFrame],
    then: Sequence[Column] = (),
) -> DataFrame:
    """The first ``k`` rows of ``attach(facts)`` by ``order`` of the facts, ``then`` by what was attached.

    The first ``k`` facts are found by a scan without a shuffle, and only they
    are attached.  That is the answer if it fills ``k`` rows, since every
    other fact ranks behind them.  Facts that attach to nothing may leave it
    short; then the whole join decides.  Which of the two it is, a scalar
    subquery of the same plan tells: otherwise no fact reaches the second join.
    """
    order = list(order)
    if k is None:
        return top(attach(facts), k, *order, *then)
    head = attach(facts.orderBy(*order).limit(k))

    def short() -> Column:
        return head.agg((F.count("*") < k).alias("short")).scalar()

    return top(head.where(~short()).unionByName(attach(facts.where(short()))), k, *order, *then)


def latest_first(column: str, key: str) -> tuple[Column, Column]:
    return F.col(column).desc(), F.col(key).asc()


def with_customer(orders: DataFrame, users: DataFrame, *columns: str) -> DataFrame:
    """Orders with columns of the user who placed them."""
    return orders.join(users.select("user_id", *columns), "user_id")


def with_category(items: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows that carry a category id, with the name of the category.

    Facts meet the item table first and the categories last: the planner
    knows the size of a table, but only guesses the size of a join.
    """
    return items.join(categories.select("category_id", "category_name"), "category_id")


def summarised(orders: DataFrame, users: DataFrame) -> DataFrame:
    """Orders in the columns of the order summary."""
    return with_customer(orders, users.withColumnRenamed("name", "customer_name"), "customer_name", "srn").select(
        *SUMMARY
    )


def order_summary(t: Tables) -> DataFrame:
    """Every order with its customer."""
    return summarised(t.orders, t.users)


def item_totals(lines: DataFrame) -> DataFrame:
    """Lines, quantity and amount per item, summed before any join.

    The sums shrink to one row per item inside the map tasks, so a
    best-seller costs no more to shuffle than any other item.
    """
    return lines.groupBy("item_id").agg(
        F.count("*").alias("order_count"),
        F.sum("quantity").cast("bigint").alias("total_quantity_sold"),
        money_sum("subtotal").alias("total_sales"),
    )


def popular_items(t: Tables) -> DataFrame:
    """Items that sold, with category, line count and quantity."""
    sold = item_totals(t.order_items).join(t.menu_items.select("item_id", "item_name", "price", "category_id"), "item_id")
    return with_category(sold, t.categories).select(
        "item_id", "item_name", "category_name", "order_count", "total_quantity_sold", "price"
    )


def customer_totals(orders: DataFrame) -> DataFrame:
    """Order count and amount per user, summed before any join."""
    return orders.groupBy("user_id").agg(
        F.count("*").alias("order_count"),
        money_sum("total_amount").alias("total_spent"),
    )


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """One-row frames with different columns as one row, without a join."""
    stacked = one_row[0]
    for frame in one_row[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*(F.max(c).alias(c) for c in stacked.columns))
