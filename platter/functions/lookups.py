"""Keyed lookups: wallet balance, order total and item sales.

Each takes a frame of keys and answers all of them in one pass.  The SQL
forms answer one key per call and are meant for interactive statements.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.functions.expressions import money_sum
from platter.schema import TOTAL


def _answer(keys: DataFrame, key: str, values: DataFrame, column: str) -> DataFrame:
    distinct = keys.select(key).distinct()
    return distinct.join(values, key, "left").select(
        key, F.coalesce(F.col(column), F.lit(0)).cast(TOTAL).alias(column)
    )


def wallet_balances(users: DataFrame, keys: DataFrame) -> DataFrame:
    """user_id -> wallet_balance; 0.00 for an unknown user or an empty wallet."""
    return _answer(keys, "user_id", users.select("user_id", "wallet_balance"), "wallet_balance")


def order_totals(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """order_id -> sum of its line subtotals, 0.00 without lines."""
    lines = lines.join(keys.select("order_id"), "order_id", "left_semi")
    totals = lines.groupBy("order_id").agg(money_sum("subtotal").alias("order_total"))
    return _answer(keys, "order_id", totals, "order_total")


def item_sales(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """item_id -> sum of its line subtotals over all orders, 0.00 when unsold."""
    lines = lines.join(keys.select("item_id"), "item_id", "left_semi")
    totals = lines.groupBy("item_id").agg(money_sum("subtotal").alias("total_sales"))
    return _answer(keys, "item_id", totals, "total_sales")


def register_sql_functions(spark: SparkSession) -> None:
    """``get_wallet_balance``, ``get_order_total`` and ``get_total_sales_for_item``.

    They read the temporary views of ``register_views``.
    """
    definitions = {
        "get_wallet_balance(p_user_id BIGINT)": (
            "SELECT max(u.wallet_balance) FROM users u WHERE u.user_id = p_user_id"
        ),
        "get_order_total(p_order_id BIGINT)": (
            "SELECT sum(l.subtotal) FROM order_items l WHERE l.order_id = p_order_id"
        ),
        "get_total_sales_for_item(p_item_id BIGINT)": (
            "SELECT sum(l.subtotal) FROM order_items l WHERE l.item_id = p_item_id"
        ),
    }
    for signature, body in definitions.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS DECIMAL(20,2) "
            f"RETURN coalesce(({body}), 0)"
        )
