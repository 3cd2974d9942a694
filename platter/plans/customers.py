"""User listings and what customers spend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.functions.expressions import all_of, contains_text, yes_no
from platter.plans.views import customer_totals, latest_first, paid, top, top_joined, with_customer
from platter.schema import TOTAL, Tables


def user_search(t: Tables, term: str | None = None, user_type: str | None = None) -> DataFrame:
    """Users whose name or number contains ``term``, the newest first."""
    wanted = all_of(
        [
            contains_text(term, "name", "srn") if term else None,
            F.col("user_type") == user_type if user_type else None,
        ]
    )
    return t.users.where(wanted).orderBy(*latest_first("created_at", "user_id"))


def user_directory(t: Tables) -> DataFrame:
    return t.users.select("user_id", "name", "srn", "wallet_balance").orderBy("name", "user_id")


def wallet_transactions(t: Tables, k: int | None = 10) -> DataFrame:
    """Orders paid, or to be paid, from a wallet."""
    orders = t.orders.where(F.col("payment_method") == "wallet")
    newest = top_joined(
        orders, latest_first("order_date", "order_id"), k, lambda o: with_customer(o, t.users, "name", "srn")
    )
    return newest.select("name", "srn", "order_id", "total_amount", "payment_status", "order_date")


def top_customers(t: Tables, k: int | None = 10) -> DataFrame:
    """Customers by what they paid."""
    spent = customer_totals(paid(t.orders)).join(t.users.select("user_id", "name", "srn", "user_type"), "user_id")
    return top(spent, k, F.col("total_spent").desc(), F.col("user_id")).select(
        "name", "srn", "user_type", "order_count", "total_spent"
    )


def most_active_customers(t: Tables, k: int | None = 5) -> DataFrame:
    """Customers by how many orders they paid."""
    average = F.col("total_spent").cast("double") / F.col("order_count").cast("double")
    spent = customer_totals(paid(t.orders)).join(t.users.select("user_id", "name", "user_type"), "user_id")
    return top(
        spent.withColumn("avg_order_value", average), k, F.col("order_count").desc(), F.col("user_id")
    ).select("name", "user_type", "order_count", "total_spent", "avg_order_value")


def user_type_stats(t: Tables) -> DataFrame:
    """Users, paid orders and spending per user type; types without orders stay."""
    spent = customer_totals(paid(t.orders))
    return (
        t.users.select("user_id", "user_type")
        .join(spent, "user_id", "left")
        .groupBy("user_type")
        .agg(
            F.count("*").alias("user_count"),
            F.coalesce(F.sum("order_count"), F.lit(0)).alias("order_count"),
            F.coalesce(F.sum("total_spent").cast(TOTAL), F.lit(0).cast(TOTAL)).alias("total_spent"),
        )
    )


def above_average_spenders(t: Tables) -> DataFrame:
    """Users who paid more in total than the mean paid order.

    The comparison is made on whole decimals (spent x orders > amount)
    instead of a rounded mean.
    """
    orders = paid(t.orders)
    overall = orders.agg(
        F.struct(
            F.sum("total_amount").cast("decimal(24,2)").alias("amount"),
            F.count("*").cast("decimal(16,0)").alias("orders"),
        ).alias("overall")
    ).scalar()
    return (
        customer_totals(orders)
        .withColumn("overall", overall)
        .where(F.col("total_spent") * F.col("overall.orders") > F.col("overall.amount"))
        .join(t.users.select("user_id", "name", "srn"), "user_id")
        .orderBy(F.col("total_spent").desc(), "user_id")
        .select("name", "srn", "total_spent")
    )


def users_with_history(t: Tables) -> DataFrame:
    """Users with their number of orders and whether they may be deleted."""
    history = t.orders.groupBy("user_id").agg(F.count("*").alias("order_count"))
    return (
        t.users.join(history, "user_id", "left")
        .withColumn("order_count", F.coalesce("order_count", F.lit(0)))
        .select(
            "user_id",
            "srn",
            "name",
            "email",
            "user_type",
            "wallet_balance",
            "order_count",
            yes_no(F.col("order_count") == 0).alias("can_delete"),
        )
        .orderBy("name", "user_id")
    )
