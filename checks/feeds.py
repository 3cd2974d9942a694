"""Streams, exports and table access over the test tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.binding import over_model
from checks.ledger import Books
from checks.reports import REPORT_SQL
from platter.functions.lookups import register_sql_functions
from platter.plans import menu, orders, revenue
from platter.session import fresh_path
from platter.sources import sinks, tables
from platter.sources.retail import SOURCE_SCHEMAS
from platter.streaming import jobs

Job = Callable[[Books], DataFrame]


def _streamed(b: Books, stream: DataFrame, label: str) -> DataFrame:
    out = fresh_path(b.spark, label)
    jobs.write_parquet(stream, out, fresh_path(b.spark, f"{label}-checkpoint")).awaitTermination()
    return b.spark.read.schema(stream.schema).parquet(out)


def _daily_purchases(b: Books) -> DataFrame:
    events = jobs.file_stream(b.spark, f"{b.folder}/events.parquet*", SOURCE_SCHEMAS["events"])
    return _streamed(b, jobs.daily_activity(events, "purchase"), "daily-activity")


def _line_feed(b: Books) -> DataFrame:
    """Lines without a subtotal; the returned ones come without a price too."""
    raw = jobs.file_stream(b.spark, f"{b.folder}/lineitem.parquet*", SOURCE_SCHEMAS["lineitem"])
    price = F.when(F.col("l_returnflag") != "R", F.col("l_discount") + 1).cast("decimal(8,2)")
    return raw.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        price.alias("unit_price"),
    )


def _enriched(b: Books) -> DataFrame:
    return _streamed(b, jobs.enrich_lines(_line_feed(b), b.tables.menu_items), "enriched-lines")


def _exported(report: Callable[[Books], DataFrame], schema: str) -> Job:
    def run(b: Books) -> DataFrame:
        path = fresh_path(b.spark, "export")
        sinks.export_csv(report(b), path)
        return b.spark.read.schema(schema).option("header", True).csv(path)

    return run


def _appended(b: Books) -> DataFrame:
    """Append the users that pass the checks to a copy of nobody."""
    from platter.operators.quality import check_rules

    path = fresh_path(b.spark, "users")
    accepted, _ = sinks.append_validated(b.tables.users, check_rules()["users"], path)
    return b.spark.read.schema(accepted.schema).parquet(path)


def _appended_rejects(b: Books) -> DataFrame:
    from platter.operators.quality import check_rules

    return sinks.split_by_rules(b.tables.users, check_rules()["users"])[1].select("user_id", "reason")


def _parameterised(b: Books) -> DataFrame:
    tables.register_views(b.tables)
    return tables.sql(
        b.spark,
        "SELECT order_id, customer_name, total_amount FROM order_summary "
        "WHERE payment_status = :paid AND order_status = :status AND total_amount >= :least",
        paid="completed",
        status="ready",
        least=250000,
    )


def _sql_functions(b: Books) -> DataFrame:
    tables.register_views(b.tables)
    register_sql_functions(b.spark)
    return b.spark.sql(
        "SELECT category_id, item_id, get_total_sales_for_item(item_id) AS total_sales, "
        "get_order_total(item_id) AS order_total, get_wallet_balance(item_id) AS wallet_balance FROM menu_items"
    )


def _widened(b: Books) -> DataFrame:
    return tables.with_default_column(b.tables.menu_items.drop("stock"), "stock", "int", 10).select("item_id", "stock")


def _conformed(b: Books) -> DataFrame:
    new = b.tables.menu_items.select("item_id", "category_id", "item_name", "price")
    return tables.conform(new, "menu_items", datetime(2024, 1, 1)).select(
        "item_id", "stock", "is_available", "preparation_time_minutes"
    )


def _saved_and_loaded(b: Books) -> DataFrame:
    """The sales report over a snapshot that was written and read back."""
    folder = fresh_path(b.spark, "snapshot")
    whole = b.tables.with_(
        **{
            name: frame.withColumns(
                {c: F.col(c).cast("timestamp") for c, kind in frame.dtypes if kind == "timestamp_ntz"}
            )
            for name, frame in b.tables.items()
        }
    )
    tables.save_tables(whole, folder, orders_by_date=True)
    return menu.sales_by_category(tables.load_tables(b.spark, folder))


FEEDS: dict[str, tuple[Job, str]] = {
    "t1_daily_activity_stream": (
        _daily_purchases,
        """
        SELECT CAST(ts AS DATE) AS activity_day, COUNT(*) AS event_count,
               CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DECIMAL(20,2)) AS total_value
        FROM events WHERE event_type = 'purchase' GROUP BY 1
        HAVING CAST(ts AS DATE) + INTERVAL 1 DAY
               <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM events WHERE event_type = 'purchase')
        """,
    ),
    "t2_enriched_lines_stream": (
        _enriched,
        over_model(
            """
            SELECT l.l_orderkey AS order_id, l.l_partkey AS item_id, CAST(l.l_quantity AS INTEGER) AS quantity,
                   COALESCE(CASE WHEN l_returnflag <> 'R' THEN CAST(l_discount + 1 AS DECIMAL(8,2)) END, m.price)
                   AS unit_price,
                   CAST(COALESCE(CASE WHEN l_returnflag <> 'R' THEN CAST(l_discount + 1 AS DECIMAL(8,2)) END, m.price)
                        * CAST(l.l_quantity AS INTEGER) AS DECIMAL(10,2)) AS subtotal,
                   m.is_available AND m.stock > 0 AS item_available
            FROM lineitem l LEFT JOIN m_menu m ON m.item_id = l.l_partkey
            """
        ),
    ),
    "snk1_export_orders": (
        _exported(
            lambda b: orders.all_orders(b.tables),
            "order_id bigint, customer_name string, srn string, order_date timestamp_ntz, total_amount decimal(10,2), "
            "order_status string, payment_method string, payment_status string",
        ),
        over_model("SELECT * FROM m_summary"),
    ),
    "snk1_export_popular_items": (
        _exported(
            lambda b: menu.best_sellers(b.tables, None),
            "item_id bigint, item_name string, category_name string, order_count bigint, "
            "total_quantity_sold bigint, price decimal(8,2), revenue decimal(20,2)",
        ),
        over_model("SELECT *, CAST(price * total_quantity_sold AS DECIMAL(20,2)) AS revenue FROM m_popular"),
    ),
    "snk1_export_daily_revenue": (
        _exported(
            lambda b: revenue.daily_revenue(b.tables, None).drop("avg_order_value"),
            "order_day date, order_count bigint, daily_revenue decimal(20,2)",
        ),
        over_model(
            """
            SELECT CAST(order_date AS DATE) AS order_day, COUNT(*) AS order_count,
                   CAST(SUM(total_amount) AS DECIMAL(20,2)) AS daily_revenue
            FROM m_orders WHERE payment_status = 'completed' GROUP BY 1
            """
        ),
    ),
    "snk2_append_users": (
        _appended,
        over_model(
            r"""
            SELECT * FROM m_users WHERE wallet_balance >= 0
              AND regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$')
              AND (phone IS NULL OR regexp_matches(phone, '^[0-9]{10}$'))
            """
        ),
    ),
    "snk2_append_users_rejects": (
        _appended_rejects,
        over_model(
            r"""
            SELECT * FROM (
              SELECT user_id, CASE WHEN wallet_balance < 0 THEN 'wallet_balance_not_negative'
                WHEN NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') THEN 'email_format'
                WHEN NOT regexp_matches(phone, '^[0-9]{10}$') THEN 'phone_format' END AS reason FROM m_users) j
            WHERE reason IS NOT NULL
            """
        ),
    ),
    "src1_saved_snapshot": (_saved_and_loaded, REPORT_SQL["q23_sales_by_category"]),
    "src2_parameterised_sql": (
        _parameterised,
        over_model(
            """
            SELECT order_id, customer_name, total_amount FROM m_summary
            WHERE payment_status = 'completed' AND order_status = 'ready' AND total_amount >= 250000
            """
        ),
    ),
    "src7_default_column": (_widened, over_model("SELECT item_id, 10 AS stock FROM m_menu")),
    "src7_insert_defaults": (
        _conformed,
        over_model(
            "SELECT item_id, 10 AS stock, TRUE AS is_available, "
            "10 AS preparation_time_minutes FROM m_menu"
        ),
    ),
    "fn4_sql_functions": (
        _sql_functions,
        over_model(
            """
            SELECT m.category_id, m.item_id,
                   CAST(COALESCE((SELECT SUM(subtotal) FROM m_lines l WHERE l.item_id = m.item_id), 0)
                        AS DECIMAL(20,2)) AS total_sales,
                   CAST(COALESCE((SELECT SUM(subtotal) FROM m_lines l WHERE l.order_id = m.item_id), 0)
                        AS DECIMAL(20,2)) AS order_total,
                   CAST(COALESCE((SELECT MAX(wallet_balance) FROM m_users u WHERE u.user_id = m.item_id), 0)
                        AS DECIMAL(20,2)) AS wallet_balance
            FROM m_menu m
            """
        ),
    ),
}

FEED_SQL = {name: text for name, (_, text) in FEEDS.items()}
