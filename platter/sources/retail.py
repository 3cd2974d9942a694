"""Adapter that reads a retail star schema as an order snapshot.

Customers become users, parts become menu items, part types become
categories, order headers and lines keep their roles.  Suppliers become
further users and further items, in id ranges of their own: no order names
them, so users without orders and items that never sold stand in the whole
tables.  Every column is computed from its own row, so reading through the
adapter adds no join and no shuffle, and unused columns are not read.  Only the categories are a
distinct list; a short one is kept as a local frame once it is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from platter.schema import Tables
from platter.session import held_if_small

# Columns of the source tables, so that opening one needs no inference job.
SOURCE_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def read_source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


# One expression per column of the model.
CATEGORY_ID = "cast(conv(substring(md5(p_type), 1, 15), 16, 10) AS bigint)"
SIGNED_UP = "timestamp_ntz'1994-01-01 00:00:00' + make_dt_interval(c_nationkey)"
ORDERED_AT = "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey * 37 % 86400)"

USERS = (
    "c_custkey AS user_id",
    "concat('SRN', cast(c_custkey AS string)) AS srn",
    "c_name AS name",
    "concat('c', cast(c_custkey AS string), CASE WHEN c_nationkey = 13 THEN '@example' ELSE '@example.com' END) AS email",
    "CASE WHEN c_mktsegment = 'FURNITURE' THEN NULL WHEN c_nationkey = 7 THEN '12345' "
    "ELSE lpad(cast(c_custkey AS string), 10, '0') END AS phone",
    "CASE c_mktsegment WHEN 'BUILDING' THEN 'faculty' WHEN 'MACHINERY' THEN 'staff' ELSE 'student' END AS user_type",
    "cast(cast(c_acctbal AS decimal(10,2)) * 100 AS decimal(10,2)) AS wallet_balance",
    f"{SIGNED_UP} AS created_at",
    f"{SIGNED_UP} AS updated_at",
)
SUPPLIER_IDS = 10**12
SUPPLIER_USERS = (
    f"{SUPPLIER_IDS} + s_suppkey AS user_id",
    "concat('SUP', cast(s_suppkey AS string)) AS srn",
    "s_name AS name",
    "concat('supplier', cast(s_suppkey AS string), '@example.com') AS email",
    "lpad(cast(s_suppkey AS string), 10, '9') AS phone",
    "'staff' AS user_type",
    "cast(cast(s_acctbal AS decimal(10,2)) * 100 AS decimal(10,2)) AS wallet_balance",
    "timestamp_ntz'1994-01-01 00:00:00' + make_dt_interval(s_nationkey) AS created_at",
    "timestamp_ntz'1994-01-01 00:00:00' + make_dt_interval(s_nationkey) AS updated_at",
)
CATEGORIES = (
    f"{CATEGORY_ID} AS category_id",
    "p_type AS category_name",
    "cast(NULL AS string) AS description",
    "p_type <> 'ECONOMY' AS is_active",
    "timestamp_ntz'1994-01-01 00:00:00' AS created_at",
)
MENU_ITEMS = (
    "p_partkey AS item_id",
    f"{CATEGORY_ID} AS category_id",
    "p_name AS item_name",
    "p_brand AS description",
    "cast(p_retailprice AS decimal(8,2)) AS price",
    "p_size - 2 AS stock",
    "p_size > 2 AND p_brand <> 'Brand#10' AS is_available",
    "p_size AS preparation_time_minutes",
    "cast(NULL AS string) AS image_url",
    "cast(NULL AS string) AS nutritional_info",
    "timestamp_ntz'1994-06-01 00:00:00' + make_dt_interval(p_size) AS created_at",
    "timestamp_ntz'1998-01-01 00:00:00' + make_dt_interval(p_size * 7) AS updated_at",
)
SUPPLIER_ITEMS = (
    f"{SUPPLIER_IDS} + s_suppkey AS item_id",
    "cast(conv(substring(md5(if(s_nationkey < 10, 'SMALL', 'LARGE')), 1, 15), 16, 10) AS bigint) AS category_id",
    "s_name AS item_name",
    "cast(NULL AS string) AS description",
    "cast(abs(cast(s_acctbal AS decimal(10,2))) + 1.00BD AS decimal(8,2)) AS price",
    "s_nationkey - 2 AS stock",
    "s_nationkey > 4 AS is_available",
    "s_nationkey + 1 AS preparation_time_minutes",
    "cast(NULL AS string) AS image_url",
    "cast(NULL AS string) AS nutritional_info",
    "timestamp_ntz'1994-06-01 00:00:00' + make_dt_interval(s_nationkey) AS created_at",
    "timestamp_ntz'1998-01-01 00:00:00' + make_dt_interval(s_nationkey) AS updated_at",
)
ORDERS = (
    "o_orderkey AS order_id",
    "o_custkey AS user_id",
    f"{ORDERED_AT} AS order_date",
    "cast(o_totalprice AS decimal(10,2)) AS total_amount",
    "CASE o_orderstatus WHEN 'F' THEN if(o_orderkey % 2 = 0, 'completed', 'cancelled') "
    "WHEN 'O' THEN if(o_orderkey % 2 = 0, 'pending', 'confirmed') "
    "ELSE if(o_orderkey % 2 = 0, 'preparing', 'ready') END AS order_status",
    "CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'wallet' WHEN o_orderpriority = '2-HIGH' THEN 'cash' "
    "WHEN o_orderpriority = '3-MEDIUM' THEN 'upi' ELSE 'card' END AS payment_method",
    "CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'refunded' "
    "ELSE 'completed' END AS payment_status",
    "cast(NULL AS timestamp_ntz) AS estimated_ready_time",
    "cast(NULL AS string) AS special_instructions",
    f"{ORDERED_AT} AS created_at",
    f"{ORDERED_AT} AS updated_at",
)
ORDER_ITEMS = (
    "l_orderkey * 8 + l_linenumber AS order_item_id",
    "l_orderkey AS order_id",
    "l_partkey AS item_id",
    "cast(l_quantity AS int) AS quantity",
    "cast(cast(cast(cast(l_extendedprice AS decimal(10,2)) * 100 AS bigint) div cast(l_quantity AS bigint) "
    "AS decimal(12,0)) * 0.01BD AS decimal(8,2)) AS unit_price",
    "cast(l_extendedprice AS decimal(10,2)) AS subtotal",
    "CASE WHEN l_returnflag = 'R' THEN 'no onions' END AS special_requests",
)


def retail_tables(spark: SparkSession, folder: str) -> Tables:
    """The snapshot behind the star schema in ``folder``."""

    def view(source: str, columns: tuple[str, ...], more: tuple[str, ...] = ()) -> Callable[[], DataFrame]:
        def frame() -> DataFrame:
            rows = read_source(spark, folder, source).selectExpr(*columns)
            return rows.unionByName(read_source(spark, folder, "supplier").selectExpr(*more)) if more else rows

        return frame

    return Tables(
        users=view("customer", USERS, SUPPLIER_USERS),
        categories=lambda: held_if_small(
            read_source(spark, folder, "part").select("p_type").distinct().selectExpr(*CATEGORIES)
        ),
        menu_items=view("part", MENU_ITEMS, SUPPLIER_ITEMS),
        orders=view("orders", ORDERS),
        order_items=view("lineitem", ORDER_ITEMS),
    )
