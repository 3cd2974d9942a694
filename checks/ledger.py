"""State changes and quality rules over whole tables, with their SQL twins.

The batches of requests are read from the same tables: events, order
headers, lines, parts and suppliers each stand for a feed of requests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.binding import over_model
from platter.operators import ordering, people, quality, stock, wallet
from platter.schema import Tables
from platter.sources.retail import SUPPLIER_IDS, read_source, retail_tables

@dataclass(frozen=True)
class Books:
    """The snapshot and the raw tables that requests are read from."""

    spark: SparkSession
    folder: str
    tables: Tables

    def raw(self, name: str) -> DataFrame:
        return read_source(self.spark, self.folder, name)


# --- request feeds ---------------------------------------------------------------------------------


def topup_requests(b: Books) -> DataFrame:
    amount = F.col("value").cast("decimal(10,2)") - F.lit(5).cast("decimal(10,2)")
    return b.raw("events").select(
        F.col("event_id").alias("request_id"),
        (F.col("user_id") * 11).alias("user_id"),
        F.when(F.col("event_type") != "error", amount).alias("amount"),
    )


TOPUPS = """
topups AS (
  SELECT event_id AS request_id, user_id * 11 AS user_id,
         CASE WHEN event_type <> 'error'
              THEN CAST(value AS DECIMAL(10,2)) - CAST(5 AS DECIMAL(10,2)) END AS amount
  FROM events)
"""


def order_requests(b: Books) -> DataFrame:
    status = F.col("payment_status")
    return b.tables.orders.select(
        F.col("order_id").alias("request_id"),
        (F.col("user_id") + F.when(F.col("order_status") == "ready", 100).otherwise(0)).alias("user_id"),
        F.when((F.col("payment_method") == "card") & (F.col("order_status") == "completed"), F.lit("cheque"))
        .otherwise(F.col("payment_method"))
        .alias("payment_method"),
        F.floor(F.col("total_amount").cast("double") / 240.0).cast("bigint").alias("item_id"),
        F.when(status == "pending", 0).when(status == "failed", 60).otherwise(F.col("user_id") % 7 + 1)
        .cast("int")
        .alias("quantity"),
    )


PLACED = """
wanted AS (
  SELECT order_id AS request_id,
         user_id + CASE WHEN order_status = 'ready' THEN 100 ELSE 0 END AS user_id,
         CASE WHEN payment_method = 'card' AND order_status = 'completed' THEN 'cheque'
              ELSE payment_method END AS payment_method,
         CAST(floor(CAST(total_amount AS DOUBLE) / 240.0) AS BIGINT) AS item_id,
         CAST(CASE payment_status WHEN 'pending' THEN 0 WHEN 'failed' THEN 60 ELSE user_id % 7 + 1 END
              AS INTEGER) AS quantity
  FROM m_orders)
""", """
judged AS (
  SELECT w.*, m.price, CAST(m.price * w.quantity AS DECIMAL(10,2)) AS amount,
         CASE WHEN u.user_id IS NULL THEN 'user_not_found'
              WHEN m.item_id IS NULL THEN 'item_not_found'
              WHEN w.payment_method NOT IN ('wallet', 'cash', 'upi', 'card') THEN 'invalid_payment_method'
              WHEN NOT (m.is_available AND m.stock > 0) THEN 'item_unavailable'
              WHEN w.quantity < 1 THEN 'invalid_quantity'
              WHEN w.quantity > m.stock THEN 'insufficient_stock'
              WHEN w.payment_method = 'wallet' AND u.wallet_balance < m.price * w.quantity
                   THEN 'insufficient_balance' END AS reason
  FROM wanted w LEFT JOIN m_users u ON u.user_id = w.user_id LEFT JOIN m_menu m ON m.item_id = w.item_id)
""", """
placed AS (
  SELECT *, row_number() OVER (ORDER BY request_id) AS nth FROM judged WHERE reason IS NULL)
"""


def addition_requests(b: Books) -> DataFrame:
    return b.raw("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).otherwise(F.col("l_suppkey") * 7).alias("item_id"),
        F.col("l_linenumber").alias("quantity"),
    )


ADDED = """
wanted AS (
  SELECT l_orderkey AS order_id, CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE l_suppkey * 7 END AS item_id,
         l_linenumber AS quantity
  FROM lineitem)
""", """
judged AS (
  SELECT w.*, m.price,
         CASE WHEN o.order_id IS NULL THEN 'order_not_found'
              WHEN o.order_status NOT IN ('pending', 'confirmed') THEN 'order_not_open'
              WHEN m.item_id IS NULL THEN 'item_not_found'
              WHEN NOT (m.is_available AND m.stock > 0) THEN 'item_unavailable'
              WHEN w.quantity < 1 THEN 'invalid_quantity'
              WHEN w.quantity > m.stock THEN 'insufficient_stock' END AS reason
  FROM wanted w LEFT JOIN m_orders o ON o.order_id = w.order_id LEFT JOIN m_menu m ON m.item_id = w.item_id)
""", """
added AS (
  SELECT order_id, item_id, CAST(SUM(quantity) AS INTEGER) AS n, MAX(price) AS price FROM judged
  WHERE reason IS NULL GROUP BY order_id, item_id)
""", """
after_lines AS (
  SELECT l.order_item_id, l.order_id, l.item_id, l.quantity + COALESCE(a.n, 0) AS quantity, l.unit_price,
         CASE WHEN a.n IS NULL THEN l.subtotal
              ELSE CAST((l.quantity + a.n) * l.unit_price AS DECIMAL(10,2)) END AS subtotal
  FROM m_lines l LEFT JOIN added a ON a.order_id = l.order_id AND a.item_id = l.item_id
  UNION ALL
  SELECT (SELECT MAX(order_item_id) FROM m_lines) + row_number() OVER (ORDER BY order_id, item_id),
         order_id, item_id, n, price, CAST(n * price AS DECIMAL(10,2))
  FROM added a
  WHERE NOT EXISTS (SELECT 1 FROM m_lines l WHERE l.order_id = a.order_id AND l.item_id = a.item_id))
"""


def order_id_requests(b: Books) -> DataFrame:
    return b.raw("events").select((F.col("event_id") * 3).alias("order_id"))


ORDER_IDS = "order_ids AS (SELECT DISTINCT event_id * 3 AS order_id FROM events)"


def user_id_requests(b: Books) -> DataFrame:
    """Buyers, users who never ordered, and ids that nobody has."""
    suppliers = b.raw("supplier").select((F.lit(SUPPLIER_IDS) + F.col("s_suppkey") * (F.col("s_nationkey") - 3)).alias("user_id"))
    return b.raw("events").select((F.col("user_id") * 11).alias("user_id")).unionByName(suppliers)


USER_IDS = """
user_ids AS (SELECT user_id * 11 AS user_id FROM events
             UNION SELECT 1000000000000 + s_suppkey * (s_nationkey - 3) FROM supplier)
"""


def item_id_requests(b: Books) -> DataFrame:
    """Items that sold, items that never did, and ids of none."""
    suppliers = b.raw("supplier").select((F.lit(SUPPLIER_IDS) + F.col("s_suppkey") * (F.col("s_nationkey") - 3)).alias("item_id"))
    return b.raw("events").select((F.col("user_id") * 20).alias("item_id")).unionByName(suppliers)


ITEM_IDS = """
item_ids AS (SELECT user_id * 20 AS item_id FROM events
             UNION SELECT 1000000000000 + s_suppkey * (s_nationkey - 3) FROM supplier)
"""

def stock_requests(b: Books) -> DataFrame:
    kind = F.col("p_type")
    mode = (
        F.when(kind == "LARGE", F.lit("set"))
        .when(kind == "MEDIUM", F.lit("reduce"))
        .when(kind == "PROMO", F.lit("recount"))
        .otherwise(F.lit("add"))
    )
    counts = b.raw("part").select(
        F.col("p_partkey").alias("item_id"), mode.alias("mode"), (F.col("p_size") - 10).alias("quantity")
    )
    deliveries = b.raw("supplier").select(
        (F.col("s_suppkey") * 30).alias("item_id"), F.lit("add").alias("mode"), F.lit(5).alias("quantity")
    )
    return counts.unionByName(deliveries)


STOCKED = """
wanted AS (
  SELECT p_partkey AS item_id,
         CASE p_type WHEN 'LARGE' THEN 'set' WHEN 'MEDIUM' THEN 'reduce' WHEN 'PROMO' THEN 'recount'
              ELSE 'add' END AS mode, p_size - 10 AS quantity
  FROM part
  UNION ALL SELECT s_suppkey * 30, 'add', 5 FROM supplier)
""", """
judged AS (
  SELECT w.*, m.stock, m.is_available,
         CASE WHEN COUNT(*) OVER (PARTITION BY w.item_id) > 1 THEN 'duplicate_request'
              WHEN m.item_id IS NULL THEN 'item_not_found'
              WHEN w.mode NOT IN ('add', 'set', 'reduce') THEN 'invalid_mode'
              WHEN w.quantity < CASE WHEN w.mode = 'set' THEN 0 ELSE 1 END THEN 'invalid_quantity'
              WHEN w.mode = 'reduce' AND w.quantity > m.stock THEN 'insufficient_stock' END AS reason
  FROM wanted w LEFT JOIN m_menu m ON m.item_id = w.item_id)
"""


def restore_requests(b: Books) -> DataFrame:
    off = b.tables.menu_items.where(~F.col("is_available")).select("item_id")
    return off.unionByName(b.raw("supplier").select((F.col("s_suppkey") * 30).alias("item_id")))


RESTORED = """
wanted AS (
  SELECT item_id FROM m_menu WHERE NOT is_available
  UNION SELECT s_suppkey * 30 FROM supplier)
"""


def status_requests(b: Books) -> DataFrame:
    """Every order is settled, reopened and settled again."""
    orders = b.tables.orders.select("order_id", "order_status", "payment_method")
    step = F.lit(10**12)
    settle = orders.select(
        F.col("order_id").alias("seq"),
        "order_id",
        F.lit("completed").alias("order_status"),
        F.lit("completed").alias("payment_status"),
    )
    reopen = orders.select(
        (step + F.col("order_id")).alias("seq"),
        "order_id",
        F.when(F.col("order_status") == "ready", F.lit("shipped")).otherwise(F.lit("pending")).alias("order_status"),
        F.lit("pending").alias("payment_status"),
    )
    again = orders.select(
        (step * 2 + F.col("order_id")).alias("seq"),
        (F.col("order_id") + F.when(F.col("payment_method") == "card", 10**9).otherwise(0)).alias("order_id"),
        F.lit("ready").alias("order_status"),
        F.lit("completed").alias("payment_status"),
    )
    return settle.unionByName(reopen).unionByName(again).withColumn("request_id", F.col("seq"))


STATUSES = """
wanted AS (
  SELECT order_id AS seq, order_id, 'completed' AS order_status, 'completed' AS payment_status FROM m_orders
  UNION ALL
  SELECT 1000000000000 + order_id, order_id, CASE order_status WHEN 'ready' THEN 'shipped' ELSE 'pending' END,
         'pending' FROM m_orders
  UNION ALL
  SELECT 2000000000000 + order_id, order_id + CASE payment_method WHEN 'card' THEN 1000000000 ELSE 0 END,
         'ready', 'completed' FROM m_orders)
""", """
judged AS (
  SELECT w.*, o.user_id, o.payment_method, o.total_amount, o.payment_status AS had, o.order_id IS NOT NULL AS known,
         CASE WHEN w.order_status NOT IN ('pending', 'confirmed', 'preparing', 'ready', 'completed', 'cancelled')
                   THEN 'invalid_order_status'
              WHEN o.order_id IS NULL THEN 'order_not_found' END AS reason
  FROM wanted w LEFT JOIN m_orders o ON o.order_id = w.order_id)
""", """
known AS (
  SELECT *, payment_method = 'wallet' AND payment_status = 'completed'
            AND COALESCE(lag(payment_status) OVER (PARTITION BY order_id ORDER BY seq), had) <> 'completed' AS draws
  FROM judged WHERE reason IS NULL)
""", """
debits AS (
  SELECT user_id, seq, total_amount, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS nth
  FROM known WHERE draws)
""", """
walked AS (
  SELECT user_id, CAST(0 AS BIGINT) AS nth, wallet_balance AS funds, CAST(NULL AS BIGINT) AS seq, FALSE AS granted
  FROM m_users
  UNION ALL
  SELECT w.user_id, d.nth,
         CAST(CASE WHEN d.total_amount <= w.funds THEN w.funds - d.total_amount ELSE w.funds END AS DECIMAL(10,2)),
         d.seq, d.total_amount <= w.funds
  FROM walked w JOIN debits d ON d.user_id = w.user_id AND d.nth = w.nth + 1)
""", """
settled AS (
  SELECT *, CASE WHEN payment_status = 'completed' AND NOT COALESCE(last_granted, TRUE)
                 THEN 'insufficient_balance' END AS refusal
  FROM (SELECT k.*, last_value(w.granted IGNORE NULLS) OVER (PARTITION BY k.order_id ORDER BY k.seq) AS last_granted
        FROM known k LEFT JOIN walked w ON w.seq = k.seq) s)
"""


def user_requests(b: Books) -> DataFrame:
    key = F.col("s_suppkey")
    text = key.cast("string")
    return b.raw("supplier").select(
        key.alias("request_id"),
        F.when(F.col("s_nationkey") < 4, F.concat(F.lit("srn"), text))
        .otherwise(F.concat(F.lit("new"), (key % 60).cast("string")))
        .alias("srn"),
        F.when(F.col("s_nationkey") != 5, F.col("s_name")).alias("name"),
        F.concat(F.lit("S"), (key % 70).cast("string"), F.lit("@example.com")).alias("email"),
        F.when(F.col("s_nationkey") == 6, F.lit("123"))
        .when(F.col("s_nationkey") == 8, F.lit(""))
        .otherwise(F.lit("9000000000"))
        .alias("phone"),
        F.when(F.col("s_nationkey") == 9, F.lit("guest")).otherwise(F.lit("staff")).alias("user_type"),
        F.col("s_acctbal").cast("decimal(10,2)").alias("wallet_balance"),
    )


NEW_USERS = """
wanted AS (
  SELECT s_suppkey AS request_id,
         CASE WHEN s_nationkey < 4 THEN 'srn' || s_suppkey ELSE 'new' || (s_suppkey % 60) END AS srn,
         CASE WHEN s_nationkey <> 5 THEN s_name END AS name,
         'S' || (s_suppkey % 70) || '@example.com' AS email,
         CASE s_nationkey WHEN 6 THEN '123' WHEN 8 THEN NULL ELSE '9000000000' END AS phone,
         CASE s_nationkey WHEN 9 THEN 'guest' ELSE 'staff' END AS user_type,
         CAST(s_acctbal AS DECIMAL(10,2)) AS wallet_balance
  FROM supplier)
""", """
judged AS (
  SELECT w.*, CASE WHEN name IS NULL THEN 'missing_field'
                   WHEN phone = '123' THEN 'invalid_phone'
                   WHEN user_type = 'guest' THEN 'invalid_user_type'
                   WHEN wallet_balance < 0 THEN 'negative_balance'
                   WHEN lower(srn) IN (SELECT lower(srn) FROM m_users) THEN 'duplicate_srn'
                   WHEN lower(email) IN (SELECT lower(email) FROM m_users) THEN 'duplicate_email' END AS reason
  FROM wanted w)
""", """
queue AS (
  SELECT *, row_number() OVER (ORDER BY request_id) AS nth FROM judged WHERE reason IS NULL)
""", """
walk AS (
  SELECT CAST(0 AS BIGINT) AS nth, CAST([] AS VARCHAR[]) AS srns, CAST([] AS VARCHAR[]) AS emails,
         CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS late
  UNION ALL
  SELECT q.nth,
         CASE WHEN list_contains(w.srns, q.srn) OR list_contains(w.emails, q.email) THEN w.srns
              ELSE list_append(w.srns, q.srn) END,
         CASE WHEN list_contains(w.srns, q.srn) OR list_contains(w.emails, q.email) THEN w.emails
              ELSE list_append(w.emails, q.email) END,
         q.request_id,
         CASE WHEN list_contains(w.srns, q.srn) THEN 'duplicate_srn'
              WHEN list_contains(w.emails, q.email) THEN 'duplicate_email' END
  FROM walk w JOIN queue q ON q.nth = w.nth + 1)
"""


def item_requests(b: Books) -> DataFrame:
    return b.raw("part").select(
        F.col("p_partkey").alias("request_id"),
        F.when(F.col("p_brand") != "Brand#3", F.col("p_name")).alias("item_name"),
        F.when(F.col("p_brand") == "Brand#4", F.lit(-1))
        .otherwise(F.conv(F.substring(F.md5("p_type"), 1, 15), 16, 10).cast("bigint"))
        .alias("category_id"),
        (F.col("p_retailprice").cast("decimal(8,2)") - F.lit(900).cast("decimal(8,2)")).alias("price"),
        F.when(F.col("p_brand") != "Brand#5", F.col("p_size") - 2).alias("stock"),
        (F.col("p_size") - 1).alias("preparation_time_minutes"),
    )


NEW_ITEMS = """
wanted AS (
  SELECT p_partkey AS request_id, CASE WHEN p_brand <> 'Brand#3' THEN p_name END AS item_name,
         CASE WHEN p_brand = 'Brand#4' THEN -1
              ELSE CAST('0x' || substr(md5(p_type), 1, 15) AS BIGINT) END AS category_id,
         CAST(p_retailprice AS DECIMAL(8,2)) - CAST(900 AS DECIMAL(8,2)) AS price,
         CASE WHEN p_brand <> 'Brand#5' THEN p_size - 2 ELSE 10 END AS stock,
         p_size - 1 AS preparation_time_minutes
  FROM part)
""", """
judged AS (
  SELECT w.*, CASE WHEN item_name IS NULL THEN 'missing_field'
                   WHEN category_id NOT IN (SELECT category_id FROM m_categories) THEN 'category_not_found'
                   WHEN price < 1 THEN 'invalid_price'
                   WHEN stock < 0 THEN 'invalid_stock'
                   WHEN preparation_time_minutes < 1 THEN 'invalid_preparation_time' END AS reason
  FROM wanted w)
"""

# --- registered queries ----------------------------------------------------------------------------

_USERS = "SELECT user_id, wallet_balance FROM m_users"
_MENU = ("item_id", "stock", "is_available")

Job = Callable[[Books], DataFrame]

def _lost_rows(headers: str) -> str:
    """Per reference, the rows whose key no row of the other table has; ``headers`` is the table of orders."""
    # The labels of the report.
    references = {
        "Orders without valid user": (headers, "m_users", "user_id"),
        "Order_Items without valid order": ("m_lines", headers, "order_id"),
        "Order_Items without valid menu item": ("m_lines", "m_menu", "item_id"),
        "Menu_Items without valid category": ("m_menu", "m_categories", "category_id"),
    }
    return " UNION ALL ".join(
        f"SELECT '{label}' AS test, COUNT(*) AS violations FROM {rows} "
        f"WHERE NOT EXISTS (SELECT 1 FROM {others} WHERE {others}.{key} = {rows}.{key})"
        for label, (rows, others, key) in references.items()
    )


def broken_books(b: Books) -> Tables:
    """The whole books with values that break every kind of rule."""
    t = b.tables
    late, size = F.col("order_status") == "cancelled", F.col("quantity")
    return t.with_(
        users=t.users.withColumns(
            {
                "name": F.when(F.col("user_type") != "staff", F.col("name")),
                "user_type": F.when(F.col("phone") == "12345", F.lit("guest")).otherwise(F.col("user_type")),
            }
        ),
        menu_items=t.menu_items.withColumns(
            {
                "category_id": F.when(F.col("description") == "Brand#4", F.lit(-1).cast("bigint")).otherwise(F.col("category_id")),
                "price": F.when(F.col("description") != "Brand#3", F.col("price")),
                "preparation_time_minutes": F.col("stock"),
            }
        ),
        orders=t.orders.withColumns(
            {
                "user_id": F.when(late & (F.col("payment_status") == "failed"), -F.col("user_id")).otherwise(F.col("user_id")),
                "payment_method": F.when(F.col("order_status") == "ready", F.lit("cheque")).otherwise(F.col("payment_method")),
                "total_amount": F.when(F.col("order_status") == "preparing", -F.col("total_amount")).otherwise(F.col("total_amount")).cast("decimal(10,2)"),
            }
        ),
        order_items=t.order_items.withColumns(
            {
                "order_id": F.when(size == 7, -F.col("order_id")).otherwise(F.col("order_id")),
                "item_id": F.when(size == 9, F.lit(None)).when(size == 10, -F.col("item_id")).otherwise(F.col("item_id")),
                "quantity": F.when(size == 11, F.lit(0)).otherwise(size),
            }
        ),
    )


BROKEN_BOOKS = (
    """
    b_users AS (SELECT * REPLACE (CASE WHEN user_type <> 'staff' THEN name END AS name,
                                  CASE WHEN phone = '12345' THEN 'guest' ELSE user_type END AS user_type) FROM m_users)
    """,
    """
    b_menu AS (SELECT * REPLACE (CASE WHEN description = 'Brand#4' THEN -1 ELSE category_id END AS category_id,
                                 CASE WHEN description <> 'Brand#3' THEN price END AS price,
                                 stock AS preparation_time_minutes) FROM m_menu)
    """,
    """
    b_orders AS (SELECT * REPLACE (
      CASE WHEN order_status = 'cancelled' AND payment_status = 'failed' THEN -user_id ELSE user_id END AS user_id,
      CASE WHEN order_status = 'ready' THEN 'cheque' ELSE payment_method END AS payment_method,
      CASE WHEN order_status = 'preparing' THEN -total_amount ELSE total_amount END AS total_amount) FROM m_orders)
    """,
    """
    b_lines AS (SELECT * REPLACE (
      CASE WHEN quantity = 7 THEN -order_id ELSE order_id END AS order_id,
      CASE WHEN quantity = 9 THEN NULL WHEN quantity = 10 THEN -item_id ELSE item_id END AS item_id,
      CASE WHEN quantity = 11 THEN 0 ELSE quantity END AS quantity) FROM m_lines)
    """,
)

# Kind, table, its rows, primary key, rule, column looked at, when the rule is broken.
_BREAKS = [
    ("reference", "orders", "b_orders", "order_id", "Orders without valid user", "user_id",
     "NOT EXISTS (SELECT 1 FROM b_users p WHERE p.user_id = r.user_id)"),
    ("reference", "order_items", "b_lines", "order_item_id", "Order_Items without valid order", "order_id",
     "NOT EXISTS (SELECT 1 FROM b_orders p WHERE p.order_id = r.order_id)"),
    ("reference", "order_items", "b_lines", "order_item_id", "Order_Items without valid menu item", "item_id",
     "NOT EXISTS (SELECT 1 FROM b_menu p WHERE p.item_id = r.item_id)"),
    ("reference", "menu_items", "b_menu", "item_id", "Menu_Items without valid category", "category_id",
     "NOT EXISTS (SELECT 1 FROM m_categories p WHERE p.category_id = r.category_id)"),
    ("check", "users", "b_users", "user_id", "wallet_balance_not_negative", "wallet_balance", "wallet_balance < 0"),
    ("check", "users", "b_users", "user_id", "email_format", "email",
     r"NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$')"),
    ("check", "users", "b_users", "user_id", "phone_format", "phone", "NOT regexp_matches(phone, '^[0-9]{10}$')"),
    ("check", "menu_items", "b_menu", "item_id", "price_positive", "price", "price <= 0"),
    ("check", "menu_items", "b_menu", "item_id", "preparation_time_positive", "preparation_time_minutes",
     "preparation_time_minutes <= 0"),
    ("check", "orders", "b_orders", "order_id", "total_amount_positive", "total_amount", "total_amount <= 0"),
    ("check", "order_items", "b_lines", "order_item_id", "quantity_positive", "quantity", "quantity <= 0"),
    ("check", "order_items", "b_lines", "order_item_id", "unit_price_positive", "unit_price", "unit_price <= 0"),
    ("enum", "users", "b_users", "user_id", "users.user_type", "user_type",
     "user_type NOT IN ('student', 'faculty', 'staff')"),
    ("enum", "orders", "b_orders", "order_id", "orders.order_status", "order_status",
     "order_status NOT IN ('pending', 'confirmed', 'preparing', 'ready', 'completed', 'cancelled')"),
    ("enum", "orders", "b_orders", "order_id", "orders.payment_method", "payment_method",
     "payment_method NOT IN ('wallet', 'cash', 'upi', 'card')"),
    ("enum", "orders", "b_orders", "order_id", "orders.payment_status", "payment_status",
     "payment_status NOT IN ('pending', 'completed', 'failed', 'refunded')"),
    *(
        ("not_null", table, rows, key, f"{table}.{column}", column, f"{column} IS NULL")
        for table, rows, key, columns in (
            ("users", "b_users", "user_id", "user_id srn name email user_type"),
            ("categories", "m_categories", "category_id", "category_id category_name"),
            ("menu_items", "b_menu", "item_id", "item_id category_id item_name price"),
            ("orders", "b_orders", "order_id", "order_id user_id total_amount payment_method"),
            ("order_items", "b_lines", "order_item_id", "order_item_id order_id item_id quantity unit_price subtotal"),
        )
        for column in columns.split()
    ),
]


def _broken_rows(*kinds: str) -> str:
    return over_model(
        " UNION ALL ".join(
            f"SELECT '{table}' AS table_name, {key} AS row_id, '{kind}' AS kind, '{rule}' AS rule, "
            f"CAST({column} AS VARCHAR) AS value FROM {rows} r WHERE {broken}"
            for kind, table, rows, key, rule, column, broken in _BREAKS
            if kind in kinds
        ),
        *BROKEN_BOOKS,
    )


def _broken_counts(*kinds: str) -> str:
    return over_model(
        " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, '{rule}' AS rule, COUNT(*) AS violations FROM {rows} r WHERE {broken}"
            for kind, _, rows, _, rule, _, broken in _BREAKS
            if kind in kinds
        ),
        *BROKEN_BOOKS,
    )


JOBS: dict[str, tuple[Job, str]] = {
    "p01_topup_balances": (
        lambda b: wallet.apply_topups(b.tables, topup_requests(b)).tables.users.select("user_id", "wallet_balance"),
        over_model(
            """
            SELECT u.user_id, CAST(u.wallet_balance + COALESCE(a.added, 0) AS DECIMAL(10,2)) AS wallet_balance
            FROM m_users u LEFT JOIN (SELECT user_id, SUM(amount) AS added FROM topups WHERE amount > 0 GROUP BY 1) a
                 ON a.user_id = u.user_id
            """,
            TOPUPS,
        ),
    ),
    "p01_topup_rejects": (
        lambda b: wallet.apply_topups(b.tables, topup_requests(b)).rejects,
        over_model(
            """
            SELECT * FROM (
              SELECT r.*, CASE WHEN amount IS NULL OR amount <= 0 THEN 'Amount must be positive'
                               WHEN u.user_id IS NULL THEN 'user_not_found' END AS reason
              FROM topups r LEFT JOIN m_users u ON u.user_id = r.user_id) judged
            WHERE reason IS NOT NULL
            """,
            TOPUPS,
        ),
    ),
    "p02_place_orders_new": (
        lambda b: ordering.place_orders(b.tables, order_requests(b)).done,
        over_model(
            """
            SELECT request_id, (SELECT MAX(order_id) FROM m_orders) + nth AS order_id, amount AS total_amount
            FROM placed
            """,
            *PLACED,
        ),
    ),
    "p02_place_orders_headers": (
        lambda b: ordering.place_orders(b.tables, order_requests(b)).tables.orders.select(
            "order_id", "user_id", "total_amount", "order_status", "payment_method", "payment_status"
        ),
        over_model(
            """
            SELECT order_id, user_id, total_amount, order_status, payment_method, payment_status FROM m_orders
            UNION ALL
            SELECT (SELECT MAX(order_id) FROM m_orders) + nth, user_id, amount, 'pending', payment_method, 'pending'
            FROM placed
            """,
            *PLACED,
        ),
    ),
    "p02_place_orders_lines": (
        lambda b: ordering.place_orders(b.tables, order_requests(b)).tables.order_items.drop("special_requests"),
        over_model(
            """
            SELECT order_item_id, order_id, item_id, quantity, unit_price, subtotal FROM m_lines
            UNION ALL
            SELECT (SELECT MAX(order_item_id) FROM m_lines) + nth, (SELECT MAX(order_id) FROM m_orders) + nth,
                   item_id, quantity, price, amount
            FROM placed
            """,
            *PLACED,
        ),
    ),
    "p02_place_orders_rejects": (
        lambda b: ordering.place_orders(b.tables, order_requests(b)).rejects,
        over_model(
            """
            SELECT request_id, user_id, payment_method, item_id, quantity, reason FROM judged WHERE reason IS NOT NULL
            """,
            *PLACED,
        ),
    ),
    "p03_add_items_lines": (
        lambda b: ordering.add_items_to_orders(b.tables, addition_requests(b)).tables.order_items.drop(
            "special_requests"
        ),
        over_model("SELECT * FROM after_lines", *ADDED),
    ),
    "p03_add_items_totals": (
        lambda b: ordering.add_items_to_orders(b.tables, addition_requests(b)).tables.orders.select(
            "order_id", "total_amount"
        ),
        over_model(
            """
            SELECT o.order_id, CASE WHEN o.order_id IN (SELECT order_id FROM added)
                                    THEN (SELECT CAST(SUM(l.subtotal) AS DECIMAL(10,2)) FROM after_lines l
                                          WHERE l.order_id = o.order_id)
                                    ELSE o.total_amount END AS total_amount
            FROM m_orders o
            """,
            *ADDED,
        ),
    ),
    "p03_add_items_rejects": (
        lambda b: ordering.add_items_to_orders(b.tables, addition_requests(b)).rejects,
        over_model(
            "SELECT order_id, item_id, quantity, reason FROM judged WHERE reason IS NOT NULL", *ADDED
        ),
    ),
    "p04_deduct_stock": (
        lambda b: stock.deduct_stock(b.tables, order_id_requests(b)).tables.menu_items.select(*_MENU),
        over_model(
            """
            SELECT item_id, stock, is_available AND stock > 0 AS is_available FROM (
              SELECT m.item_id, m.is_available, CAST(m.stock - COALESCE(q.n, 0) AS INTEGER) AS stock
              FROM m_menu m LEFT JOIN (SELECT item_id, SUM(quantity) AS n FROM m_lines
                                       WHERE order_id IN (SELECT order_id FROM order_ids) GROUP BY 1) q
                   ON q.item_id = m.item_id) s
            """,
            ORDER_IDS,
        ),
    ),
    "p04_deduct_stock_rejects": (
        lambda b: stock.deduct_stock(b.tables, order_id_requests(b)).rejects,
        over_model(
            """
            SELECT order_id, 'order_without_lines' AS reason FROM order_ids
            WHERE order_id NOT IN (SELECT order_id FROM m_lines)
            """,
            ORDER_IDS,
        ),
    ),
    "p05_delete_orders_menu": (
        lambda b: ordering.delete_orders(b.tables, order_id_requests(b)).tables.menu_items.select(*_MENU),
        over_model(
            """
            SELECT m.item_id, CAST(m.stock + COALESCE(q.n, 0) AS INTEGER) AS stock,
                   CASE WHEN q.n IS NULL THEN m.is_available ELSE m.stock + q.n > 0 END AS is_available
            FROM m_menu m LEFT JOIN (SELECT item_id, SUM(quantity) AS n FROM m_lines
                                     WHERE order_id IN (SELECT order_id FROM order_ids) GROUP BY 1) q
                 ON q.item_id = m.item_id
            """,
            ORDER_IDS,
        ),
    ),
    "p05_delete_orders_users": (
        lambda b: ordering.delete_orders(b.tables, order_id_requests(b)).tables.users.select(
            "user_id", "wallet_balance"
        ),
        over_model(
            """
            SELECT u.user_id, CAST(u.wallet_balance + COALESCE(r.n, 0) AS DECIMAL(10,2)) AS wallet_balance
            FROM m_users u LEFT JOIN (SELECT user_id, SUM(total_amount) AS n FROM m_orders
                                      WHERE order_id IN (SELECT order_id FROM order_ids)
                                        AND payment_status = 'completed' AND payment_method = 'wallet' GROUP BY 1) r
                 ON r.user_id = u.user_id
            """,
            ORDER_IDS,
        ),
    ),
    "p05_delete_orders_orders": (
        lambda b: ordering.delete_orders(b.tables, order_id_requests(b)).tables.orders,
        over_model("SELECT * FROM m_orders WHERE order_id NOT IN (SELECT order_id FROM order_ids)", ORDER_IDS),
    ),
    "p05_delete_orders_lines": (
        lambda b: ordering.delete_orders(b.tables, order_id_requests(b)).tables.order_items,
        over_model("SELECT * FROM m_lines WHERE order_id NOT IN (SELECT order_id FROM order_ids)", ORDER_IDS),
    ),
    "p05_delete_orders_rejects": (
        lambda b: ordering.delete_orders(b.tables, order_id_requests(b)).rejects,
        over_model(
            """
            SELECT order_id, 'order_not_found' AS reason FROM order_ids
            WHERE order_id NOT IN (SELECT order_id FROM m_orders)
            """,
            ORDER_IDS,
        ),
    ),
    "p05_delete_orders_messages": (
        lambda b: ordering.delete_orders(b.tables, order_id_requests(b)).done,
        over_model(
            """
            SELECT order_id, 'Order ' || order_id || ' deleted successfully' AS message FROM m_orders
            WHERE order_id IN (SELECT order_id FROM order_ids)
            """,
            ORDER_IDS,
        ),
    ),
    "p06_delete_users": (
        lambda b: people.delete_users(b.tables, user_id_requests(b)).tables.users,
        over_model(
            """
            SELECT * FROM m_users
            WHERE NOT (user_id IN (SELECT user_id FROM user_ids) AND user_id NOT IN (SELECT user_id FROM m_orders))
            """,
            USER_IDS,
        ),
    ),
    "p06_delete_users_rejects": (
        lambda b: people.delete_users(b.tables, user_id_requests(b)).rejects,
        over_model(
            """
            SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM m_orders)
                                 THEN 'Cannot delete user with existing orders. Cancel orders first.'
                                 ELSE 'user_not_found' END AS reason
            FROM user_ids
            WHERE user_id IN (SELECT user_id FROM m_orders) OR user_id NOT IN (SELECT user_id FROM m_users)
            """,
            USER_IDS,
        ),
    ),
    "p07_status_orders": (
        lambda b: wallet.apply_status_updates(b.tables, status_requests(b)).tables.orders.select(
            "order_id", "order_status", "payment_status"
        ),
        over_model(
            """
            SELECT o.order_id, COALESCE(s.order_status, o.order_status) AS order_status,
                   COALESCE(s.payment_status, o.payment_status) AS payment_status
            FROM m_orders o LEFT JOIN (
              SELECT order_id, arg_max(order_status, seq) AS order_status, arg_max(payment_status, seq) AS payment_status
              FROM settled WHERE refusal IS NULL GROUP BY order_id) s ON s.order_id = o.order_id
            """,
            *STATUSES,
            recursive=True,
        ),
    ),
    "p07_status_balances": (
        lambda b: wallet.apply_status_updates(b.tables, status_requests(b)).tables.users.select(
            "user_id", "wallet_balance"
        ),
        over_model(
            "SELECT user_id, arg_max(funds, nth) AS wallet_balance FROM walked GROUP BY user_id",
            *STATUSES,
            recursive=True,
        ),
    ),
    "p07_status_rejects": (
        lambda b: wallet.apply_status_updates(b.tables, status_requests(b)).rejects.select(
            "seq", "order_id", "order_status", "payment_status", "reason"
        ),
        over_model(
            """
            SELECT seq, order_id, order_status, payment_status, reason FROM judged WHERE reason IS NOT NULL
            UNION ALL
            SELECT seq, order_id, order_status, payment_status, refusal FROM settled WHERE refusal IS NOT NULL
            """,
            *STATUSES,
            recursive=True,
        ),
    ),
    "p08_delete_items": (
        lambda b: stock.delete_menu_items(b.tables, item_id_requests(b)).tables.menu_items.select(
            *_MENU
        ),
        over_model(
            """
            SELECT item_id, CASE WHEN asked THEN 0 ELSE stock END AS stock, is_available AND NOT asked AS is_available
            FROM (SELECT m.*, item_id IN (SELECT item_id FROM item_ids) AS asked,
                         item_id IN (SELECT item_id FROM m_lines) AS sold FROM m_menu m) s
            WHERE NOT asked OR sold
            """,
            ITEM_IDS,
        ),
    ),
    "p08_delete_items_actions": (
        lambda b: stock.delete_menu_items(b.tables, item_id_requests(b)).done,
        over_model(
            """
            SELECT item_id, CASE WHEN sold THEN 'soft' ELSE 'hard' END AS action,
                   CASE WHEN sold THEN 'Menu item ' || item_id || ' marked as unavailable (has order history)'
                        ELSE 'Menu item ' || item_id || ' deleted successfully' END AS message
            FROM (SELECT item_id, item_id IN (SELECT item_id FROM m_lines) AS sold FROM m_menu
                  WHERE item_id IN (SELECT item_id FROM item_ids)) s
            """,
            ITEM_IDS,
        ),
    ),
    "p08_delete_items_rejects": (
        lambda b: stock.delete_menu_items(b.tables, item_id_requests(b)).rejects,
        over_model(
            """
            SELECT item_id, 'item_not_found' AS reason FROM item_ids
            WHERE item_id NOT IN (SELECT item_id FROM m_menu)
            """,
            ITEM_IDS,
        ),
    ),
    "p09_derive_subtotal": (
        lambda b: ordering.derive_subtotal(b.tables.order_items),
        over_model(
            "SELECT * REPLACE (CAST(unit_price * quantity AS DECIMAL(10,2)) AS subtotal) FROM m_lines"
        ),
    ),
    "p10_enforce_availability": (
        lambda b: stock.enforce_availability(b.tables.menu_items.withColumn("stock", F.col("stock") - 3)).select(
            *_MENU
        ),
        over_model(
            "SELECT item_id, stock - 3 AS stock, is_available AND stock - 3 > 0 AS is_available FROM m_menu"
        ),
    ),
    "p11_set_stock": (
        lambda b: stock.set_stock(b.tables, stock_requests(b)).tables.menu_items.select(*_MENU),
        over_model(
            """
            SELECT item_id, stock, is_available AND (stock > 0 OR NOT moved) AS is_available FROM (
              SELECT m.item_id, m.is_available, j.item_id IS NOT NULL AS moved,
                     CASE j.mode WHEN 'add' THEN m.stock + j.quantity WHEN 'set' THEN j.quantity
                                 WHEN 'reduce' THEN m.stock - j.quantity ELSE m.stock END AS stock
              FROM m_menu m LEFT JOIN (SELECT * FROM judged WHERE reason IS NULL) j ON j.item_id = m.item_id) s
            """,
            *STOCKED,
        ),
    ),
    "p11_set_stock_rejects": (
        lambda b: stock.set_stock(b.tables, stock_requests(b)).rejects,
        over_model("SELECT item_id, mode, quantity, reason FROM judged WHERE reason IS NOT NULL", *STOCKED),
    ),
    "p12_restore_items": (
        lambda b: stock.restore_items(b.tables, restore_requests(b)).tables.menu_items.select(*_MENU),
        over_model(
            """
            SELECT item_id, stock, is_available OR (stock > 0 AND item_id IN (SELECT item_id FROM wanted))
                   AS is_available
            FROM m_menu
            """,
            RESTORED,
        ),
    ),
    "p12_restore_items_rejects": (
        lambda b: stock.restore_items(b.tables, restore_requests(b)).rejects,
        over_model(
            """
            SELECT w.item_id, CASE WHEN m.item_id IS NULL THEN 'item_not_found' ELSE 'out_of_stock' END AS reason
            FROM wanted w LEFT JOIN m_menu m ON m.item_id = w.item_id WHERE m.item_id IS NULL OR m.stock <= 0
            """,
            RESTORED,
        ),
    ),
    "p13_purge_cancelled_orders": (
        lambda b: ordering.purge_cancelled(b.tables).tables.orders,
        over_model("SELECT * FROM m_orders WHERE order_status <> 'cancelled'"),
    ),
    "p13_purge_cancelled_lines": (
        lambda b: ordering.purge_cancelled(b.tables).tables.order_items,
        over_model(
            """
            SELECT * FROM m_lines
            WHERE order_id NOT IN (SELECT order_id FROM m_orders WHERE order_status = 'cancelled')
            """
        ),
    ),
    "p14_insert_users": (
        lambda b: people.insert_users(b.tables, user_requests(b)).tables.users.select(
            "user_id", "srn", "name", "email", "phone", "user_type", "wallet_balance"
        ),
        over_model(
            """
            SELECT user_id, srn, name, email, phone, user_type, wallet_balance FROM m_users
            UNION ALL
            SELECT (SELECT MAX(user_id) FROM m_users) + row_number() OVER (ORDER BY q.request_id),
                   q.srn, q.name, q.email, q.phone, q.user_type, q.wallet_balance
            FROM queue q JOIN walk w ON w.request_id = q.request_id WHERE w.late IS NULL
            """,
            *NEW_USERS,
            recursive=True,
        ),
    ),
    "p14_insert_users_rejects": (
        lambda b: people.insert_users(b.tables, user_requests(b)).rejects.select("request_id", "reason"),
        over_model(
            """
            SELECT request_id, reason FROM judged WHERE reason IS NOT NULL
            UNION ALL SELECT request_id, late FROM walk WHERE late IS NOT NULL
            """,
            *NEW_USERS,
            recursive=True,
        ),
    ),
    "p14_insert_items": (
        lambda b: stock.insert_menu_items(b.tables, item_requests(b)).tables.menu_items.select(
            "item_id", "category_id", "item_name", "price", "stock", "is_available", "preparation_time_minutes"
        ),
        over_model(
            """
            SELECT item_id, category_id, item_name, price, stock, is_available, preparation_time_minutes FROM m_menu
            UNION ALL
            SELECT (SELECT MAX(item_id) FROM m_menu) + row_number() OVER (ORDER BY request_id),
                   category_id, item_name, CAST(price AS DECIMAL(8,2)), stock, TRUE, preparation_time_minutes
            FROM judged WHERE reason IS NULL
            """,
            *NEW_ITEMS,
        ),
    ),
    "p14_insert_items_rejects": (
        lambda b: stock.insert_menu_items(b.tables, item_requests(b)).rejects.select("request_id", "reason"),
        over_model("SELECT request_id, reason FROM judged WHERE reason IS NOT NULL", *NEW_ITEMS),
    ),
    "d1_integrity_report": (
        lambda b: quality.integrity_report(b.tables),
        over_model(_lost_rows("m_orders")),
    ),
    "d1_orphan_rows": (
        lambda b: quality.violations(broken_books(b), ("reference",)),
        _broken_rows("reference"),
    ),
    "d3_check_rows": (
        lambda b: quality.violations(broken_books(b), ("check",)),
        _broken_rows("check"),
    ),
    "d4_enum_rows": (
        lambda b: quality.violations(broken_books(b), ("enum",)),
        _broken_rows("enum"),
    ),
    "d5_null_rows": (
        lambda b: quality.violations(broken_books(b), ("not_null",)),
        _broken_rows("not_null"),
    ),
    "d0_audit_rows": (
        lambda b: quality.audit(broken_books(b)).details,
        _broken_rows(*quality.KINDS),
    ),
    "d0_audit_counts": (
        lambda b: quality.audit(broken_books(b)).counts,
        _broken_counts(*quality.KINDS),
    ),
    "d0_rule_counts": (
        lambda b: quality.rule_counts(broken_books(b)),
        _broken_counts(*quality.KINDS),
    ),
    "d2_uniqueness_report": (
        lambda b: quality.uniqueness_report(b.tables),
        over_model(
            " UNION ALL ".join(
                f"SELECT '{label}' AS rule, COUNT(*) AS repeated_values, "
                f"CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS violations "
                f"FROM (SELECT COUNT(*) AS n FROM {table} GROUP BY {keys} HAVING COUNT(*) > 1) d"
                for label, table, keys in (
                    ("users(user_id)", "m_users", "user_id"),
                    ("users(srn)", "m_users", "lower(srn)"),
                    ("users(email)", "m_users", "lower(email)"),
                    ("categories(category_id)", "m_categories", "category_id"),
                    ("categories(category_name)", "m_categories", "lower(category_name)"),
                    ("menu_items(item_id)", "m_menu", "item_id"),
                    ("orders(order_id)", "m_orders", "order_id"),
                    ("order_items(order_item_id)", "m_lines", "order_item_id"),
                    ("order_items(order_id, item_id)", "m_lines", "order_id, item_id"),
                )
            )
        ),
    ),
    "d2_repeated_order_items": (
        lambda b: quality.repeated_keys(b.tables, "order_items", ("order_id", "item_id")),
        over_model("SELECT order_id, item_id, COUNT(*) AS n FROM m_lines GROUP BY 1, 2 HAVING COUNT(*) > 1"),
    ),
    "d3_check_report": (
        lambda b: quality.check_report(b.tables),
        over_model(
            r"""
            SELECT 'wallet_balance_not_negative' AS rule, COUNT(*) AS violations FROM m_users WHERE wallet_balance < 0
            UNION ALL SELECT 'email_format', COUNT(*) FROM m_users
            WHERE NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$')
            UNION ALL SELECT 'phone_format', COUNT(*) FROM m_users WHERE NOT regexp_matches(phone, '^[0-9]{10}$')
            UNION ALL SELECT 'price_positive', COUNT(*) FROM m_menu WHERE price <= 0
            UNION ALL SELECT 'preparation_time_positive', COUNT(*) FROM m_menu WHERE preparation_time_minutes <= 0
            UNION ALL SELECT 'total_amount_positive', COUNT(*) FROM m_orders WHERE total_amount <= 0
            UNION ALL SELECT 'quantity_positive', COUNT(*) FROM m_lines WHERE quantity <= 0
            UNION ALL SELECT 'unit_price_positive', COUNT(*) FROM m_lines WHERE unit_price <= 0
            """
        ),
    ),
    "d3_check_violations_users": (
        lambda b: quality.check_violations(b.tables, "users").select(
            "user_id", F.array_join("broken_rules", ",").alias("broken_rules")
        ),
        over_model(
            r"""
            SELECT user_id, concat_ws(',', CASE WHEN a THEN 'wallet_balance_not_negative' END,
                                      CASE WHEN e THEN 'email_format' END, CASE WHEN p THEN 'phone_format' END)
                   AS broken_rules
            FROM (SELECT user_id, wallet_balance < 0 AS a,
                         NOT regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') AS e,
                         COALESCE(NOT regexp_matches(phone, '^[0-9]{10}$'), FALSE) AS p FROM m_users) c
            WHERE a OR e OR p
            """
        ),
    ),
    "d4_enum_report": (
        lambda b: quality.enum_report(
            b.tables.with_(
                orders=b.tables.orders.withColumn(
                    "payment_method",
                    F.when(F.col("order_status") == "ready", F.lit("cheque")).otherwise(F.col("payment_method")),
                )
            )
        ),
        over_model(
            """
            SELECT 'users.user_type' AS rule, COUNT(*) AS violations FROM m_users
            WHERE user_type NOT IN ('student', 'faculty', 'staff')
            UNION ALL SELECT 'orders.order_status', COUNT(*) FROM m_orders
            WHERE order_status NOT IN ('pending', 'confirmed', 'preparing', 'ready', 'completed', 'cancelled')
            UNION ALL SELECT 'orders.payment_method', COUNT(*) FROM m_orders WHERE order_status = 'ready'
            UNION ALL SELECT 'orders.payment_status', COUNT(*) FROM m_orders
            WHERE payment_status NOT IN ('pending', 'completed', 'failed', 'refunded')
            """
        ),
    ),
    "d5_not_null_report": (
        lambda b: quality.not_null_report(
            b.tables.with_(
                users=b.tables.users.withColumn(
                    "name", F.when(F.col("user_type") != "staff", F.col("name"))
                )
            )
        ),
        over_model(
            " UNION ALL ".join(
                f"SELECT '{label}.{column}' AS rule, COUNT(*) FILTER (WHERE {column} IS NULL) AS violations FROM {table}"
                for label, table, columns in (
                    ("users", "(SELECT * REPLACE (CASE WHEN user_type <> 'staff' THEN name END AS name) FROM m_users) u",
                     ("user_id", "srn", "name", "email", "user_type")),
                    ("categories", "m_categories", ("category_id", "category_name")),
                    ("menu_items", "m_menu", ("item_id", "category_id", "item_name", "price")),
                    ("orders", "m_orders", ("order_id", "user_id", "total_amount", "payment_method")),
                    ("order_items", "m_lines",
                     ("order_item_id", "order_id", "item_id", "quantity", "unit_price", "subtotal")),
                )
                for column in columns
            )
        ),
    ),
    "d6_reconcile_order_totals": (
        lambda b: quality.reconcile_order_totals(b.tables, only_drift=False),
        over_model(
            """
            SELECT o.order_id, o.total_amount, CAST(COALESCE(s.n, 0) AS DECIMAL(20,2)) AS line_total,
                   CAST(o.total_amount - COALESCE(s.n, 0) AS DECIMAL(20,2)) AS difference
            FROM m_orders o LEFT JOIN (SELECT order_id, SUM(subtotal) AS n FROM m_lines GROUP BY 1) s
                 ON s.order_id = o.order_id
            """
        ),
    ),
    "d7_subtotal_drift": (
        lambda b: quality.subtotal_drift(b.tables),
        over_model(
            """
            SELECT order_item_id, order_id, item_id, quantity, unit_price, subtotal,
                   CAST(unit_price * quantity AS DECIMAL(10,2)) AS expected
            FROM m_lines WHERE subtotal <> CAST(unit_price * quantity AS DECIMAL(10,2))
            """
        ),
    ),
}

JOB_SQL = {name: text for name, (_, text) in JOBS.items()}


def on_books(job: Job) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: job(Books(spark, folder, retail_tables(spark, folder)))
