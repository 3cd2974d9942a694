"""Reports over whole tables: name -> (DataFrame plan, SQL twin)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.binding import over_model
from platter.functions import lookups
from platter.functions.expressions import money_text, yes_no
from platter.plans import customers, menu, orders, overview, revenue, sketches
from platter.plans.views import order_summary, paid, popular_items
from platter.schema import Tables

AS_OF = date(1998, 6, 15)

Plan = Callable[[Tables], DataFrame]

_ROW = "order_id, customer_name, srn, order_date, total_amount, order_status, payment_method, payment_status"
_SPENT = """
SELECT u.user_id, u.name, u.srn, u.user_type, COUNT(*) AS order_count,
       CAST(SUM(o.total_amount) AS DECIMAL(20,2)) AS total_spent,
       CAST(SUM(o.total_amount) AS DOUBLE) / COUNT(*) AS avg_order_value
FROM m_users u JOIN m_orders o ON u.user_id = o.user_id
WHERE o.payment_status = 'completed'
GROUP BY u.user_id, u.name, u.srn, u.user_type
"""
_DAILY = """
SELECT CAST(order_date AS DATE) AS order_day, COUNT(*) AS order_count,
       CAST(SUM(total_amount) AS DECIMAL(20,2)) AS daily_revenue,
       CAST(SUM(total_amount) AS DOUBLE) / COUNT(*) AS avg_order_value
FROM m_orders WHERE payment_status = 'completed' GROUP BY 1 ORDER BY order_day DESC
"""


def _large_orders(t: Tables) -> DataFrame:
    """Order ids to look up: the large paid orders."""
    return t.orders.where((F.col("total_amount") >= 400000) & (F.col("payment_status") == "completed")).select(
        "order_id"
    )


_LARGE = "SELECT order_id FROM m_orders WHERE total_amount >= 400000 AND payment_status = 'completed'"


def _close(estimate: str, exact: str) -> Column:
    """Whether an estimate keeps the bound that its sketch states."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.lit(sketches.error_bound()) * F.col(exact)


def _sketched_sales(t: Tables) -> DataFrame:
    """Daily sketches merged over all days, beside the exact order counts."""
    merged = sketches.category_sales_sketched(t, sketches.daily_orders(t)).withColumnRenamed("order_count", "estimate")
    exact = menu.sales_by_category(t).select("category_name", "order_count")
    return merged.join(exact, "category_name").select(
        "category_name", "order_count", "total_quantity", "total_revenue", _close("estimate", "order_count").alias("within_bound")
    )


def _sketched_buyers(t: Tables) -> DataFrame:
    """The same for the users who paid, by type."""
    merged = sketches.over_days(sketches.daily_buyers(t), "user_type", sums=("orders", "spent"))
    buying = paid(t.orders).join(t.users.select("user_id", "user_type"), "user_id")
    exact = buying.groupBy("user_type").agg(F.countDistinct("user_id").alias("buyers"))
    return merged.join(exact, "user_type").select("user_type", "buyers", "orders", "spent", _close("distinct", "buyers").alias("within_bound"))


REPORTS: dict[str, tuple[Plan, str]] = {
    "q01_table_counts": (
        overview.table_counts,
        """
        SELECT 'Users' AS table_name, COUNT(*) AS record_count FROM m_users
        UNION ALL SELECT 'Categories', COUNT(*) FROM m_categories
        UNION ALL SELECT 'Menu_Items', COUNT(*) FROM m_menu
        UNION ALL SELECT 'Orders', COUNT(*) FROM m_orders
        UNION ALL SELECT 'Order_Items', COUNT(*) FROM m_lines
        """,
    ),
    "q01_table_counts_short": (
        lambda t: overview.table_counts(t, ("users", "orders", "menu_items")),
        """
        SELECT 'Users' AS table_name, COUNT(*) AS record_count FROM m_users
        UNION ALL SELECT 'Orders', COUNT(*) FROM m_orders
        UNION ALL SELECT 'Menu_Items', COUNT(*) FROM m_menu
        """,
    ),
    "q02_day_overview": (
        lambda t: overview.day_overview(t, AS_OF),
        """
        SELECT (SELECT CAST(COALESCE(SUM(total_amount), 0) AS DECIMAL(20,2)) FROM m_orders
                WHERE CAST(order_date AS DATE) = DATE '1998-06-15' AND payment_status = 'completed') AS revenue,
               (SELECT COUNT(*) FROM m_orders WHERE CAST(order_date AS DATE) = DATE '1998-06-15') AS today_orders,
               (SELECT COUNT(*) FROM m_orders
                WHERE order_status IN ('pending', 'confirmed', 'preparing')) AS pending_orders,
               (SELECT COUNT(*) FROM m_menu WHERE is_available) AS available_items
        """,
    ),
    "q02_day_sales": (
        lambda t: overview.day_sales(t, AS_OF),
        """
        SELECT COUNT(*) AS today_orders,
               CAST(COALESCE(SUM(CASE WHEN payment_status = 'completed' THEN total_amount END), 0)
                    AS DECIMAL(20,2)) AS today_revenue
        FROM m_orders WHERE CAST(order_date AS DATE) = DATE '1998-06-15'
        """,
    ),
    "q03_recent_orders": (
        overview.recent_orders,
        """
        SELECT order_id, customer_name, total_amount, order_status, order_date FROM m_summary
        ORDER BY order_date DESC, order_id LIMIT 5
        """,
    ),
    "q04_popular_items": (
        menu.best_sellers,
        """
        SELECT *, CAST(price * total_quantity_sold AS DECIMAL(20,2)) AS revenue FROM m_popular
        ORDER BY total_quantity_sold DESC, item_id LIMIT 10
        """,
    ),
    "q04_popular_items_top5": (
        lambda t: menu.best_sellers(t, 5),
        """
        SELECT *, CAST(price * total_quantity_sold AS DECIMAL(20,2)) AS revenue FROM m_popular
        ORDER BY total_quantity_sold DESC, item_id LIMIT 5
        """,
    ),
    "q05_user_search": (
        lambda t: customers.user_search(t, term="mer#0000000", user_type="student"),
        """
        SELECT * FROM m_users
        WHERE (contains(lower(name), 'mer#0000000') OR contains(lower(srn), 'mer#0000000'))
          AND user_type = 'student'
        """,
    ),
    "q05_user_search_all": (customers.user_search, "SELECT * FROM m_users"),
    "q06_user_directory": (
        customers.user_directory,
        "SELECT user_id, name, srn, wallet_balance FROM m_users",
    ),
    "q07_wallet_transactions": (
        customers.wallet_transactions,
        """
        SELECT u.name, u.srn, o.order_id, o.total_amount, o.payment_status, o.order_date
        FROM m_orders o JOIN m_users u ON o.user_id = u.user_id
        WHERE o.payment_method = 'wallet' ORDER BY o.order_date DESC, o.order_id LIMIT 10
        """,
    ),
    "q08_active_categories": (
        menu.active_categories,
        "SELECT category_id, category_name FROM m_categories WHERE is_active",
    ),
    "q09_menu_listing": (
        menu.menu_listing,
        """
        SELECT m.item_id, m.item_name, c.category_name, m.description, m.price, m.stock, m.is_available,
               m.preparation_time_minutes, m.created_at,
               CASE WHEN m.stock <= 0 THEN 'Out of Stock'
                    WHEN m.stock <= 5 THEN 'Low (' || m.stock || ')'
                    ELSE 'Good (' || m.stock || ')' END AS stock_status
        FROM m_menu m JOIN m_categories c ON m.category_id = c.category_id
        """,
    ),
    "q09_menu_search": (
        lambda t: menu.menu_listing(t, term="WIDGET", category="PROMO", available=True),
        """
        SELECT m.item_id, m.item_name, c.category_name, m.description, m.price, m.stock, m.is_available,
               m.preparation_time_minutes, m.created_at,
               CASE WHEN m.stock <= 0 THEN 'Out of Stock'
                    WHEN m.stock <= 5 THEN 'Low (' || m.stock || ')'
                    ELSE 'Good (' || m.stock || ')' END AS stock_status
        FROM m_menu m JOIN m_categories c ON m.category_id = c.category_id
        WHERE contains(lower(m.item_name), 'widget') AND c.category_name = 'PROMO' AND m.is_available
        """,
    ),
    "q10_top_items_by_sales": (
        menu.top_items_by_sales,
        """
        SELECT m.item_id, m.item_name, CAST(SUM(l.subtotal) AS DECIMAL(20,2)) AS total_sales
        FROM m_lines l JOIN m_menu m ON l.item_id = m.item_id
        GROUP BY m.item_id, m.item_name ORDER BY total_sales DESC, m.item_id LIMIT 5
        """,
    ),
    "q11_low_stock": (
        menu.low_stock,
        """
        SELECT item_id, item_name, stock, is_available FROM m_menu WHERE stock <= 5 AND stock > 0
        ORDER BY stock, item_id LIMIT 5
        """,
    ),
    "q11_low_stock_with_empty": (
        lambda t: menu.low_stock(t, include_zero=True),
        """
        SELECT item_id, item_name, stock, is_available FROM m_menu WHERE stock <= 5
        ORDER BY stock, item_id LIMIT 5
        """,
    ),
    "q12_out_of_stock": (
        menu.out_of_stock,
        """
        SELECT m.item_id, m.item_name, c.category_name
        FROM m_menu m JOIN m_categories c ON m.category_id = c.category_id
        WHERE m.stock = 0 ORDER BY m.item_id LIMIT 5
        """,
    ),
    "q13_stock_list": (
        menu.stock_list,
        """
        SELECT m.item_id, m.item_name, c.category_name, m.stock, m.is_available
        FROM m_menu m JOIN m_categories c ON m.category_id = c.category_id
        """,
    ),
    "q14_menu_stats": (
        overview.menu_stats,
        """
        SELECT (SELECT COUNT(*) FROM m_menu) AS total_items,
               (SELECT COUNT(*) FROM m_menu WHERE is_available) AS available_items,
               (SELECT COUNT(*) FROM m_menu WHERE NOT is_available) AS unavailable_items,
               (SELECT COUNT(*) FROM m_menu WHERE stock > 0 AND stock <= 5) AS low_stock_items,
               (SELECT COUNT(*) FROM m_menu WHERE stock = 0) AS out_of_stock_items
        """,
    ),
    "q15_order_search": (
        lambda t: orders.order_search(t, term="srn11", order_status="confirmed", payment_status="completed"),
        f"""
        SELECT {_ROW}, upper(order_status) AS status_display FROM m_summary
        WHERE (contains(lower(customer_name), 'srn11') OR contains(lower(srn), 'srn11'))
          AND order_status = 'confirmed' AND payment_status = 'completed'
        """,
    ),
    "q15_order_search_all": (
        orders.order_search,
        f"SELECT {_ROW}, upper(order_status) AS status_display FROM m_summary",
    ),
    "q16_orderable_items": (
        menu.orderable_items,
        """
        SELECT m.item_id, m.item_name, c.category_name, m.price, m.stock, m.is_available
        FROM m_menu m JOIN m_categories c ON m.category_id = c.category_id
        WHERE m.is_available AND m.stock > 0
        """,
    ),
    "q17_open_orders": (
        orders.open_orders,
        """
        SELECT o.order_id, u.name, o.order_status, o.total_amount
        FROM m_orders o JOIN m_users u ON o.user_id = u.user_id
        WHERE o.order_status IN ('pending', 'confirmed')
        """,
    ),
    "q18_unfinished_orders": (
        orders.unfinished_orders,
        """
        SELECT o.order_id, u.name, o.order_status, o.payment_status
        FROM m_orders o JOIN m_users u ON o.user_id = u.user_id
        WHERE o.order_status <> 'completed' AND o.order_status <> 'cancelled'
        """,
    ),
    "q19_all_orders": (orders.all_orders, f"SELECT {_ROW} FROM m_summary"),
    "q20_order_headers": (
        lambda t: orders.order_headers(t, _large_orders(t)),
        f"SELECT {_ROW} FROM m_summary WHERE order_id IN ({_LARGE})",
    ),
    "q21_order_lines": (
        lambda t: orders.order_lines(t, _large_orders(t)),
        f"""
        SELECT l.order_id, l.order_item_id, m.item_name, c.category_name, l.quantity, l.unit_price, l.subtotal,
               l.special_requests
        FROM m_lines l JOIN m_menu m ON l.item_id = m.item_id JOIN m_categories c ON m.category_id = c.category_id
        WHERE l.order_id IN ({_LARGE})
        """,
    ),
    "q22_kpis": (
        overview.kpis,
        """
        SELECT (SELECT CAST(COALESCE(SUM(total_amount), 0) AS DECIMAL(20,2)) FROM m_orders
                WHERE payment_status = 'completed') AS revenue,
               (SELECT COUNT(*) FROM m_orders) AS orders,
               (SELECT COUNT(*) FROM m_orders WHERE order_status = 'completed') AS completed_orders,
               (SELECT COALESCE(CAST(SUM(total_amount) AS DOUBLE) / COUNT(*), 0) FROM m_orders
                WHERE payment_status = 'completed') AS avg_order_value,
               (SELECT COUNT(*) FROM m_users) AS users
        """,
    ),
    "q22_paid_revenue": (
        overview.recent_paid_revenue,
        """
        SELECT CAST(COALESCE(SUM(total_amount), 0) AS DECIMAL(20,2)) AS revenue FROM m_orders
        WHERE payment_status = 'completed'
        """,
    ),
    "q23_sales_by_category": (
        menu.sales_by_category,
        """
        SELECT c.category_name, COUNT(DISTINCT l.order_id) AS order_count,
               CAST(SUM(l.quantity) AS BIGINT) AS total_quantity,
               CAST(SUM(l.subtotal) AS DECIMAL(20,2)) AS total_revenue
        FROM m_lines l JOIN m_menu m ON l.item_id = m.item_id JOIN m_categories c ON m.category_id = c.category_id
        GROUP BY c.category_id, c.category_name
        """,
    ),
    "q24_daily_revenue": (
        revenue.daily_revenue,
        f"SELECT * FROM ({_DAILY} LIMIT 30) days",
    ),
    "q24_daily_revenue_week": (
        lambda t: revenue.daily_revenue(t, 7),
        f"SELECT * FROM ({_DAILY} LIMIT 7) days",
    ),
    "q25_period_summary": (
        revenue.period_summary,
        f"""
        SELECT CAST(SUM(daily_revenue) AS DECIMAL(20,2)) AS total_revenue,
               CAST(SUM(daily_revenue) AS DOUBLE) / COUNT(*) AS average_daily_revenue,
               MAX(daily_revenue) AS highest_daily_revenue, MIN(daily_revenue) AS lowest_daily_revenue
        FROM ({_DAILY} LIMIT 30) days
        """,
    ),
    "q26_revenue_by_payment_method": (
        revenue.revenue_by_payment_method,
        """
        SELECT payment_method, COUNT(*) AS order_count, CAST(SUM(total_amount) AS DECIMAL(20,2)) AS total_revenue
        FROM m_orders WHERE payment_status = 'completed' GROUP BY payment_method
        """,
    ),
    "q27_top_customers": (
        customers.top_customers,
        f"""
        SELECT name, srn, user_type, order_count, total_spent FROM ({_SPENT}) s
        ORDER BY total_spent DESC, user_id LIMIT 10
        """,
    ),
    "q28_user_type_stats": (
        customers.user_type_stats,
        """
        SELECT u.user_type, COUNT(DISTINCT u.user_id) AS user_count, COUNT(o.order_id) AS order_count,
               CAST(COALESCE(SUM(o.total_amount), 0) AS DECIMAL(20,2)) AS total_spent
        FROM m_users u LEFT JOIN m_orders o ON u.user_id = o.user_id AND o.payment_status = 'completed'
        GROUP BY u.user_type
        """,
    ),
    "q29_status_distribution": (
        orders.status_distribution,
        "SELECT order_status, COUNT(*) AS n FROM m_orders GROUP BY order_status",
    ),
    "q30_payment_breakdown": (
        orders.payment_breakdown,
        """
        SELECT payment_status, payment_method, COUNT(*) AS n,
               CAST(SUM(total_amount) AS DECIMAL(20,2)) AS total_amount
        FROM m_orders GROUP BY payment_status, payment_method
        """,
    ),
    "q30_payment_hierarchy": (
        orders.payment_hierarchy,
        """
        SELECT payment_status, payment_method, COUNT(*) AS n,
               CAST(SUM(total_amount) AS DECIMAL(20,2)) AS total_amount
        FROM m_orders GROUP BY ROLLUP (payment_status, payment_method)
        """,
    ),
    "q31_hourly_pattern": (
        orders.hourly_pattern,
        "SELECT CAST(hour(order_date) AS INTEGER) AS hour, COUNT(*) AS order_count FROM m_orders GROUP BY 1",
    ),
    "q32_pending_wallet_orders": (
        orders.pending_wallet_orders,
        """
        SELECT o.order_id, u.name, o.total_amount, u.wallet_balance
        FROM m_orders o JOIN m_users u ON o.user_id = u.user_id
        WHERE o.payment_method = 'wallet' AND o.payment_status = 'pending' ORDER BY o.order_id LIMIT 5
        """,
    ),
    "q33_above_average_spenders": (
        customers.above_average_spenders,
        f"""
        SELECT name, srn, total_spent FROM ({_SPENT}) s
        WHERE total_spent > (SELECT AVG(total_amount) FROM m_orders WHERE payment_status = 'completed')
        """,
    ),
    "q34_line_detail": (
        orders.line_detail,
        """
        SELECT o.order_id, u.name AS customer_name, u.srn, m.item_name, c.category_name, l.quantity, l.unit_price,
               l.subtotal, o.order_status
        FROM m_orders o JOIN m_users u ON o.user_id = u.user_id JOIN m_lines l ON o.order_id = l.order_id
             JOIN m_menu m ON l.item_id = m.item_id JOIN m_categories c ON m.category_id = c.category_id
        ORDER BY o.order_date DESC, o.order_id, l.order_item_id, l.item_id, l.quantity, l.subtotal LIMIT 10
        """,
    ),
    "q35_category_statistics": (
        menu.category_statistics,
        """
        SELECT s.*, p.mean_list_price FROM (
          SELECT c.category_name, COUNT(DISTINCT m.item_id) AS item_count, COUNT(DISTINCT l.order_id) AS order_count,
                 CAST(SUM(l.quantity) AS BIGINT) AS total_quantity_sold,
                 CAST(SUM(l.subtotal) AS DECIMAL(20,2)) AS total_revenue,
                 CAST(SUM(m.price) AS DOUBLE) / COUNT(m.price) AS avg_item_price,
                 MIN(m.price) AS min_price, MAX(m.price) AS max_price
          FROM m_categories c JOIN m_menu m ON c.category_id = m.category_id
               LEFT JOIN m_lines l ON m.item_id = l.item_id
          GROUP BY c.category_id, c.category_name) s
        JOIN (SELECT c.category_name, CAST(SUM(m.price) AS DOUBLE) / COUNT(m.price) AS mean_list_price
              FROM m_categories c JOIN m_menu m ON c.category_id = m.category_id GROUP BY 1) p
          ON s.category_name = p.category_name
        """,
    ),
    "q36_most_active_customers": (
        customers.most_active_customers,
        f"""
        SELECT name, user_type, order_count, total_spent, avg_order_value FROM ({_SPENT}) s
        ORDER BY order_count DESC, user_id LIMIT 5
        """,
    ),
    "q37_items_never_ordered": (
        menu.never_ordered,
        """
        SELECT m.item_id, m.item_name, c.category_name, m.price, m.stock
        FROM m_menu m JOIN m_categories c ON m.category_id = c.category_id
             LEFT JOIN m_lines l ON m.item_id = l.item_id
        WHERE l.item_id IS NULL
        """,
    ),
    "q38_order_counts": (
        overview.order_counts,
        """
        SELECT (SELECT COUNT(*) FROM m_orders) AS total_orders,
               (SELECT COUNT(*) FROM m_orders WHERE order_status IN ('pending', 'confirmed')) AS pending_orders,
               (SELECT COUNT(*) FROM m_orders WHERE order_status = 'completed') AS completed_orders
        """,
    ),
    "q39_menu_with_history": (
        menu.menu_with_history,
        """
        SELECT m.item_id, m.item_name, c.category_name, m.price, m.stock, m.is_available,
               COALESCE(h.n, 0) AS order_count,
               CASE WHEN COALESCE(h.n, 0) > 0 THEN 'Soft Delete' ELSE 'Hard Delete' END AS delete_type
        FROM m_menu m JOIN m_categories c ON m.category_id = c.category_id
             LEFT JOIN (SELECT item_id, COUNT(*) AS n FROM m_lines GROUP BY item_id) h ON h.item_id = m.item_id
        """,
    ),
    "q40_users_with_history": (
        customers.users_with_history,
        """
        SELECT u.user_id, u.srn, u.name, u.email, u.user_type, u.wallet_balance, COALESCE(h.n, 0) AS order_count,
               CASE WHEN COALESCE(h.n, 0) = 0 THEN 'Yes' ELSE 'No' END AS can_delete
        FROM m_users u LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM m_orders GROUP BY user_id) h
             ON h.user_id = u.user_id
        """,
    ),
    "q41_user_counts": (
        overview.user_counts,
        """
        SELECT (SELECT COUNT(*) FROM m_users) AS total_users,
               (SELECT COUNT(DISTINCT user_id) FROM m_orders) AS users_with_orders,
               (SELECT COUNT(*) FROM m_users) - (SELECT COUNT(DISTINCT user_id) FROM m_orders) AS users_without_orders
        """,
    ),
    "q42_cancelled_orders": (
        orders.cancelled_orders,
        """
        SELECT o.order_id, u.name AS customer_name, o.total_amount, o.order_status, o.updated_at
        FROM m_orders o JOIN m_users u ON o.user_id = u.user_id
        WHERE o.order_status = 'cancelled' ORDER BY o.updated_at DESC, o.order_id LIMIT 10
        """,
    ),
    "q43_unavailable_items": (
        menu.unavailable_items,
        """
        SELECT m.item_id, m.item_name, c.category_name, m.stock, m.updated_at
        FROM m_menu m JOIN m_categories c ON m.category_id = c.category_id
        WHERE NOT m.is_available ORDER BY m.updated_at DESC, m.item_id LIMIT 10
        """,
    ),
    "q44_latest_orders": (
        orders.latest_orders,
        """
        SELECT user_id, order_id, order_date, total_amount, order_status, payment_method, payment_status
        FROM m_orders WHERE order_id IN (SELECT MAX(order_id) FROM m_orders GROUP BY user_id)
        """,
    ),
    "q44_latest_order_lines": (
        orders.latest_order_lines,
        """
        SELECT o.user_id, l.order_id, l.order_item_id, l.item_id, l.quantity, l.unit_price, l.subtotal
        FROM m_lines l JOIN m_orders o ON l.order_id = o.order_id
        WHERE l.order_id IN (SELECT MAX(order_id) FROM m_orders GROUP BY user_id)
        """,
    ),
    "q45_users_sample": (
        lambda t: overview.table_sample(t, "users", 5),
        "SELECT * FROM m_users ORDER BY user_id LIMIT 5",
    ),
    "q45_order_summary_sample": (
        lambda t: overview.table_sample(t, "order_summary", 10),
        f"SELECT {_ROW} FROM m_summary ORDER BY order_id LIMIT 10",
    ),
    "q45_popular_items_sample": (
        lambda t: overview.table_sample(t, "popular_items", 10),
        "SELECT * FROM m_popular ORDER BY item_id LIMIT 10",
    ),
    "q45_menu_sample": (
        lambda t: overview.table_sample(t, "menu", 5),
        """
        SELECT m.item_name, c.category_name, m.price, m.is_available
        FROM m_menu m JOIN m_categories c ON m.category_id = c.category_id ORDER BY m.item_id LIMIT 5
        """,
    ),
    "a5_sketched_category_sales": (
        _sketched_sales,
        """
        SELECT c.category_name, COUNT(DISTINCT l.order_id) AS order_count, CAST(SUM(l.quantity) AS BIGINT) AS total_quantity,
               CAST(SUM(l.subtotal) AS DECIMAL(20,2)) AS total_revenue, TRUE AS within_bound
        FROM m_lines l JOIN m_menu m ON l.item_id = m.item_id JOIN m_categories c ON m.category_id = c.category_id
             JOIN m_orders o ON o.order_id = l.order_id
        GROUP BY c.category_id, c.category_name
        """,
    ),
    "a5_sketched_buyers": (
        _sketched_buyers,
        """
        SELECT u.user_type, COUNT(DISTINCT o.user_id) AS buyers, COUNT(*) AS orders,
               CAST(SUM(o.total_amount) AS DECIMAL(20,2)) AS spent, TRUE AS within_bound
        FROM m_orders o JOIN m_users u ON o.user_id = u.user_id
        WHERE o.payment_status = 'completed' GROUP BY u.user_type
        """,
    ),
    "src3_order_summary": (order_summary, f"SELECT {_ROW} FROM m_summary"),
    "src4_popular_items": (popular_items, "SELECT * FROM m_popular"),
    "fn1_wallet_balances": (
        lambda t: lookups.wallet_balances(t.users, t.orders.select("user_id")),
        """
        SELECT k.user_id, CAST(COALESCE(u.wallet_balance, 0) AS DECIMAL(20,2)) AS wallet_balance
        FROM (SELECT DISTINCT user_id FROM m_orders) k LEFT JOIN m_users u ON u.user_id = k.user_id
        """,
    ),
    "fn2_order_totals": (
        lambda t: lookups.order_totals(t.order_items, t.orders.select("order_id")),
        """
        SELECT o.order_id, CAST(COALESCE(SUM(l.subtotal), 0) AS DECIMAL(20,2)) AS order_total
        FROM m_orders o LEFT JOIN m_lines l ON l.order_id = o.order_id GROUP BY o.order_id
        """,
    ),
    "fn3_item_sales": (
        lambda t: lookups.item_sales(t.order_items, t.menu_items.select("item_id")),
        """
        SELECT m.item_id, CAST(COALESCE(SUM(l.subtotal), 0) AS DECIMAL(20,2)) AS total_sales
        FROM m_menu m LEFT JOIN m_lines l ON l.item_id = m.item_id GROUP BY m.item_id
        """,
    ),
    "x08_popular_items_text": (
        lambda t: menu.best_sellers(t, 10).select(
            "item_id", money_text("price").alias("price_text"), money_text("revenue").alias("revenue_text")
        ),
        """
        SELECT item_id, '₹' || CAST(price AS VARCHAR) AS price_text,
               '₹' || CAST(CAST(price * total_quantity_sold AS DECIMAL(20,2)) AS VARCHAR) AS revenue_text
        FROM m_popular ORDER BY total_quantity_sold DESC, item_id LIMIT 10
        """,
    ),
    "x09_availability_text": (
        lambda t: t.menu_items.select("item_id", yes_no(F.col("is_available")).alias("available")),
        "SELECT item_id, CASE WHEN is_available THEN 'Yes' ELSE 'No' END AS available FROM m_menu",
    ),
    "x11_order_preview": (
        lambda t: menu.order_preview(t.order_items.select("order_id", "item_id", "quantity"), t.menu_items),
        """
        SELECT l.order_id, l.item_id, l.quantity, m.price, CAST(m.price * l.quantity AS DECIMAL(10,2)) AS order_total
        FROM m_lines l JOIN m_menu m ON l.item_id = m.item_id
        """,
    ),
}

REPORT_SQL = {name: over_model(text) for name, (_, text) in REPORTS.items()}
