"""Reports that promise an order come in that order: rows are compared as collected, not sorted first."""

import pytest

from checks.reports import REPORTS
from platter.sources.retail import retail_tables


@pytest.fixture(scope="module")
def retail(spark):
    return retail_tables(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def dates(retail):
    return {r[0]: r[1] for r in retail.orders.select("order_id", "order_date").collect()}


# Report -> columns; "-" in front for the largest first, "date" for the day of the order, which the report leaves out.
ORDERS = {
    "q03_recent_orders": "-order_date order_id",
    "q04_popular_items": "-total_quantity_sold item_id",
    "q05_user_search_all": "-created_at user_id",
    "q06_user_directory": "name user_id",
    "q07_wallet_transactions": "-order_date order_id",
    "q09_menu_listing": "category_name item_name item_id",
    "q10_top_items_by_sales": "-total_sales item_id",
    "q11_low_stock": "stock item_id",
    "q13_stock_list": "category_name item_name item_id",
    "q15_order_search_all": "-order_date order_id",
    "q16_orderable_items": "category_name item_name item_id",
    "q17_open_orders": "-date order_id",
    "q18_unfinished_orders": "-date order_id",
    "q19_all_orders": "-order_date order_id",
    "q23_sales_by_category": "-total_revenue",
    "q24_daily_revenue": "order_day",
    "q26_revenue_by_payment_method": "-total_revenue",
    "q27_top_customers": "-total_spent",
    "q29_status_distribution": "-n order_status",
    "q30_payment_breakdown": "-total_amount",
    "q33_above_average_spenders": "-total_spent",
    "q34_line_detail": "-date",
    "q35_category_statistics": "-total_revenue",
    "q36_most_active_customers": "-order_count",
    "q39_menu_with_history": "category_name item_name item_id",
    "q40_users_with_history": "name user_id",
    "q42_cancelled_orders": "-updated_at order_id",
    "q43_unavailable_items": "-updated_at item_id",
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_rows_come_in_order(retail, dates, name):
    rows = [r.asDict() for r in REPORTS[name][0](retail).collect()]
    assert len(rows) > 1
    for row in rows:
        if "order_id" in row:
            row["date"] = dates[row["order_id"]]
    want = rows
    for column in reversed(ORDERS[name].split()):
        want = sorted(want, key=lambda r: r[column.lstrip("-")], reverse=column[0] == "-")
    assert rows == want
