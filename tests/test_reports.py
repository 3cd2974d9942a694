from datetime import date, datetime

from platter.functions import lookups
from platter.plans import customers, menu, orders, overview, revenue
from platter.plans.views import order_summary, popular_items
from tests.seed import T0, item, line, order, ordered, tables, user, values


def test_kpis(seed):
    row = overview.kpis(seed).first().asDict()
    assert float(row["revenue"]) == 390.0
    assert row["avg_order_value"] == 97.5
    assert (row["orders"], row["completed_orders"], row["users"]) == (5, 1, 7)


def test_kpis_without_orders(spark, seed):
    empty = seed.with_(orders=seed.orders.limit(0))
    row = overview.kpis(empty).first().asDict()
    assert (float(row["revenue"]), row["avg_order_value"], row["orders"]) == (0.0, 0.0, 0)


def test_category_sales(seed):
    assert ordered(menu.sales_by_category(seed)) == [
        ("Lunch", 3, 3, 300.0), ("Breakfast", 2, 2, 110.0), ("Beverages", 3, 4, 95.0), ("Snacks", 1, 1, 15.0)]


def test_top_items_and_popular(seed):
    assert ordered(menu.top_items_by_sales(seed), "item_id", "total_sales") == [
        (6, 120.0), (7, 95.0), (5, 85.0), (2, 65.0), (1, 45.0)]
    top = ordered(menu.best_sellers(seed), "item_id", "total_quantity_sold", "revenue")
    assert top[:3] == [(14, 2, 40.0), (1, 1, 45.0), (2, 1, 65.0)]


def test_above_average(seed):
    assert ordered(customers.above_average_spenders(seed), "name", "total_spent") == [("Finn", 150.0), ("Ada", 110.0)]


def test_spender_at_the_mean_is_not_above(spark):
    t = tables(spark, [user(1), user(2)], orders=[order(1, 1, "10", payment="completed"),
                                                  order(2, 2, "10", payment="completed")])
    assert customers.above_average_spenders(t).count() == 0


def test_never_ordered(seed):
    assert [r[0] for r in values(menu.never_ordered(seed), "item_id")] == [3, 4, 8, 10, 11, 12, 15, 17, 18, 19, 20]


def test_user_types(seed):
    assert values(customers.user_type_stats(seed)) == [
        ("faculty", 1, 0, 0.0), ("staff", 1, 0, 0.0), ("student", 5, 4, 390.0)]


def test_payment_breakdown(seed):
    assert ordered(orders.payment_breakdown(seed)) == [
        ("completed", "wallet", 3, 305.0), ("completed", "upi", 1, 85.0), ("pending", "cash", 1, 75.0)]
    assert (None, None, 5, 465.0) in ordered(orders.payment_hierarchy(seed))


def test_category_statistics(seed):
    got = {r[0]: r[1:] for r in ordered(menu.category_statistics(seed))}
    assert got["Lunch"] == (4, 3, 3, 300.0, 92.5, 92.5, 70.0, 120.0)
    assert got["Breakfast"] == (4, 2, 2, 110.0, 43.75, 43.75, 30.0, 65.0)
    assert got["Beverages"] == (4, 3, 4, 95.0, 25.0, 25.0, 15.0, 40.0)
    assert got["Snacks"] == (4, 1, 1, 15.0, 26.25, 26.25, 15.0, 35.0)
    assert got["South Indian"] == (2, 0, None, None, 40.0, 40.0, 30.0, 50.0)
    assert got["Desserts"] == (2, 0, None, None, 40.0, 40.0, 35.0, 45.0)


def test_category_price_is_weighted_by_lines(spark):
    t = tables(spark, [user(1)], [item(1, 1, 10, 5), item(2, 1, 40, 5), item(3, 1, 70, 5)],
               [order(1, 1, 10), order(2, 1, 10)], [line(1, 1, 1, 1, 10), line(2, 2, 1, 1, 10), line(3, 2, 2, 1, 40)])
    row = menu.category_statistics(t).first()
    assert row["avg_item_price"] == (10 + 10 + 40 + 70) / 4
    assert row["mean_list_price"] == 40.0
    assert row["order_count"] == 2


def test_daily_revenue_takes_last_active_days(spark):
    days = [order(i, 1, 10 * i, payment="completed", when=datetime(2024, 1, d, 12)) for i, d in enumerate((1, 5, 9, 20), 1)]
    t = tables(spark, [user(1)], orders=days + [order(9, 1, 99, payment="failed", when=datetime(2024, 2, 1))])
    assert ordered(revenue.daily_revenue(t, 3), "order_day", "daily_revenue") == [
        (date(2024, 1, 5), 20.0), (date(2024, 1, 9), 30.0), (date(2024, 1, 20), 40.0)]
    assert ordered(revenue.period_summary(t, 3)) == [(90.0, 30.0, 40.0, 20.0)]


def test_day_bounds(spark):
    rows = [order(1, 1, 10, payment="completed", when=datetime(2024, 1, 5, 0, 0)),
            order(2, 1, 20, payment="completed", when=datetime(2024, 1, 5, 23, 59, 59)),
            order(3, 1, 40, payment="completed", when=datetime(2024, 1, 6, 0, 0))]
    t = tables(spark, [user(1)], orders=rows)
    assert ordered(overview.day_sales(t, date(2024, 1, 5))) == [(2, 30.0)]
    assert ordered(overview.day_overview(t, date(2024, 1, 5)), "revenue", "today_orders") == [(30.0, 2)]


def test_search_takes_wildcards_literally_and_ignores_case(spark):
    t = tables(spark, [user(1, name="Ann 100% Lee"), user(2, name="ann_lee"), user(3, name="Bo", srn="XLEE9")])
    assert [r[0] for r in values(customers.user_search(t, "LEE"), "user_id")] == [1, 2, 3]
    assert [r[0] for r in values(customers.user_search(t, "%"), "user_id")] == [1]
    assert [r[0] for r in values(customers.user_search(t, "n_l"), "user_id")] == [2]


def test_stock_levels(spark):
    t = tables(spark, menu=[item(i, 1, 10, s, (s or 0) > 0) for i, s in enumerate((None, -1, 0, 1, 5, 6), 1)])
    assert [r[0] for r in ordered(menu.low_stock(t), "stock")] == [1, 5]
    assert [r[0] for r in ordered(menu.low_stock(t, include_zero=True), "stock")] == [-1, 0, 1, 5]
    assert ordered(menu.out_of_stock(t), "item_id") == [(3,)]
    labels = dict(ordered(menu.menu_listing(t), "item_id", "stock_status"))
    assert labels == {1: None, 2: "Out of Stock", 3: "Out of Stock", 4: "Low (1)", 5: "Low (5)", 6: "Good (6)"}
    assert ordered(overview.menu_stats(t)) == [(6, 3, 3, 2, 1)]
    assert ordered(menu.menu_listing(t, available=False), "item_id") == [(1,), (2,), (3,)]


def test_statuses(seed):
    assert ordered(overview.order_counts(seed)) == [(5, 2, 1)]
    assert [r[0] for r in values(orders.unfinished_orders(seed), "order_id")] == [2, 3, 4, 5]
    assert [r[0] for r in values(orders.open_orders(seed), "order_id")] == [4, 5]


def test_history_and_counts(seed):
    history = {r[0]: r[1:] for r in ordered(customers.users_with_history(seed), "user_id", "order_count", "can_delete")}
    assert history[1] == (1, "No") and history[4] == (0, "Yes")
    assert ordered(overview.user_counts(seed)) == [(7, 5, 2)]
    kinds = dict(ordered(menu.menu_with_history(seed), "item_id", "delete_type"))
    assert kinds[2] == "Soft Delete" and kinds[3] == "Hard Delete"


def test_views_latest_and_samples(seed):
    assert order_summary(seed).count() == 5 and popular_items(seed).count() == 9
    assert ("Ada",) in ordered(order_summary(seed), "customer_name")
    latest = {r[0]: r[1] for r in ordered(orders.latest_orders(seed), "user_id", "order_id")}
    assert latest == {1: 1, 2: 2, 3: 3, 6: 4, 7: 5}
    assert len(ordered(orders.latest_order_lines(seed))) == 9
    assert [r[0] for r in ordered(overview.table_sample(seed, "users", 3), "user_id")] == [1, 2, 3]
    assert ordered(orders.line_detail(seed, 2), "order_id", "item_name") == [(5, "Item 7"), (5, "Item 13")]


def test_lookups(spark, seed):
    keys = spark.createDataFrame([(1,), (1,), (99,)], "user_id int")
    assert values(lookups.wallet_balances(seed.users, keys)) == [(1, 500.0), (99, 0.0)]
    orders_ = spark.createDataFrame([(4,), (99,)], "order_id int")
    assert values(lookups.order_totals(seed.order_items, orders_)) == [(4, 160.0), (99, 0.0)]
    items = spark.createDataFrame([(2,), (3,)], "item_id int")
    assert values(lookups.item_sales(seed.order_items, items)) == [(2, 65.0), (3, 0.0)]
    assert T0.tzinfo is None
