"""Ids past 32 bits, results that leave the range of their column, and top-k reports without early jobs."""

from decimal import Decimal

from pyspark.sql import functions as F

from platter.operators import ordering, people, stock, wallet
from platter.plans import customers, orders, overview
from platter.schema import SCHEMAS
from platter.sources.tables import load_tables, save_tables
from tests.seed import item, line, order, tables, user, values

FAR = 2**31 + 5
MOST = Decimal("99999999.99")


def test_ids_past_32_bits(spark, tmp_path):
    t = tables(spark, [user(FAR, balance="900")], [item(FAR, 1, 5, 50)], [order(FAR, FAR, 5)], [line(FAR, FAR, FAR, 1, 5)])
    save_tables(t, str(tmp_path / "books"))
    loaded = load_tables(spark, str(tmp_path / "books"))
    requests = spark.createDataFrame(
        [(1, FAR, "cash", FAR, 2)], "request_id int, user_id bigint, payment_method string, item_id bigint, quantity int")
    placed = ordering.place_orders(loaded, requests)
    assert values(placed.done, "order_id") == [(FAR + 1,)]
    more = spark.createDataFrame([(FAR, FAR, 3)], "order_id bigint, item_id bigint, quantity int")
    grown = ordering.add_items_to_orders(placed.tables, more).tables
    assert values(grown.order_items, "order_item_id", "quantity") == [(FAR, 4), (FAR + 1, 2)]


def test_files_with_32_bit_ids_load(spark, seed, tmp_path):
    for name, frame in seed.items():
        narrow = {c: F.col(c).cast("int") for c in frame.columns if c.endswith("_id")}
        frame.withColumns(narrow).write.parquet(str(tmp_path / "books" / name))
    loaded = load_tables(spark, str(tmp_path / "books"))
    for name, frame in loaded.items():
        assert values(frame) == values(dict(seed.items())[name])
        assert [f.dataType for f in frame.schema] == [f.dataType for f in SCHEMAS[name]]
    done = stock.deduct_stock(loaded, spark.createDataFrame([(4,)], "order_id bigint"))
    assert values(done.tables.menu_items.where("item_id = 6"), "stock") == [(7,)]


def test_topups_past_the_column_are_refused(spark):
    t = tables(spark, [user(1, balance="99999990"), user(2, balance="5"), user(3)])
    requests = spark.createDataFrame(
        [(1, 1, Decimal(9)), (2, 1, Decimal(2)), (3, 2, Decimal(1)), (4, 3, Decimal(10) ** 9), (5, 3, MOST),
         (6, None, Decimal(3)), (7, 9, MOST)], "request_id int, user_id bigint, amount decimal(14,2)")
    done = wallet.apply_topups(t, requests)
    assert values(done.tables.users, "user_id", "wallet_balance") == [(1, 99999990.0), (2, 6.0), (3, float(MOST))]
    assert values(done.rejects, "request_id", "reason") == [
        (1, "amount_out_of_range"), (2, "amount_out_of_range"), (4, "amount_out_of_range"),
        (6, "user_not_found"), (7, "user_not_found")]


def test_stock_past_the_column_is_refused(spark):
    most = 2**31 - 1
    t = tables(spark, [user(1)], [item(1, 1, 5, most - 1), item(2, 1, 5, 4), item(3, 1, 5, -most)],
               [order(1, 1, 5), order(2, 1, 5), order(3, 1, 5)],
               [line(1, 1, 1, 2, 5), line(2, 1, 2, 1, 5), line(3, 2, 2, 3, 5), line(4, 3, 3, 9, 5)])
    requests = spark.createDataFrame(
        [(1, "add", 2), (2, "add", 1), (3, "set", 2**31), (None, "set", 1), (None, "set", 2)], "item_id bigint, mode string, quantity bigint")
    done = stock.set_stock(t, requests)
    assert values(done.tables.menu_items, "item_id", "stock") == [(1, most - 1), (2, 5), (3, -most)]
    assert values(done.rejects, "item_id", "reason") == [
        (1, "stock_out_of_range"), (3, "stock_out_of_range"), (None, "item_not_found"), (None, "item_not_found")]
    ids = spark.createDataFrame([(1,), (2,), (3,), (8,)], "order_id bigint")
    cut = stock.deduct_stock(t, ids)
    assert values(cut.tables.menu_items, "item_id", "stock") == [(1, most - 3), (2, 0), (3, -most)]
    assert values(cut.rejects) == [(3, "stock_out_of_range"), (8, "order_without_lines")]
    gone = ordering.delete_orders(t, ids)
    assert values(gone.tables.menu_items, "item_id", "stock") == [(1, most - 1), (2, 7), (3, 9 - most)]
    assert values(gone.tables.orders, "order_id") == [(1,)] and values(gone.tables.order_items, "order_id") == [(1,), (1,)]
    assert values(gone.rejects) == [(1, "stock_out_of_range"), (8, "order_not_found")]


def test_refunds_past_the_column_are_refused(spark):
    t = tables(spark, [user(1, balance="99999990"), user(2)], [item(1, 1, 5, 5)],
               [order(1, 1, 8, method="wallet", payment="completed"), order(2, 1, 8, method="wallet", payment="completed"),
                order(3, 1, 8), order(4, 2, 8, method="wallet", payment="completed")])
    done = ordering.delete_orders(t, spark.createDataFrame([(i,) for i in (1, 2, 3, 4, None)], "order_id bigint"))
    assert values(done.tables.users, "user_id", "wallet_balance") == [(1, 99999990.0), (2, 8.0)]
    assert values(done.tables.orders, "order_id") == [(1,), (2,)]
    assert values(done.rejects) == [(1, "refund_out_of_range"), (2, "refund_out_of_range"), (None, "order_not_found")]


def test_dear_orders_are_refused(spark):
    t = tables(spark, [user(1)], [item(1, 1, "999999", 10**9), item(2, 1, 5, 5)])
    requests = spark.createDataFrame(
        [(1, 1, "cash", 1, 1000), (2, 1, "cash", 2, 1)],
        "request_id int, user_id int, payment_method string, item_id int, quantity int")
    done = ordering.place_orders(t, requests)
    assert values(done.done, "request_id") == [(2,)]
    assert values(done.rejects, "request_id", "reason") == [(1, "amount_out_of_range")]


def test_top_k_reports_run_nothing_when_defined(spark, seed, tmp_path):
    save_tables(seed, str(tmp_path / "books"))
    t = load_tables(spark, str(tmp_path / "books"))
    spark.sparkContext.setJobGroup("defining", "reports are defined, not run")
    try:
        for k in (5, 5000):
            reports = [overview.recent_orders(t, k), customers.wallet_transactions(t, k), orders.line_detail(t, k),
                       orders.pending_wallet_orders(t, k), orders.cancelled_orders(t, k)]
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("defining")) == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    scanned = reports[0]._jdf.queryExecution().executedPlan().toString()
    assert "special_instructions" not in scanned


def test_users_without_phone_and_balance(spark, seed):
    new = spark.createDataFrame([(1, "N1", "A", "a@x.org", "student"), (2, "r0001", "B", "b@x.org", "student")],
                                "request_id int, srn string, name string, email string, user_type string")
    done = people.insert_users(seed, new)
    assert values(done.tables.users.where("user_id = 8"), "srn", "phone", "wallet_balance") == [("N1", None, 0.0)]
    assert values(done.rejects) == [(2, "r0001", "B", "b@x.org", "student", "duplicate_srn")]


def test_small_batches_narrow_the_facts_first(seed, spark):
    """The semi join with the batch stands below the distinct of the fact."""
    users = spark.createDataFrame([(1,)], "user_id bigint")
    plan = people.delete_users(seed, users).rejects._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2
    items = spark.createDataFrame([(2,)], "item_id bigint")
    plan = stock.delete_menu_items(seed, items).done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2
