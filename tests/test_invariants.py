"""What every batch must keep: money and stock add up, requests are all accounted for, keys stay sound."""

import pytest
from pyspark.sql import functions as F

from checks.ledger import (
    Books,
    addition_requests,
    order_id_requests,
    order_requests,
    status_requests,
    topup_requests,
)
from platter.operators import ordering, quality, stock, wallet
from platter.sources.retail import retail_tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def books(spark):
    return Books(spark, FOLDER, retail_tables(spark, FOLDER))


def total(df, column):
    return df.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0]


def sound(before, after):
    """No new orphans and no newly repeated keys."""
    assert quality.integrity_report(after).agg(F.sum("violations")).first()[0] == 0
    was = {r["rule"]: r["violations"] for r in quality.uniqueness_report(before).collect()}
    now = {r["rule"]: r["violations"] for r in quality.uniqueness_report(after).collect()}
    assert all(now[rule] <= was[rule] for rule in was)


def test_topups_add_up(books):
    requests = topup_requests(books)
    done = wallet.apply_topups(books.tables, requests)
    granted = total(requests, "amount") - total(done.rejects, "amount")
    assert total(done.tables.users, "wallet_balance") - total(books.tables.users, "wallet_balance") == granted


def test_draws_add_up(books):
    requests = status_requests(books)
    done = wallet.apply_status_updates(books.tables, requests)
    assert done.done.count() + done.rejects.count() == requests.count()
    overdrawn = books.tables.users.where("wallet_balance < 0").select("user_id")
    now = done.tables.users.where("wallet_balance < 0").select("user_id")
    assert now.join(overdrawn, "user_id", "left_anti").count() == 0
    sound(books.tables, done.tables)


def test_new_orders_are_all_accounted_for(books):
    requests = order_requests(books)
    done = ordering.place_orders(books.tables, requests)
    placed = done.done.count()
    assert placed + done.rejects.count() == requests.count()
    assert done.tables.orders.count() - books.tables.orders.count() == placed
    assert total(done.tables.orders, "total_amount") - total(books.tables.orders, "total_amount") == total(
        done.done, "total_amount")
    sound(books.tables, done.tables)


def test_additions_and_stock_add_up(books):
    requests = addition_requests(books)
    done = ordering.add_items_to_orders(books.tables, requests)
    asked = total(requests, "quantity") - total(done.rejects, "quantity")
    repeated = books.tables.order_items.groupBy("order_id", "item_id").count().where("count > 1").count()
    grown = total(done.tables.order_items, "quantity") - total(books.tables.order_items, "quantity")
    assert grown == asked or repeated > 0
    ids = order_id_requests(books)
    cut = stock.deduct_stock(books.tables, ids).tables
    moved = total(books.tables.order_items.join(ids.distinct(), "order_id", "left_semi"), "quantity")
    assert total(books.tables.menu_items, "stock") - total(cut.menu_items, "stock") == moved
    back = ordering.delete_orders(books.tables, ids).tables
    assert total(back.menu_items, "stock") - total(books.tables.menu_items, "stock") == moved
    sound(books.tables, back)
