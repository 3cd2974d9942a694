import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from platter.operators import ordering, people, quality, stock, wallet
from platter.operators.sequence import look_up, running, with_position
from tests.seed import item, line, order, tables, user, values

NOW = datetime(2024, 6, 1, 12)


def balances(outcome):
    return dict(values(outcome.tables.users, "user_id", "wallet_balance"))


def test_topups(spark, seed):
    requests = spark.createDataFrame(
        [(1, 6, Decimal(200)), (2, 6, Decimal("0.50")), (3, 1, Decimal(0)), (4, 1, Decimal(-5)), (5, 1, None),
         (6, 99, Decimal(10)), (7, None, Decimal(10))],
        "request_id int, user_id int, amount decimal(10,2)")
    done = wallet.apply_topups(seed, requests, NOW)
    assert balances(done)[6] == 800.5 and balances(done)[1] == 500.0
    assert values(done.rejects, "request_id", "reason") == [
        (3, "Amount must be positive"), (4, "Amount must be positive"), (5, "Amount must be positive"),
        (6, "user_not_found"), (7, "user_not_found")]
    capped = wallet.apply_topups(seed, requests, NOW, limit=Decimal(100))
    assert (1, "amount_above_limit") in values(capped.rejects, "request_id", "reason")
    assert values(done.tables.users.where("updated_at > '2024-05-01'"), "user_id") == [(6,)]


def test_place_and_extend(spark, seed):
    requests = spark.createDataFrame(
        [(1, 7, "cash", 14, 2), (2, 3, "wallet", 6, 4), (3, 1, "cash", 6, 9), (4, 99, "cash", 1, 1),
         (5, 1, "cash", 99, 1), (6, 1, "cheque", 1, 1), (7, 1, "cash", 1, 0), (8, 4, "wallet", 6, 8)],
        "request_id int, user_id int, payment_method string, item_id int, quantity int")
    placed = ordering.place_orders(seed, requests, NOW)
    assert values(placed.done) == [(1, 6, 40.0), (8, 7, 960.0)]
    assert values(placed.rejects, "request_id", "reason") == [
        (2, "insufficient_balance"), (3, "insufficient_stock"), (4, "user_not_found"), (5, "item_not_found"),
        (6, "invalid_payment_method"), (7, "invalid_quantity")]
    t = placed.tables
    assert values(t.orders.where("order_id = 6"), "user_id", "order_status", "payment_status", "total_amount") == [
        (7, "pending", "pending", 40.0)]
    assert values(t.order_items.where("order_id = 6"), "order_item_id", "quantity", "subtotal") == [(10, 2, 40.0)]
    assert t.orders.schema.simpleString() == seed.orders.schema.simpleString()

    more = spark.createDataFrame(
        [(6, 9, 1), (6, 2, 1), (6, 2, 2), (6, 14, 1), (1, 9, 1), (42, 9, 1), (6, 9, 0), (6, 9, 51)],
        "order_id int, item_id int, quantity int")
    added = ordering.add_items_to_orders(t, more, NOW)
    assert values(added.tables.order_items.where("order_id = 6"), "item_id", "quantity", "subtotal") == [
        (2, 3, 195.0), (9, 1, 15.0), (14, 3, 60.0)]
    assert values(added.tables.orders.where("order_id in (1, 6)"), "order_id", "total_amount") == [
        (1, 110.0), (6, 270.0)]
    assert values(added.rejects) == [
        (1, 9, 1, "order_not_open"), (6, 9, 0, "invalid_quantity"), (6, 9, 51, "insufficient_stock"),
        (42, 9, 1, "order_not_found")]
    ids = [r[0] for r in values(added.tables.order_items, "order_item_id")]
    assert len(ids) == len(set(ids))


def test_added_items_keep_the_price_of_their_line(spark):
    t = tables(spark, [user(1)], [item(1, 1, 30, 9)], [order(1, 1, 20)], [line(1, 1, 1, 2, 20)])
    done = ordering.add_items_to_orders(t, spark.createDataFrame([(1, 1, 1)], "order_id int, item_id int, quantity int"))
    assert values(done.tables.order_items, "quantity", "unit_price", "subtotal") == [(3, 20.0, 60.0)]
    assert values(done.tables.orders, "total_amount") == [(60.0,)]


def test_deduct_and_delete_orders(spark, seed):
    ids = spark.createDataFrame([(4,), (4,), (77,)], "order_id int")
    cut = stock.deduct_stock(seed, ids, NOW)
    levels = dict(values(cut.tables.menu_items, "item_id", "stock"))
    assert (levels[6], levels[16], levels[1]) == (7, 49, 20)
    assert values(cut.rejects) == [(77, "order_without_lines")]

    gone = ordering.delete_orders(seed, spark.createDataFrame([(1,), (5,), (77,)], "order_id int"), NOW)
    levels = dict(values(gone.tables.menu_items, "item_id", "stock"))
    assert (levels[2], levels[14], levels[9], levels[7]) == (16, 102, 51, 11)
    assert balances(gone)[1] == 610.0 and balances(gone)[7] == 550.0
    assert gone.tables.order_items.count() == 4 and gone.tables.orders.count() == 3
    assert values(gone.rejects) == [(77, "order_not_found")]
    assert all(r[1] == 0 for r in values(quality.integrity_report(gone.tables)))


def test_orders_that_share_an_item_and_empty_stock(spark):
    t = tables(spark, [user(1)], [item(1, 1, 10, 5), item(2, 1, 10, None), item(3, 1, 10, 0, True), item(4, 1, 10, -9, False)],
               [order(1, 1, 10), order(2, 1, 10)],
               [line(1, 1, 1, 2, 10), line(2, 2, 1, 3, 10), line(3, 1, 2, 1, 10), line(4, 2, 4, 4, 10)])
    ids = spark.createDataFrame([(1,), (2,)], "order_id int")
    cut = stock.deduct_stock(t, ids).tables.menu_items
    assert values(cut, "item_id", "stock", "is_available") == [
        (1, 0, False), (2, None, True), (3, 0, False), (4, -13, False)]
    back = ordering.delete_orders(t, ids).tables.menu_items
    assert values(back, "item_id", "stock", "is_available") == [
        (1, 10, True), (2, None, True), (3, 0, True), (4, -5, False)]


def test_set_stock_and_restore(spark, seed):
    requests = spark.createDataFrame(
        [(9, "set", 0), (1, "add", 5), (2, "reduce", 15), (3, "reduce", 26), (4, "add", 0), (5, "swap", 1),
         (99, "set", 1), (6, "add", 1), (6, "add", 2)], "item_id int, mode string, quantity int")
    done = stock.set_stock(seed, requests, NOW)
    rows = {r[0]: r[1:] for r in values(done.tables.menu_items, "item_id", "stock", "is_available")}
    assert (rows[9], rows[1], rows[2], rows[3], rows[6]) == (
        (0, False), (25, True), (0, False), (25, True), (8, True))
    assert values(done.rejects, "item_id", "reason") == [
        (3, "insufficient_stock"), (4, "invalid_quantity"), (5, "invalid_mode"), (6, "duplicate_request"),
        (6, "duplicate_request"), (99, "item_not_found")]
    ids = spark.createDataFrame([(9,), (1,), (99,)], "item_id int")
    restored = stock.restore_items(done.tables, ids)
    assert values(restored.rejects) == [(9, "out_of_stock"), (99, "item_not_found")]


def test_delete_users_items_and_purge(spark, seed):
    people_ = people.delete_users(seed, spark.createDataFrame([(1,), (4,), (99,)], "user_id int"))
    assert values(people_.tables.users, "user_id") == [(1,), (2,), (3,), (5,), (6,), (7,)]
    assert [r[0] for r in values(people_.rejects, "user_id")] == [1, 99]
    assert values(people_.done) == [(4, "User 4 deleted successfully")]
    items = stock.delete_menu_items(seed, spark.createDataFrame([(2,), (3,), (99,)], "item_id int"))
    assert values(items.done, "item_id", "action") == [(2, "soft"), (3, "hard")]
    assert items.tables.menu_items.count() == 19
    assert values(items.tables.menu_items.where("item_id = 2"), "stock", "is_available") == [(0, False)]
    restored = stock.restore_items(items.tables, spark.createDataFrame([(2,)], "item_id int"))
    assert values(restored.rejects) == [(2, "out_of_stock")]
    t = seed.with_(orders=seed.orders.withColumn("order_status", F.when(F.col("order_id") == 1, "cancelled").otherwise(F.col("order_status"))))
    purged = ordering.purge_cancelled(t).tables
    assert purged.orders.count() == 4 and purged.order_items.count() == 6
    assert values(purged.users, "wallet_balance") == values(seed.users, "wallet_balance")


def test_insert_users_in_order(spark, seed):
    columns = "request_id int, srn string, name string, email string, phone string, user_type string, wallet_balance decimal(10,2)"
    rows = [
        (1, "N1", "A", "a@x.org", "9000000001", "student", Decimal(5)),
        (2, "n1", "B", "b@x.org", None, "student", None),          # number taken by 1
        (3, "N3", "C", "B@x.org", "", "student", None),            # its mail is free, as 2 was turned away
        (4, "N3", "D", "d@x.org", None, "student", None),          # number taken by 3
        (5, "N5", "E", "nodot@x", None, "student", None),
        (6, "N6", "F", "f@x.org", "900000001", "student", None),
        (7, "N7", "", "g@x.org", None, "student", None),
        (8, "r0001", "H", "h@x.org", None, "student", None),       # taken in the snapshot
        (9, "N9", "I", "i@x.org", None, "guest", None),
    ]
    done = people.insert_users(seed, spark.createDataFrame(rows, columns), NOW)
    assert values(done.done) == [(1, 8), (3, 9)]
    assert values(done.rejects, "request_id", "reason") == [
        (2, "duplicate_srn"), (4, "duplicate_srn"), (5, "invalid_email"), (6, "invalid_phone"),
        (7, "missing_field"), (8, "duplicate_srn"), (9, "invalid_user_type")]


def test_first_come_against_one_by_one(spark):
    rng = random.Random(7)
    rows = [(i, f"s{rng.randrange(12)}", f"e{rng.randrange(12)}") for i in range(120)]
    got_in, turned = people.first_come(spark.createDataFrame(rows, "position bigint, _srn string, _email string"), ("_srn", "_email"))
    srns, emails, want, late = set(), set(), [], []
    for i, s, e in rows:
        if s not in srns and e not in emails:
            srns.add(s), emails.add(e), want.append(i)
        else:
            late.append((i, "_srn" if s in srns else "_email"))
    assert [r[0] for r in values(got_in)] == want
    assert values(turned, "position", "key") == late


def test_insert_items(spark, seed):
    rows = [(1, "Tea", 4, Decimal(9), 0, 3), (2, None, 4, Decimal(9), 1, 3), (3, "X", 9, Decimal(9), 1, 3),
            (4, "Y", 4, Decimal("0.50"), 1, 3), (5, "Z", 4, Decimal(9), -1, 3), (6, "W", 4, Decimal(9), None, 0)]
    done = stock.insert_menu_items(seed, spark.createDataFrame(
        rows, "request_id int, item_name string, category_id int, price decimal(8,2), stock int, preparation_time_minutes int"), NOW)
    assert values(done.done) == [(1, 21)]
    assert values(done.tables.menu_items.where("item_id = 21"), "stock", "is_available") == [(0, True)]
    assert [r[1] for r in values(done.rejects, "request_id", "reason")] == [
        "missing_field", "category_not_found", "invalid_price", "invalid_stock", "invalid_preparation_time"]


# --- status changes in sequence ---------------------------------------------------------------------

STATUS = "request_id int, seq bigint, order_id int, order_status string, payment_status string"


def test_wallet_is_drawn_once(spark, seed):
    pending = seed.with_(orders=seed.orders.withColumn(
        "payment_status", F.when(F.col("order_id") == 4, "pending").otherwise(F.col("payment_status"))))
    requests = spark.createDataFrame(
        [(1, 1, 4, "completed", "completed"), (2, 2, 4, "completed", "completed"), (3, 3, 1, "ready", "completed"),
         (4, 4, 1, "ready", "refunded")], STATUS)
    done = wallet.apply_status_updates(pending, requests, NOW)
    assert balances(done)[6] == 450.0 and balances(done)[1] == 500.0
    assert done.rejects.count() == 0
    assert values(done.tables.orders.where("order_id in (1, 4)"), "order_id", "order_status", "payment_status") == [
        (1, "ready", "refunded"), (4, "completed", "completed")]


def test_refused_draw_keeps_the_order(spark):
    t = tables(spark, [user(1, balance="100")], orders=[
        order(1, 1, 80, method="wallet"), order(2, 1, 50, method="wallet"), order(3, 1, 20, method="wallet"),
        order(4, 1, 500, method="cash")])
    requests = spark.createDataFrame(
        [(1, 10, 1, "ready", "completed"), (2, 20, 2, "ready", "completed"), (3, 30, 3, "ready", "completed"),
         (4, 40, 2, "cancelled", "failed"), (5, 50, 2, "ready", "completed"), (6, 60, 4, "ready", "completed"),
         (7, 70, 9, "ready", "completed"), (8, 80, 4, "shipped", "completed"), (9, 90, 4, "ready", None)], STATUS)
    done = wallet.apply_status_updates(t, requests, NOW)
    assert balances(done) == {1: 0.0}
    assert values(done.rejects, "request_id", "reason") == [
        (2, "insufficient_balance"), (5, "insufficient_balance"), (7, "order_not_found"),
        (8, "invalid_order_status"), (9, "invalid_payment_status")]
    assert values(done.tables.orders, "order_id", "order_status", "payment_status") == [
        (1, "ready", "completed"), (2, "cancelled", "failed"), (3, "ready", "completed"), (4, "ready", "completed")]


def one_by_one(users, orders, requests):
    """The rule applied to one request after the other."""
    funds, state, refused = dict(users), {o: (u, total, m, "pending", p) for o, u, total, m, p in orders}, []
    for rid, _, oid, status, payment in sorted(requests, key=lambda r: (r[1], r[0])):
        u, total, method, _, had = state[oid]
        if payment == "completed" and had != "completed" and method == "wallet":
            if funds[u] - total < 0:
                refused.append(rid)
                continue
            funds[u] -= total
        state[oid] = (u, total, method, status, payment)
    return funds, {o: s[3:] for o, s in state.items()}, refused


@pytest.mark.parametrize("fold_rows, chunk_rows, seed_", [(0, 7, 1), (0, 1, 2), (3, 16, 3), (500, 100000, 4), (0, 50, 5)])
def test_status_updates_against_one_by_one(spark, fold_rows, chunk_rows, seed_):
    rng = random.Random(seed_)
    # user 1 owns a third of everything
    owners = [1 if rng.random() < 0.34 else rng.randrange(2, 9) for _ in range(60)]
    users = {u: Decimal(rng.randrange(0, 60000)) / 100 for u in range(1, 9)}
    orders = [(o, u, Decimal(rng.choice([rng.randrange(1, 500), rng.randrange(1, 20000)])) / 100,
               rng.choice(["wallet", "wallet", "cash"]), rng.choice(["pending", "failed", "completed"]))
              for o, u in enumerate(owners, 1)]
    requests = [(i, rng.randrange(10**6), 1 if rng.random() < 0.33 else rng.randrange(1, 61),
                 rng.choice(["pending", "ready", "completed"]),
                 rng.choice(["completed", "completed", "pending", "failed"])) for i in range(400)]
    funds, state, refused = one_by_one(users, orders, requests)
    t = tables(spark, [user(u, balance=b) for u, b in users.items()],
               orders=[order(o, u, total, "pending", m, p) for o, u, total, m, p in orders])
    done = wallet.apply_status_updates(t, spark.createDataFrame(requests, STATUS), NOW, chunk_rows, fold_rows)
    assert balances(done) == {u: float(b) for u, b in funds.items()}
    assert [r[0] for r in values(done.rejects, "request_id")] == sorted(refused)
    got = {r[0]: r[1:] for r in values(done.tables.orders, "order_id", "order_status", "payment_status")}
    assert got == state


def test_missing_wallet_sets_no_limit(spark):
    rows = [user(1)]
    rows[0] = (*rows[0][:6], None, *rows[0][7:])
    t = tables(spark, rows, orders=[order(1, 1, 80, method="wallet")])
    done = wallet.apply_status_updates(t, spark.createDataFrame([(1, 1, 1, "ready", "completed")], STATUS))
    assert balances(done) == {1: None} and done.rejects.count() == 0


# --- order of requests -------------------------------------------------------------------------------


def test_positions_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k")).repartition(7)
    got = values(with_position(df, "k", chunk_rows=64), "position", "k", "chunk")
    assert [r[0] for r in got] == list(range(1000))
    assert [r[1] for r in got] == sorted(r[1] for r in got)
    assert [r[2] for r in got] == [i // 64 for i in range(1000)]
    assert with_position(df.limit(0), "k").count() == 0


def test_running_values_cross_chunks(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aab"), rng.choice([None, i])) for i in range(200)]
    df = with_position(spark.createDataFrame(rows, "n int, key string, v int"), "n", chunk_rows=9)
    summed = running(df, "key", "sum", F.col("v"), "s")
    before = running(df, "key", "last", F.col("v"), "p", inclusive=False)
    total, last, want_sum, want_last = {}, {}, [], []
    for i, k, v in rows:
        want_last.append((i, last.get(k)))
        total[k] = total.get(k, 0) + (v or 0)
        last[k] = v if v is not None else last.get(k)
        want_sum.append((i, total[k]))
    assert values(summed, "n", "s") == want_sum
    assert sorted(tuple(r) for r in before.select("n", "p").collect()) == want_last
    names = spark.createDataFrame([("a", 1)], "key string, code int")
    assert values(look_up(df, "key", names).groupBy("key", "code").count(), "key", "code") == [("a", 1), ("b", None)]
