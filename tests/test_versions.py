"""Saved snapshots: marks instead of column scans, scratch that goes with its outcome, buckets that are shared."""

import os

import pytest
from pyspark.sql import functions as F

from platter.operators import ordering, people, stock, wallet
from platter.operators.base import fit_to
from platter.session import shared_dir
from platter.sources import versions
from platter.sources.retail import retail_tables
from platter.sources.tables import load_tables, save_tables
from tests.seed import item, line, order, tables, user, values


def rows(frame):
    return sorted(map(str, frame.collect()))


def same(a, b):
    return all(rows(x) == rows(y.select(*x.columns)) for (_, x), (_, y) in zip(a.items(), b.items()))


def folders(spark):
    place = shared_dir(spark).removeprefix("file:")
    return set(os.listdir(place)) if os.path.isdir(place) else set()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ids_come_from_the_mark_and_not_from_the_column(spark, seed, tmp_path):
    place = str(tmp_path / "books")
    save_tables(seed, place)
    books = load_tables(spark, place)
    assert books.high_water == {"users": 7, "categories": 6, "menu_items": 20, "orders": 5, "order_items": 9}
    asked = spark.createDataFrame([(1, 7, "cash", 14, 2), (2, 6, "cash", 1, 1)], "request_id int, user_id int, payment_method string, item_id int, quantity int")
    placed = ordering.place_orders(books, asked)
    assert values(placed.done, "request_id", "order_id") == [(1, 6), (2, 7)]
    assert "Subquery" not in plan(placed.done)
    assert "Subquery" in plan(ordering.place_orders(books.with_(orders=books.orders), asked).done)
    assert placed.tables.high_water == {"users": 7, "categories": 6, "menu_items": 20}


def test_an_empty_table_starts_at_one(spark, tmp_path):
    place = str(tmp_path / "books")
    save_tables(tables(spark, [user(1)], [item(1, 1, 5, 5)]), place)
    asked = spark.createDataFrame([(1, 1, "cash", 1, 2)], "request_id int, user_id int, payment_method string, item_id int, quantity int")
    assert values(ordering.place_orders(load_tables(spark, place), asked).done, "order_id") == [(1,)]


def test_scratch_goes_with_its_outcome_after_the_save(spark, seed, tmp_path):
    before = folders(spark)
    requests = spark.createDataFrame([(1, 1, 1, "completed", "completed")], "request_id int, seq int, order_id int, order_status string, payment_status string")
    new = spark.createDataFrame([(1, "N1", "New", "n1@example.com", "staff")], "request_id int, srn string, name string, email string, user_type string")
    ids = spark.createDataFrame([(1,), (2,)], "order_id int")
    outcomes = [wallet.apply_status_updates(seed, requests), people.insert_users(seed, new), stock.deduct_stock(seed, ids), ordering.delete_orders(seed, ids)]
    for i, outcome in enumerate(outcomes):
        assert outcome.scratch
        made = {os.path.basename(p) for p in outcome.scratch}
        assert made <= folders(spark)
        outcome.rejects.collect()
        outcome.save(str(tmp_path / f"after{i}"))
        assert not made & folders(spark)
        assert load_tables(spark, str(tmp_path / f"after{i}")).users.count() >= 7
    assert folders(spark) == before


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("versions") / "base")
    books = retail_tables(spark, "/root/testdata/sf0.001")
    books = books.with_(users=books.users.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("updated_at", F.col("updated_at").cast("timestamp")))
    versions.save_version(books, place, buckets=16)
    return place


def test_a_saved_version_is_the_snapshot(spark, base):
    books = retail_tables(spark, "/root/testdata/sf0.001")
    whole = versions.load_version(spark, base)
    assert whole.orders.count() == books.orders.count()
    assert rows(whole.order_items) == rows(books.order_items.select(*whole.order_items.columns))
    assert len(versions.open_version(spark, base).of("orders")) == 16


def written(folder, table):
    return {n for n in os.listdir(f"{folder}/{table}") if n.startswith("bucket=")}


def test_a_small_batch_rewrites_its_buckets_only(spark, base, tmp_path):
    whole = versions.load_version(spark, base)
    open_ids = [r[0] for r in whole.orders.where("order_status = 'pending'").orderBy("order_id").select("order_id").limit(2).collect()]
    sold = whole.menu_items.where("is_available AND stock > 5").orderBy("item_id").first()["item_id"]
    asked = spark.createDataFrame([(i, sold, 1) for i in open_ids], "order_id bigint, item_id bigint, quantity int")
    after = str(tmp_path / "after")
    change = lambda t: ordering.add_items_to_orders(t, asked)
    versions.apply_batch(spark, base, after, change, asked)
    touched = versions.touched_buckets(versions.open_version(spark, base), asked)
    assert written(after, "orders") == written(after, "order_items") == {f"bucket={n}" for n in touched} and len(touched) <= 2
    assert same(change(whole).tables, versions.load_version(spark, after))
    assert len(versions.open_version(spark, after).of("orders")) == 16


def test_new_orders_are_added_without_reading_the_old_ones(spark, base, tmp_path):
    whole = versions.load_version(spark, base)
    buyer = whole.users.orderBy("user_id").first()["user_id"]
    sold = whole.menu_items.where("is_available AND stock > 5").orderBy("item_id").first()["item_id"]
    asked = spark.createDataFrame([(1, buyer, "cash", sold, 2)], "request_id int, user_id bigint, payment_method string, item_id bigint, quantity int")
    after, later = str(tmp_path / "after"), str(tmp_path / "later")
    change = lambda t: ordering.place_orders(t, asked)
    done = versions.apply_batch(spark, base, after, change)
    new_id = done.done.first()["order_id"]
    assert new_id == whole.high_water["orders"] + 1
    assert len(written(after, "orders")) == 1
    assert same(change(whole).tables, versions.load_version(spark, after))
    # the bucket with two folders is brought together by the next batch that touches it
    ids = spark.createDataFrame([(new_id,)], "order_id bigint")
    versions.apply_batch(spark, after, later, lambda t: ordering.delete_orders(t, ids), ids)
    assert rows(versions.load_version(spark, later).orders) == rows(whole.orders)
    assert versions.load_version(spark, later).high_water["orders"] == new_id
    assert len(versions.open_version(spark, later).of("orders")) == 16


def test_purging_touches_buckets_with_cancelled_orders(spark, base, tmp_path):
    after = str(tmp_path / "after")
    whole = versions.load_version(spark, base)
    gone = whole.orders.where("order_status = 'cancelled'").select("order_id")
    versions.apply_batch(spark, base, after, ordering.purge_cancelled, gone)
    assert same(ordering.purge_cancelled(whole).tables, versions.load_version(spark, after))


def test_lines_beyond_the_range_refuse_their_order_only(spark):
    t = tables(spark, [user(1)], [item(1, 1, "99999.00", 900), item(2, 1, 5, 900)], [order(1, 1, 5), order(2, 1, 5)],
               [line(1, 1, 2, 1, 5), line(2, 2, 1, 999, "99999.00")])
    asked = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (2, 2, 1), (1, 2, 3)], "order_id int, item_id int, quantity int")
    done = ordering.add_items_to_orders(t, asked)
    assert values(done.rejects) == [(2, 1, 2, "amount_out_of_range"), (2, 2, 1, "amount_out_of_range")]
    assert values(done.tables.orders, "order_id", "total_amount") == [(1, 200018.0), (2, 5.0)]
    assert values(done.tables.order_items.where("order_id = 2"), "item_id", "quantity") == [(1, 999)]
    assert values(done.tables.order_items.where("order_id = 1"), "item_id", "quantity", "subtotal") == [(1, 2, 199998.0), (2, 4, 20.0)]


def test_lines_are_narrowed_before_their_first_exchange(spark, monkeypatch):
    held = {}
    real = ordering.stored
    monkeypatch.setattr(ordering, "stored", lambda frame, label: held.setdefault(label, frame) and real(frame, label))
    t = retail_tables(spark, "/root/testdata/sf0.001")
    asked = spark.createDataFrame([(1, 1, 1)], "order_id bigint, item_id bigint, quantity int")
    ordering.add_items_to_orders(t, asked)
    steps = [s for s in plan(held["touched-lines"]).splitlines() if "Join" in s or "Exchange" in s or "lineitem" in s]
    at = next(i for i, s in enumerate(steps) if "lineitem" in s)
    assert "LeftSemi" in steps[0] and not any("Exchange" in s and "Broadcast" not in s for s in steps[:at])


def test_lines_of_a_large_batch_are_dealt_out_once(spark, monkeypatch):
    held = {}
    real = ordering.stored
    monkeypatch.setattr(ordering, "stored", lambda frame, label: held.setdefault(label, frame) and real(frame, label))
    t = retail_tables(spark, "/root/testdata/sf0.001")
    asked = t.order_items.select("order_id", "item_id", F.lit(1).alias("quantity"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")  # too little for the additions
    try:
        done = ordering.add_items_to_orders(t, asked)
        assert "hashpartitioning" not in plan(held["touched-lines"])
        assert "LeftAnti" not in plan(done.tables.order_items)
        before, after = t.order_items.collect(), done.tables.order_items.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    added = {r[0] for r in asked.join(done.rejects, ["order_id", "item_id"], "left_anti").select("order_id").collect()}
    assert added and len(after) == len(before)
    assert sorted(map(str, (r for r in after if r["order_id"] not in added))) == sorted(map(str, (r for r in before if r["order_id"] not in added)))
    assert sum(r["quantity"] for r in after) > sum(r["quantity"] for r in before)


def kinds(outcome):
    return {os.path.basename(p).rpartition("-")[0] for p in outcome.scratch}


def test_rejects_are_read_without_numbering_or_exact_figures(spark, tmp_path):
    """Bounds per order settle an ordinary batch; an order past its bound is still let in by its exact figures."""
    t = tables(spark, [user(1)], [item(1, 1, "99999.00", 900), item(2, 1, 5, 2000)], [order(1, 1, 5), order(2, 1, 5, status="completed")],
               [line(1, 1, 1, 1, "99999.00"), line(-2, -64, 1, 1, 5)])
    asked = "order_id int, item_id int, quantity int"
    plain = ordering.add_items_to_orders(t, spark.createDataFrame([(1, 2, 3), (2, 2, 1)], asked))
    assert values(plain.rejects) == [(2, 2, 1, "order_not_open")]
    assert not kinds(plain) & {"ordered", "beyond-range"}
    assert values(plain.tables.order_items, "order_item_id", "quantity") == [(-2, 1), (1, 1), (2, 3)]
    assert "ordered" in kinds(plain)
    plain.save(str(tmp_path / "after"))
    assert not {os.path.basename(p) for p in plain.scratch} & folders(spark)
    near = ordering.add_items_to_orders(t, spark.createDataFrame([(1, 2, 1500)], asked))
    assert "beyond-range" in kinds(near) and values(near.rejects) == []
    assert values(near.tables.orders, "order_id", "total_amount") == [(1, 107499.0), (2, 5.0)]


def test_totals_are_read_without_numbering(spark):
    t = tables(spark, [user(1)], [item(1, 1, 7, 900), item(2, 1, 5, 900)], [order(1, 1, 5), order(2, 1, 5), order(65, 1, 5)],
               [line(1, 1, 1, 2, 5), line(2, 1, 1, 1, 6, 4), line(3, 1, 3, 1, 2), line(4, 2, 1, 1, 5)])
    done = ordering.add_items_to_orders(t, spark.createDataFrame([(1, 1, 1), (1, 2, 2), (65, 1, 3)], "order_id int, item_id int, quantity int"))
    assert values(done.tables.orders, "order_id", "total_amount") == [(1, 39.0), (2, 5.0), (65, 21.0)]
    assert "ordered" not in kinds(done)
    sums = done.tables.order_items.groupBy("order_id").agg(F.sum("subtotal").alias("total"))
    assert values(sums.where("order_id <> 2")) == [(1, 39.0), (65, 21.0)]


def mixed_batch(spark):
    """Requests of every kind for orders of every kind, one of them repeated with another status."""
    t = tables(spark, [user(1)], [item(1, 1, "99999.00", 900), item(2, 1, 5, 2000), item(3, 1, 5, 0)],
               [order(1, 1, 5), order(2, 1, 5, status="completed"), order(3, 1, 5), order(3, 1, 5, status="cancelled"), order(90, 1, 5)],
               [line(1, 1, 1, 1, "99999.00"), line(2, 2, 1, 1, 5), line(3, 3, 2, 1, 5), line(4, 3, 2, 2, 6), line(5, 90, 1, 999, "99999.00")])
    asked = [(1, 2, 3), (1, 1, 2), (2, 2, 1), (3, 2, 1), (3, 3, 1), (3, 9, 1), (3, 2, 0), (3, 2, None), (3, None, 1),
             (90, 1, 2), (90, 2, 1), (91, 1, 1), (None, 1, 1)]
    return t, spark.createDataFrame(asked, "order_id int, item_id int, quantity int")


def test_rejects_of_a_large_batch_narrow_no_lines(spark, monkeypatch):
    t, asked = mixed_batch(spark)
    small = ordering.add_items_to_orders(t, asked)
    monkeypatch.setattr(ordering, "LARGE_BATCH", 0, raising=False)
    large = ordering.add_items_to_orders(t, asked)
    found = sorted(map(str, large.rejects.collect()))
    assert found == sorted(map(str, small.rejects.collect()))
    assert sum("amount_out_of_range" in r for r in found) == 2 and sum("order_not_found" in r for r in found) == 2
    assert not kinds(large) & {"added", "touched-lines"}
    calm = ordering.add_items_to_orders(t, asked.where("order_id < 9"))
    assert kinds(calm) == {"asked-bounds", "suspect-bounds"}


def test_totals_of_a_large_batch_deal_out_open_orders_only(spark, monkeypatch):
    t, asked = mixed_batch(spark)
    small = ordering.add_items_to_orders(t, asked)
    monkeypatch.setattr(ordering, "LARGE_BATCH", 0, raising=False)
    large = ordering.add_items_to_orders(t, asked)
    totals = values(large.tables.orders, "order_id", "total_amount")
    assert totals == values(small.tables.orders, "order_id", "total_amount") and totals[0] == (1, 300012.0)
    assert "open-blocks" in kinds(large) and "touched-lines" not in kinds(large)
    assert values(large.tables.order_items, "order_id", "item_id", "quantity") == values(small.tables.order_items, "order_id", "item_id", "quantity")


def test_totals_of_a_large_batch_deal_requests_out_once_and_write_no_additions(spark, monkeypatch):
    t = tables(spark, [user(1)], [item(1, 1, 7, 900), item(2, 1, 5, 900), item(2, 1, 6, 900), item(3, 1, 4, 900)],
               [order(1, 1, 5), order(2, 1, 5), order(2, 1, 9), order(2, 1, 8, status="completed"), order(3, 1, 5, status="ready"), order(4, 1, 5),
                order(5, 1, 5), order(70, 1, 5)],
               [line(1, 1, 1, 2, 5), line(2, 1, 1, 1, 6, 4), line(3, 1, 3, 1, 2), line(4, 2, 1, 3, 5), line(5, 2, 3, 1, 9), line(6, 3, 1, 1, 5),
                line(7, 4, 1, 1, 5)])
    empty = t.order_items.where("order_item_id = 4").withColumns({"order_item_id": F.lit(8), "quantity": F.lit(None).cast("int")})
    t = t.with_(order_items=t.order_items.unionByName(fit_to(t.order_items, empty)))
    asked = spark.createDataFrame(
        [(1, 1, 1), (1, 1, 2), (1, 2, 2), (2, 1, 1), (2, 2, 3), (2, 2, 1), (3, 1, 1), (5, 3, 2), (5, 9, 1), (70, 3, 901), (71, 1, 1), (None, 1, 1), (1, None, 1)],
        "order_id int, item_id int, quantity int")
    small = ordering.add_items_to_orders(t, asked).tables.orders
    monkeypatch.setattr(ordering, "LARGE_BATCH", 0, raising=False)
    large = ordering.add_items_to_orders(t, asked)
    # 1: lines of 2 and 1 pieces grow by 3, the new line doubles as its item is listed twice; 2: open twice, so all is added twice.
    twice = (3 + 2) * 5 + 9 + 2 * 2 * (3 + 1) * 6
    want = [(1, 25 + 24 + 2 + 4 * 6), (2, twice), (2, twice), (2, twice), (3, 5), (4, 5), (5, 8), (70, 5)]
    assert values(large.tables.orders, "order_id", "total_amount") == [(i, float(n)) for i, n in want]
    assert rows(large.tables.orders) == rows(small)
    assert "added" not in kinds(large)
    assert "FullOuter" not in plan(large.tables.orders)
