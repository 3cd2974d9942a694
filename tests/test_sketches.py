"""Merged sketches beside exact distinct counts."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from platter.plans import sketches
from platter.plans.views import paid
from platter.sources.retail import retail_tables


@pytest.fixture(scope="module")
def retail(spark):
    return retail_tables(spark, "/root/testdata/sf0.01")


def exact_orders(t, since, until):
    lines = t.order_items.join(t.menu_items, "item_id").join(t.orders, "order_id")
    wanted = lines.where((F.col("order_date") >= F.lit(since)) & (F.col("order_date") < F.lit(until)))
    return {r[0]: r[1:] for r in wanted.groupBy("category_id").agg(F.countDistinct("order_id"), F.sum(t.order_items.quantity)).collect()}


@pytest.mark.parametrize("since, until", [(date(1992, 1, 1), date(1999, 1, 1)), (date(1996, 3, 1), date(1996, 5, 15)), (date(1997, 1, 1), date(1997, 1, 2))])
def test_any_range_of_days_keeps_the_stated_bound(spark, retail, since, until, tmp_path):
    place = str(tmp_path / "daily")
    daily = sketches.daily_orders(retail)
    split = date(1996, 4, 10)
    daily.where(F.col("order_day") < F.lit(split)).write.parquet(place)
    daily.where(F.col("order_day") >= F.lit(split)).write.mode("append").parquet(place)  # a later delivery
    got = sketches.over_days(spark.read.parquet(place), "category_id", sums=("quantity",), since=since, until=until)
    got = {r["category_id"]: (r["distinct"], r["quantity"]) for r in got.collect()}
    want = exact_orders(retail, since, until)
    assert got.keys() == want.keys()
    for key, (orders, quantity) in want.items():
        assert got[key][1] == quantity
        assert abs(got[key][0] - orders) <= sketches.error_bound() * orders
        if orders < 100:
            assert got[key][0] == orders


def test_buyers_are_counted_once_over_all_days(retail):
    t = retail
    merged = {r["user_type"]: r["distinct"] for r in sketches.over_days(sketches.daily_buyers(t), "user_type").collect()}
    buying = paid(t.orders).join(t.users.select("user_id", "user_type"), "user_id")
    exact = {r[0]: r[1] for r in buying.groupBy("user_type").agg(F.countDistinct("user_id")).collect()}
    assert merged.keys() == exact.keys()
    assert all(abs(merged[k] - n) <= sketches.error_bound() * n for k, n in exact.items())


def test_finer_sketches_have_a_smaller_bound():
    assert sketches.error_bound(12) == pytest.approx(0.065) and sketches.error_bound(16) < 0.02
