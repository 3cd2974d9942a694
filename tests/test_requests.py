"""No request is lost: unknown and missing keys come back."""

from platter.operators.stock import set_stock
from platter.plans.menu import order_preview


def test_stock_requests_without_an_item_are_refused(spark, seed):
    asked = spark.createDataFrame([(None, "add", 1), (None, "add", 2), (1, "bad", 1)], "item_id int, mode string, quantity int")
    rejects = sorted(str((r["item_id"], r["reason"])) for r in set_stock(seed, asked).rejects.collect())
    assert rejects == ["(1, 'invalid_mode')", "(None, 'item_not_found')", "(None, 'item_not_found')"]


def test_preview_keeps_unknown_items(spark, seed):
    asked = spark.createDataFrame([(-5, 2)], "item_id int, quantity int")
    assert [(r["item_id"], r["order_total"]) for r in order_preview(asked, seed.menu_items).collect()] == [(-5, None)]
