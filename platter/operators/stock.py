"""Stock and availability of menu items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.functions.expressions import message
from platter.operators.base import Outcome, changed, fit_to, judge, next_id, owns_scratch, refused, stamp
from platter.operators.sequence import with_position
from platter.schema import COUNT_MOST, DEFAULTS, Tables
from platter.session import stored


def enforce_availability(menu: DataFrame, as_of: object | None = None) -> DataFrame:
    """Switch off every item without stock; never switches one on."""
    empty = (F.col("stock") <= 0) & F.col("is_available")
    return changed(menu, empty, is_available=F.lit(False), updated_at=stamp(as_of))


def _available_unless_empty(stock: Column, available: Column) -> Column:
    return F.when(stock <= 0, F.lit(False)).otherwise(available)


def _quantity_by_item(lines: DataFrame) -> DataFrame:
    """Quantity per item, summed before it meets the menu."""
    return lines.groupBy("item_id").agg(F.sum("quantity").alias("moved"))


def lines_of(lines: DataFrame, ids: DataFrame) -> DataFrame:
    return lines.join(ids.select("order_id").distinct(), "order_id", "left_semi")


@owns_scratch
def deduct_stock(t: Tables, order_ids: DataFrame, as_of: object | None = None) -> Outcome:
    """Take the quantities of the given orders out of stock, each order once.

    Afterwards every item without stock is switched off, also one that none
    of the orders touched.  Orders of an item whose stock would leave the
    range of its column are refused.
    """
    asked = stored(lines_of(t.order_items, order_ids).select("order_id", "item_id", "quantity"), "asked-lines")
    crossed = stored(beyond_range(t.menu_items, asked, -1), "asked-refused")
    lines = asked if crossed.isEmpty() else asked.join(crossed, "order_id", "left_anti")
    joined = t.menu_items.join(_quantity_by_item(lines), "item_id", "left")
    moved = changed(
        joined, F.col("moved").isNotNull(), stock=F.col("stock") - F.col("moved"), updated_at=stamp(as_of)
    )
    menu = enforce_availability(moved.select(*t.menu_items.columns), as_of)
    wanted = order_ids.distinct()
    nothing = refused(wanted.join(asked.select("order_id"), "order_id", "left_anti"), "order_without_lines")
    off = refused(wanted.join(crossed, "order_id", "left_semi"), "stock_out_of_range")
    return Outcome(t.with_(menu_items=menu), nothing.unionByName(off))


def beyond_range(menu: DataFrame, lines: DataFrame, sign: int) -> DataFrame:
    """Orders (order_id) with an item whose stock the lines would move out of the range of its column.

    Gains and losses are held against the range apart, so the verdict stands
    whatever part of the orders is carried out.
    """
    moved = F.col("quantity").cast("bigint") * sign
    per_item = lines.groupBy("item_id").agg(
        F.sum(F.greatest(moved, F.lit(0))).alias("_gained"), F.sum(F.least(moved, F.lit(0))).alias("_lost")
    )
    stock = F.col("stock").cast("bigint")
    out = (stock + F.col("_gained") > COUNT_MOST) | (stock + F.col("_lost") < -COUNT_MOST - 1)
    items = menu.select("item_id", "stock").join(per_item, "item_id").where(out).select("item_id")
    return lines.join(items, "item_id", "left_semi").select("order_id").distinct()


def return_stock(menu: DataFrame, lines: DataFrame, as_of: object | None = None) -> DataFrame:
    """Put the quantities of the given lines back; touched items with stock come back on."""
    joined = menu.join(_quantity_by_item(lines), "item_id", "left")
    stock = F.col("stock") + F.col("moved")
    return changed(
        joined,
        F.col("moved").isNotNull(),
        stock=stock,
        is_available=_available_unless_empty(stock, F.lit(True)),
        updated_at=stamp(as_of),
    ).select(*menu.columns)


@owns_scratch
def set_stock(t: Tables, requests: DataFrame, as_of: object | None = None) -> Outcome:
    """Add to, set or reduce the stock of items: requests (item_id, mode, quantity).

    Modes are ``add``, ``set`` and ``reduce``.  A batch holds one request per
    item; several for the same item are all refused, since their order would
    decide the result.  A request without an item is refused as not found.
    """
    nowhere = refused(requests.where(F.col("item_id").isNull()), "item_not_found")
    requests = requests.where(F.col("item_id").isNotNull())
    fields = [c for c in requests.columns if c != "item_id"]
    per_item = requests.groupBy("item_id").agg(
        F.count("*").alias("_requests"), F.min(F.struct(*fields)).alias("_first")
    )
    single = per_item.where(F.col("_requests") == 1).select("item_id", *(f"_first.{c}" for c in fields))
    repeated = requests.join(per_item.where(F.col("_requests") > 1), "item_id", "left_semi")
    looked_up = single.join(
        t.menu_items.select("item_id", F.col("stock").alias("_stock"), F.lit(True).alias("_known")),
        "item_id",
        "left",
    )
    mode, quantity, stock = F.col("mode"), F.col("quantity"), F.col("_stock")
    relative = mode.isin("add", "reduce")
    wide = quantity.cast("bigint")
    target = F.when(mode == "set", wide).when(mode == "add", stock + wide).otherwise(stock - wide)
    accepted, rejected = judge(
        looked_up,
        {
            "item_not_found": F.col("_known").isNull(),
            "invalid_mode": mode.isNull() | ~mode.isin("add", "set", "reduce"),
            "invalid_quantity": quantity.isNull() | (quantity < F.when(relative, 1).otherwise(0)),
            "stock_unknown": relative & stock.isNull(),
            "insufficient_stock": (mode == "reduce") & (quantity > stock),
            "stock_out_of_range": target > COUNT_MOST,
        },
    )
    joined = t.menu_items.join(accepted.select("item_id", target.alias("_target")), "item_id", "left")
    new = F.col("_target")
    menu = changed(
        joined,
        new.isNotNull(),
        stock=new,
        is_available=_available_unless_empty(new, F.col("is_available")),
        updated_at=stamp(as_of),
    ).select(*t.menu_items.columns)
    rejects = rejected.select(*requests.columns, "reason").unionByName(
        refused(repeated.select(*requests.columns), "duplicate_request")
    ).unionByName(nowhere)
    return Outcome(t.with_(menu_items=menu), rejects)


@owns_scratch
def delete_menu_items(t: Tables, item_ids: DataFrame, as_of: object | None = None) -> Outcome:
    """Drop items that never sold; switch off and empty the ones that did.

    ``done`` tells per item which of the two happened.
    """
    wanted = item_ids.select("item_id").distinct()
    sold = t.order_items.select("item_id").join(wanted, "item_id", "left_semi").distinct().withColumn("_sold", F.lit(True))
    known = t.menu_items.select("item_id").join(wanted, "item_id", "left_semi").join(sold, "item_id", "left")
    plan = known.select("item_id", F.coalesce("_sold", F.lit(False)).alias("_sold"))
    joined = t.menu_items.join(plan, "item_id", "left").where(F.coalesce("_sold", F.lit(True)))
    menu = changed(
        joined,
        F.col("_sold"),
        stock=F.lit(0),
        is_available=F.lit(False),
        updated_at=stamp(as_of),
    ).select(*t.menu_items.columns)
    # The messages of both kinds of delete.
    kept = message("Menu item ", F.col("item_id"), " marked as unavailable (has order history)")
    gone = message("Menu item ", F.col("item_id"), " deleted successfully")
    done = plan.select(
        "item_id",
        F.when(F.col("_sold"), "soft").otherwise("hard").alias("action"),
        F.when(F.col("_sold"), kept).otherwise(gone).alias("message"),
    )
    rejects = refused(wanted.join(t.menu_items.select("item_id"), "item_id", "left_anti"), "item_not_found")
    return Outcome(t.with_(menu_items=menu), rejects, done)


@owns_scratch
def restore_items(t: Tables, item_ids: DataFrame, as_of: object | None = None) -> Outcome:
    """Switch items on again; without stock that does not hold, so it is refused."""
    wanted = item_ids.select("item_id").distinct().withColumn("_wanted", F.lit(True))
    joined = t.menu_items.join(wanted, "item_id", "left")
    stocked = F.coalesce(F.col("stock") > 0, F.lit(True))
    menu = changed(
        joined, F.col("_wanted") & stocked, is_available=F.lit(True), updated_at=stamp(as_of)
    ).select(*t.menu_items.columns)
    stock = t.menu_items.select("item_id", stocked.alias("_stocked"))
    _, rejected = judge(
        wanted.join(stock, "item_id", "left"),
        {"item_not_found": F.col("_stocked").isNull(), "out_of_stock": ~F.col("_stocked")},
    )
    return Outcome(t.with_(menu_items=menu), rejected.select("item_id", "reason"))


@owns_scratch
def insert_menu_items(
    t: Tables, new: DataFrame, as_of: object | None = None, order: Sequence[str] = ("request_id",)
) -> Outcome:
    """Add menu items; refuses missing names, unknown categories and figures off the form.

    A new item may be available without stock: availability is only enforced
    when an item changes.
    """
    filled = new
    for column, value in DEFAULTS["menu_items"].items():
        present = F.col(column) if column in new.columns else F.lit(None)
        filled = filled.withColumn(column, F.coalesce(present, F.lit(value)))
    looked_up = filled.join(
        t.categories.select("category_id", F.lit(True).alias("_known")), "category_id", "left"
    )
    accepted, rejected = judge(
        looked_up,
        {
            "missing_field": F.coalesce(F.trim("item_name") == "", F.lit(True)) | F.col("price").isNull(),
            "category_not_found": F.col("_known").isNull(),
            "invalid_price": F.col("price") < 1,
            "invalid_stock": F.col("stock") < 0,
            "invalid_preparation_time": F.col("preparation_time_minutes") < 1,
        },
    )
    numbered = with_position(accepted.drop("_known"), *order).withColumn(
        "item_id", F.col("position") + next_id(t, "menu_items")
    )
    rows = numbered.withColumn("created_at", F.lit(as_of)).withColumn("updated_at", F.lit(as_of))
    menu = t.menu_items.unionByName(fit_to(t.menu_items, rows))
    done = numbered.select(*order, "item_id")
    return Outcome(t.with_(menu_items=menu), rejected.select(*new.columns, "reason"), done)
