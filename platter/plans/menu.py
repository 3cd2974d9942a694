"""Menu, stock and item sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.functions.expressions import all_of, contains_text, delete_type, line_amount, mean, stock_status
from platter.functions.expressions import money_sum
from platter.plans.views import count_where, item_totals, latest_first, popular_items, top, with_category
from platter.schema import LOW_STOCK, TOTAL, Tables

BY_CATEGORY = ("category_name", "item_name", "item_id")


def _menu(t: Tables) -> DataFrame:
    return with_category(t.menu_items, t.categories)


def best_sellers(t: Tables, k: int | None = 10) -> DataFrame:
    """Items by quantity sold; revenue is today's price times that quantity."""
    revenue = (F.col("price") * F.col("total_quantity_sold")).cast(TOTAL)
    return top(
        popular_items(t).withColumn("revenue", revenue), k, F.col("total_quantity_sold").desc(), F.col("item_id")
    )


def top_items_by_sales(t: Tables, k: int | None = 5) -> DataFrame:
    """Items by what their lines were sold for."""
    return top(
        item_totals(t.order_items)
        .join(t.menu_items.select("item_id", "item_name"), "item_id")
        .select("item_id", "item_name", "total_sales"),
        k,
        F.col("total_sales").desc(),
        F.col("item_id"),
    )


def active_categories(t: Tables) -> DataFrame:
    return t.categories.where("is_active").select("category_id", "category_name")


def menu_listing(
    t: Tables, term: str | None = None, category: str | None = None, available: bool | None = None
) -> DataFrame:
    """The menu with stock labels, optionally narrowed by text, category or availability."""
    wanted = all_of(
        [
            contains_text(term, "item_name") if term else None,
            F.col("category_name") == category if category else None,
            F.col("is_available") == available if available is not None else None,
        ]
    )
    return (
        _menu(t)
        .where(wanted)
        .select(
            "item_id",
            "item_name",
            "category_name",
            "description",
            "price",
            "stock",
            "is_available",
            "preparation_time_minutes",
            "created_at",
            stock_status().alias("stock_status"),
        )
        .orderBy(*BY_CATEGORY)
    )


def low_stock(t: Tables, threshold: int = LOW_STOCK, include_zero: bool = False, k: int | None = 5) -> DataFrame:
    """Items at or below the threshold; ``include_zero`` also lists empty and negative stock."""
    stock = F.col("stock")
    wanted = (stock <= threshold) if include_zero else (stock > 0) & (stock <= threshold)
    return top(
        t.menu_items.where(wanted).select("item_id", "item_name", "stock", "is_available"), k, stock, F.col("item_id")
    )


def out_of_stock(t: Tables, k: int | None = 5) -> DataFrame:
    """Items whose stock is exactly zero."""
    empty = with_category(t.menu_items.where(F.col("stock") == 0), t.categories)
    return top(empty, k, F.col("item_id")).select("item_id", "item_name", "category_name")


def stock_list(t: Tables) -> DataFrame:
    return _menu(t).select("item_id", "item_name", "category_name", "stock", "is_available").orderBy(*BY_CATEGORY)


def orderable_items(t: Tables) -> DataFrame:
    """Items that can be ordered now."""
    ready = t.menu_items.where(F.col("is_available") & (F.col("stock") > 0))
    return (
        with_category(ready, t.categories)
        .select("item_id", "item_name", "category_name", "price", "stock", "is_available")
        .orderBy(*BY_CATEGORY)
    )


def sales_by_category(t: Tables) -> DataFrame:
    """Distinct orders, quantity and revenue per category, every order included.

    The figures are made per category id; the names join the few result rows.
    """
    figures = (
        t.order_items.join(t.menu_items.select("item_id", "category_id"), "item_id")
        .groupBy("category_id")
        .agg(
            F.countDistinct("order_id").alias("order_count"),
            F.sum("quantity").cast("bigint").alias("total_quantity"),
            money_sum("subtotal").alias("total_revenue"),
        )
    )
    return (
        with_category(figures, t.categories)
        .orderBy(F.col("total_revenue").desc(), "category_id")
        .select("category_name", "order_count", "total_quantity", "total_revenue")
    )


def category_statistics(t: Tables) -> DataFrame:
    """Items, orders, quantity, revenue and price range per category, unsold items included.

    ``avg_item_price`` weighs an item by its lines (one if it never sold);
    ``mean_list_price`` counts every item once.  The lines are scanned and shuffled once:
    grouped by (category, order) to count orders and, in the same step, by (category, item) for
    the sums, which are partial sums by the time they leave the map tasks.
    What unsold items add comes from the menu alone.
    """
    items = t.menu_items.select("item_id", "category_id", "price")
    sold = t.order_items.select("item_id", "order_id", "quantity", "subtotal").join(items, "item_id")
    by_order, by_item = ([F.col("category_id"), F.col(c)] for c in ("order_id", "item_id"))
    pairs = sold.groupingSets([by_order, by_item], "category_id", "order_id", "item_id").agg(
        F.grouping("item_id").alias("of_order"),
        F.count("*").alias("lines"),
        F.sum("quantity").alias("quantity"),
        F.sum("subtotal").alias("subtotal"),
        F.max("price").alias("price"),
    )
    item = F.col("of_order") == 0
    sales = pairs.groupBy("category_id").agg(
        count_where(~item).alias("order_count"),
        count_where(item).alias("sold_items"),
        F.sum(F.when(item, F.col("lines"))).alias("lines"),
        F.sum(F.when(item, F.col("quantity"))).cast("bigint").alias("total_quantity_sold"),
        F.sum(F.when(item, F.col("subtotal"))).cast(TOTAL).alias("total_revenue"),
        F.sum(F.when(item, F.col("price") * F.col("lines"))).alias("line_prices"),
        F.sum(F.when(item, F.col("price"))).alias("sold_prices"),
    )
    listed = items.groupBy("category_id").agg(
        F.count("*").alias("item_count"),
        F.sum("price").alias("prices"),
        mean("price").alias("mean_list_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )

    def or_none(name: str) -> Column:
        return F.coalesce(name, F.lit(0))

    weighed = F.col("prices") - or_none("sold_prices") + or_none("line_prices")
    weight = F.col("item_count") - or_none("sold_items") + or_none("lines")
    return (
        t.categories.select("category_id", "category_name")
        .join(listed, "category_id")
        .join(sales, "category_id", "left")
        .orderBy(F.col("total_revenue").desc(), "category_id")
        .select(
            "category_name",
            "item_count",
            or_none("order_count").alias("order_count"),
            "total_quantity_sold",
            "total_revenue",
            (weighed.cast("double") / weight.cast("double")).alias("avg_item_price"),
            "mean_list_price",
            "min_price",
            "max_price",
        )
    )


def never_ordered(t: Tables) -> DataFrame:
    """Items without a single line."""
    unsold = t.menu_items.join(t.order_items.select("item_id").distinct(), "item_id", "left_anti")
    return with_category(unsold, t.categories).select("item_id", "item_name", "category_name", "price", "stock")


def menu_with_history(t: Tables) -> DataFrame:
    """The menu with the number of lines per item and how a delete would act."""
    history = t.order_items.groupBy("item_id").agg(F.count("*").alias("order_count"))
    return (
        _menu(t)
        .join(history, "item_id", "left")
        .withColumn("order_count", F.coalesce("order_count", F.lit(0)))
        .select(
            "item_id",
            "item_name",
            "category_name",
            "price",
            "stock",
            "is_available",
            "order_count",
            delete_type().alias("delete_type"),
        )
        .orderBy(*BY_CATEGORY)
    )


def unavailable_items(t: Tables, k: int | None = 10) -> DataFrame:
    """Items switched off, the latest change first."""
    off = with_category(t.menu_items.where(~F.col("is_available")), t.categories)
    return top(
        off.select("item_id", "item_name", "category_name", "stock", "updated_at"),
        k,
        *latest_first("updated_at", "item_id"),
    )


def order_preview(requests: DataFrame, menu: DataFrame) -> DataFrame:
    """What each requested (item_id, quantity) would cost at today's price; null for an unknown item."""
    return requests.join(menu.select("item_id", "price"), "item_id", "left").withColumn(
        "order_total", line_amount("price", "quantity")
    )
