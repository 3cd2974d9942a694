"""Placing, extending, deleting and purging orders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platter.functions.expressions import line_amount, message
from platter.operators.base import Outcome, changed, fit_to, judge, next_id, owns_scratch, refused, stamp
from platter.operators.sequence import CHUNK_ROWS, with_position
from platter.operators.stock import beyond_range, lines_of, return_stock
from platter.schema import COUNT_MOST, MONEY_MOST, PAYMENT_METHODS, PENDING_NARROW, TOTAL, Tables
from platter.session import stored, when_read


def derive_subtotal(lines: DataFrame) -> DataFrame:
    """Set subtotal = unit price x quantity on new lines, whatever was supplied."""
    return lines.withColumn("subtotal", line_amount())


def _quantity_rules(stock: str) -> dict:
    quantity = F.col("quantity")
    return {
        "invalid_quantity": quantity.isNull() | (quantity < 1),
        "insufficient_stock": quantity > F.col(stock),
    }


@owns_scratch
def place_orders(
    t: Tables, requests: DataFrame, as_of: object | None = None, chunk_rows: int = CHUNK_ROWS
) -> Outcome:
    """One order with one line per request; every request is judged by the same snapshot.

    Requests are (request_id, user_id, payment_method, item_id, quantity
    [, special_requests]).  Placing takes neither stock nor money.  Ids are
    dense and follow the order of ``request_id``.
    """
    users = t.users.select("user_id", F.col("wallet_balance").alias("_balance"), F.lit(True).alias("_user"))
    items = t.menu_items.select(
        "item_id",
        F.col("price").alias("unit_price"),
        F.col("stock").alias("_stock"),
        F.coalesce(F.col("is_available") & (F.col("stock") > 0), F.lit(False)).alias("_orderable"),
    )
    looked_up = requests.join(items, "item_id", "left").join(users, "user_id", "left")
    total = F.col("unit_price") * F.col("quantity")
    accepted, rejected = judge(
        looked_up,
        {
            "user_not_found": F.col("_user").isNull(),
            "item_not_found": F.col("_orderable").isNull(),
            "invalid_payment_method": F.col("payment_method").isNull()
            | ~F.col("payment_method").isin(*PAYMENT_METHODS),
            "item_unavailable": ~F.col("_orderable"),
            **_quantity_rules("_stock"),
            "insufficient_balance": (F.col("payment_method") == "wallet")
            & (F.coalesce("_balance", F.lit(0)) < total),
            "amount_out_of_range": total > F.lit(MONEY_MOST),
        },
    )
    accepted = accepted.drop("_user", "_orderable", "_stock", "_balance")
    numbered = with_position(accepted, "request_id", chunk_rows=chunk_rows)
    placed = derive_subtotal(numbered).withColumns(
        {
            "order_id": F.col("position") + next_id(t, "orders"),
            "order_item_id": F.col("position") + next_id(t, "order_items"),
        }
    )
    now = F.lit(as_of)
    headers = placed.select(
        "order_id",
        "user_id",
        F.col("subtotal").alias("total_amount"),
        F.lit("pending").alias("order_status"),
        "payment_method",
        F.lit("pending").alias("payment_status"),
        now.alias("order_date"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    after = t.with_(
        orders=t.orders.unionByName(fit_to(t.orders, headers)),
        order_items=t.order_items.unionByName(fit_to(t.order_items, placed)),
    )
    done = placed.select("request_id", "order_id", F.col("subtotal").alias("total_amount"))
    return Outcome(after, rejected.select(*requests.columns, "reason"), done)


def with_line_totals(orders: DataFrame, lines: DataFrame, as_of: object | None = None) -> DataFrame:
    """Orders whose total is reset to the sum of the given lines (order_id, subtotal); others unchanged."""
    return _with_totals(orders, lines.groupBy("order_id").agg(F.sum("subtotal").cast(TOTAL).alias("_total")), as_of)


def _with_totals(orders: DataFrame, totals: DataFrame, as_of: object | None) -> DataFrame:
    joined = orders.join(totals, "order_id", "left")
    total = F.col("_total")
    return changed(joined, total.isNotNull(), total_amount=total, updated_at=stamp(as_of)).select(*orders.columns)


def _wide_amount(price: str, quantity: Column) -> Column:
    """Price times quantity with room for figures that no column of a line holds."""
    return F.col(price).cast("decimal(10,2)") * quantity.cast("decimal(20,0)")


def _orders_beyond(merged: DataFrame, fresh: DataFrame) -> DataFrame:
    """Orders (order_id) that would get a quantity, an amount of a line or a total out of the range of its column."""
    grown = F.col("quantity").cast("bigint") + F.col("_added")
    old = merged.select(
        "order_id",
        F.coalesce(grown, F.col("quantity").cast("bigint")).alias("quantity"),
        F.coalesce(_wide_amount("unit_price", grown), F.col("subtotal")).cast("decimal(32,2)").alias("amount"),
    )
    new = fresh.select(
        "order_id", F.col("quantity").cast("bigint"), _wide_amount("unit_price", F.col("quantity")).cast("decimal(32,2)").alias("amount")
    )
    figures = old.unionByName(new).groupBy("order_id").agg(
        F.max("quantity").alias("quantity"), F.max("amount").alias("amount"), F.sum("amount").alias("total")
    )
    most = F.lit(MONEY_MOST)
    return figures.where((F.col("quantity") > COUNT_MOST) | (F.col("amount") > most) | (F.col("total") > most)).select("order_id")


def _positive(*factors: str) -> Column:
    return reduce(lambda a, b: a * b, (F.greatest(F.col(c).cast("double"), F.lit(0.0)) for c in factors))


def _held(lines: DataFrame, by: Column) -> DataFrame:
    """Bounds of what the lines hold, per ``by``: the most of a quantity, sums of prices and amounts."""
    return lines.groupBy(by).agg(
        F.max("quantity").alias("_quantity"),
        F.sum(_positive("unit_price")).alias("_prices"),
        F.sum(_positive("subtotal") + _positive("unit_price", "quantity")).alias("_amounts"),
    )


def _past_bounds(asked: DataFrame, held: DataFrame, by: str) -> DataFrame:
    """``by`` of what may leave the range of a column; ``asked`` has the ``_most`` that is added to an item and the ``_fresh`` amounts."""
    # Without lines or prices the greatest of null and 0 is 0.
    total = _positive("_amounts") + _positive("_prices", "_most") + _positive("_fresh")
    quantity = _positive("_quantity") + F.col("_most")
    beyond = (quantity > COUNT_MOST) | (total > 0.999 * float(MONEY_MOST))
    return asked.join(held, by, "left").where(beyond).select(by)


def _orders_suspect(near: DataFrame, added: DataFrame) -> DataFrame:
    """Orders (order_id) whose figures may leave the range of their column, and all that do.

    Bounds per order from sums and maxima alone: no line can grow by more than the most that is added to one
    item, and terms below zero count as none. So lines and additions need not meet by item. The sums are
    doubles, held against a limit that is lower by far more than they round.
    """

    asked = added.groupBy("order_id").agg(F.max("_added").alias("_most"), F.sum(_positive("_price", "_added")).alias("_fresh"))
    return _past_bounds(asked, _held(near, F.col("order_id")), "order_id")


# Blocks of 8 ids, whose sums bound each of their orders.
_BOUND = "shiftright(CAST(order_id AS bigint), 3)"


def _asked_by_bound(requests: DataFrame) -> DataFrame:
    """(_bound, _most): all that is asked for in a block of orders, refused or not."""
    named = requests.where("order_id IS NOT NULL")
    return named.groupBy(F.expr(_BOUND).alias("_bound")).agg(F.sum(_positive("quantity")).alias("_most"))


def _bounds_suspect(lines: DataFrame, asked: DataFrame, items: DataFrame) -> DataFrame:
    """Blocks (_bound) that hold all orders of ``_orders_suspect``.

    What is asked of a block is no less than what is added to any of its orders, at no more than the highest
    price. So neither lines nor requests need to be dealt out by order, and no request to be judged.
    """
    dearest = items.agg(F.coalesce(F.max(_positive("_price")), F.lit(0.0))).scalar()
    asked = asked.withColumn("_fresh", F.col("_most") * dearest)
    return _past_bounds(asked, _held(lines, F.expr(_BOUND).alias("_bound")), "_bound")


def _of_bounds(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    return rows.join(bounds, F.expr(f"_bound = {_BOUND}"), "left_semi")


# Where an order stands among blocks of 64 ids.
_BLOCK = "shiftright(CAST(order_id AS bigint), 6)"
_PLACE = "CAST(CAST(order_id AS bigint) & 63L AS int)"


def _id_blocks(rows: DataFrame) -> DataFrame:
    """The orders of some rows as one bit each: (_block, _ids). Ids that lie close take few rows."""
    return rows.groupBy(F.expr(_BLOCK).alias("_block")).agg(F.expr(f"bit_or(shiftleft(1L, {_PLACE}))").alias("_ids"))


def _in_both(blocks: DataFrame, others: DataFrame) -> DataFrame:
    """The orders that stand in both frames of ``_id_blocks``."""
    shared = F.col("_ids").bitwiseAND(F.col("_others"))
    return blocks.join(others.withColumnRenamed("_ids", "_others"), "_block").select("_block", shared.alias("_ids")).where("_ids <> 0")


def _of_blocks(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """``lines`` of the orders in ``blocks``, a written table; they stay where they are unless it has very many rows."""
    if blocks.count() <= SENT_BLOCKS:
        blocks = F.broadcast(blocks)
    return lines.join(blocks, F.expr(f"_block = {_BLOCK} AND bit_get(_ids, {_PLACE}) = 1"), "left_semi")


_LINE_KEYS = ["order_id", "item_id"]

# Batches over more blocks of 8 ids are held against bounds of the blocks before their lines are narrowed.
LARGE_BATCH = 10_000
# Rows of id bits (64 orders each, where ids are dense) that are sent to all tasks, about 64 MB there.
SENT_BLOCKS = 1 << 20


def _fresh(near: DataFrame, added: DataFrame) -> DataFrame:
    """What is added to items that have no line yet."""
    return added.join(near.select(*_LINE_KEYS), _LINE_KEYS, "left_anti").select(
        *_LINE_KEYS, F.col("_added").alias("quantity"), F.col("_price").alias("unit_price")
    )


def _new_subtotals(near: DataFrame, added: DataFrame) -> DataFrame:
    """(order_id, subtotal) of all lines of the orders that are added to, as they are afterwards."""
    met = near.withColumn("_line", F.lit(True)).join(added, _LINE_KEYS, "full")
    subtotal = (
        F.when(F.col("_added").isNull(), F.col("subtotal"))
        .when(F.col("_line"), line_amount("unit_price", F.col("quantity") + F.col("_added")))
        .otherwise(line_amount("_price", "_added"))
    )
    return met.select("order_id", subtotal.alias("subtotal"))


def _new_totals(near: DataFrame, asked: DataFrame, opened: DataFrame) -> DataFrame:
    """(order_id, _total) of the orders that are added to, from lines and requests that are dealt out once, by order.

    ``asked`` are requests that the menu lets in, at its ``_price``; ``opened`` holds how often an order stands
    among the open ones (``_times``), which multiplies what is added to it. What the order holds is the old
    amount of each line, as price x quantity where the line grows.
    """
    line, quantity = F.col("_line"), F.col("quantity")
    columns = [*_LINE_KEYS, quantity.cast("bigint").alias("quantity")]
    old = near.select(*columns, "unit_price", "subtotal", F.lit(True).alias("_line"))
    new = asked.select(*columns, F.col("_price").alias("unit_price"), F.lit(None).alias("subtotal"), F.lit(False).alias("_line"))
    same = Window.partitionBy(*_LINE_KEYS)
    met = old.unionByName(new).repartition("order_id").withColumns(
        {
            "_added": F.sum(F.when(~line, quantity)).over(same),
            "_price": F.max(F.when(~line, F.col("unit_price"))).over(same),
            "_known": F.max(line).over(same),
        }
    )
    held = F.when(F.col("_added").isNull(), F.col("subtotal")).otherwise(_wide_amount("unit_price", quantity))
    gain = F.when(line, F.when(quantity.isNotNull(), _wide_amount("unit_price", F.col("_added"))))
    gain = gain.when(~F.col("_known"), _wide_amount("_price", quantity))
    sums = met.groupBy("order_id").agg(
        F.sum(F.when(line, held)).alias("_held"), F.sum(gain).alias("_gain"), F.count("_added").alias("_requests")
    )
    gained = F.col("_gain") * F.col("_times")
    total = F.coalesce(F.col("_held") + gained, F.col("_held"), gained)
    return sums.where("_requests > 0").join(opened, "order_id").select("order_id", total.cast(TOTAL).alias("_total"))


@owns_scratch
def add_items_to_orders(
    t: Tables,
    requests: DataFrame,
    as_of: object | None = None,
    statuses: Sequence[str] = PENDING_NARROW,
    chunk_rows: int = CHUNK_ROWS,
) -> Outcome:
    """Add (order_id, item_id, quantity) to open orders and reset their totals.

    Quantities for the same order and item are summed first.  A line that
    exists keeps its own unit price, a new line takes the price of today.
    Lines are narrowed to the orders of the batch before anything else is
    done with them; the others pass through.  All requests for an order are refused if one
    of its figures would leave the range of its column.

    Each result costs its own joins only: new lines are numbered once the
    lines are read, totals are summed once the orders are, and requests are
    judged for their reasons once the rejects are.  In a large batch bounds
    per block of orders come first, and only blocks past them are narrowed
    and judged to find the orders that are refused; totals deal out requests
    as they are, and need no additions that were summed and written before.
    """
    items = t.menu_items.select(
        "item_id",
        F.col("price").alias("_price"),
        F.col("stock").alias("_stock"),
        F.coalesce(F.col("is_available") & (F.col("stock") > 0), F.lit(False)).alias("_orderable"),
    )
    headers = t.orders.select("order_id", F.coalesce("order_status", F.lit("")).alias("_status"))
    is_open = F.col("_status").isin(*statuses)
    item_rules = {
        "item_not_found": F.col("_orderable").isNull(),
        "item_unavailable": ~F.col("_orderable"),
        **_quantity_rules("_stock"),
    }

    def on_menu(asked: DataFrame) -> DataFrame:
        return judge(asked.join(items, "item_id"), item_rules)[0]

    def let_in(asked: DataFrame) -> DataFrame:
        """Only open orders are met, by requests that name items: no refused row is carried on."""
        return on_menu(asked.join(headers.where(is_open).drop("_status"), "order_id"))

    def additions(asked: DataFrame) -> DataFrame:
        grouped = let_in(asked.select(*_LINE_KEYS, "quantity")).groupBy(*_LINE_KEYS)
        return grouped.agg(F.sum("quantity").alias("_added"), F.max("_price").alias("_price"))

    keys = _LINE_KEYS
    figures = t.order_items.select(*keys, "quantity", "unit_price", "subtotal")
    asked = stored(_asked_by_bound(requests), "asked-bounds")
    large = asked.count() > LARGE_BATCH

    @cache
    def open_blocks() -> DataFrame:
        return stored(_in_both(_id_blocks(headers.where(is_open)), _id_blocks(requests)), "open-blocks")

    @cache
    def all_added() -> DataFrame:
        # Of a large batch only requests for open orders are dealt out.
        return stored(additions(_of_blocks(requests, open_blocks()) if large else requests), "added")

    @cache
    def all_near() -> DataFrame:
        near = _of_blocks(figures, stored(_id_blocks(all_added()), "touched-blocks"))
        return near if large else stored(near, "touched-lines")

    checked = None
    if not large:
        checked = all_near(), all_added()
    else:
        bounds = stored(_bounds_suspect(figures, asked, items), "suspect-bounds")
        if not bounds.isEmpty():
            checked = _of_bounds(figures, bounds), stored(additions(_of_bounds(requests, bounds)), "suspect-added")
    beyond = None
    if checked:
        suspect = stored(_orders_suspect(*checked), "suspect-orders")
        if not suspect.isEmpty():
            narrowed = [frame.join(suspect, "order_id", "left_semi") for frame in checked]
            merged = narrowed[0].join(narrowed[1], keys, "left")
            found = stored(_orders_beyond(merged, _fresh(*narrowed)), "beyond-range")
            beyond = None if found.isEmpty() else found

    wanted = requests.select("order_id").distinct()
    known = headers.join(wanted, "order_id", "left_semi")
    # The headers first: they go by few columns of a request, the menu is often small enough to be sent around.
    _, rejects = judge(
        requests.join(known, "order_id", "left").join(items, "item_id", "left"),
        {"order_not_found": F.col("_status").isNull(), "order_not_open": ~is_open, **item_rules},
    )
    parts = [rejects.select(*requests.columns, "reason")]
    if beyond is not None:
        off = let_in(requests.join(beyond, "order_id", "left_semi"))
        parts.append(refused(off.select(*requests.columns), "amount_out_of_range"))
    rejects = reduce(DataFrame.unionByName, parts)

    def in_range(frame: DataFrame) -> DataFrame:
        return frame if beyond is None else frame.join(beyond, "order_id", "left_anti")

    def lines() -> DataFrame:
        near, added = in_range(all_near()), in_range(all_added())
        grown = F.col("quantity") + F.col("_added")
        kept = changed(
            t.order_items.join(added.drop("_price"), keys, "left"),
            F.col("_added").isNotNull(),
            quantity=grown,
            subtotal=line_amount("unit_price", grown),
        ).select(*t.order_items.columns)
        numbered = with_position(_fresh(near, added), *keys, chunk_rows=chunk_rows)
        fresh = derive_subtotal(numbered).withColumn("order_item_id", F.col("position") + next_id(t, "order_items"))
        return kept.unionByName(fit_to(t.order_items, fresh))

    def orders() -> DataFrame:
        if not large:
            return with_line_totals(t.orders, _new_subtotals(in_range(all_near()), in_range(all_added())), as_of)
        near, some = (_of_blocks(frame, open_blocks()) for frame in (figures, requests.select(*keys, "quantity")))
        opened = headers.where(is_open).groupBy("order_id").agg(F.count("*").alias("_times"))
        return _with_totals(t.orders, _new_totals(near, on_menu(in_range(some)), opened), as_of)

    return Outcome(t.with_(orders=when_read(orders), order_items=when_read(lines)), rejects)


@owns_scratch
def delete_orders(t: Tables, order_ids: DataFrame, as_of: object | None = None) -> Outcome:
    """Delete orders with their lines, put the stock back, refund paid wallet orders.

    Orders are refused if the stock of one of their items, or all refunds of
    their user together, would leave the range of the column.
    """
    wanted = order_ids.select("order_id").distinct()
    header = t.orders.select("order_id", "user_id", "total_amount", "payment_status", "payment_method")
    known = stored(header.join(wanted, "order_id", "left_semi"), "doomed-orders")
    asked = stored(lines_of(t.order_items, known).select("order_id", "item_id", "quantity"), "doomed-lines")
    crossed = beyond_range(t.menu_items, asked, 1)
    paid_back = (F.col("payment_status") == "completed") & (F.col("payment_method") == "wallet")
    gains = known.where(paid_back).groupBy("user_id").agg(F.sum(F.greatest("total_amount", F.lit(0))).alias("_most"))
    rich = t.users.select("user_id", "wallet_balance").join(gains, "user_id").where(
        F.col("wallet_balance") + F.col("_most") > F.lit(MONEY_MOST)
    )
    overpaid = known.where(paid_back).join(rich.select("user_id"), "user_id", "left_semi").select("order_id")
    off = refused(crossed, "stock_out_of_range").unionByName(
        refused(overpaid.join(crossed, "order_id", "left_anti"), "refund_out_of_range")
    )
    off = stored(off, "doomed-refused")
    doomed, returned = known, asked
    if not off.isEmpty():
        doomed = known.join(off.select("order_id"), "order_id", "left_anti")
        returned = asked.join(off.select("order_id"), "order_id", "left_anti")
    ids = doomed.select("order_id")

    menu = return_stock(t.menu_items, returned, as_of)
    refunds = (
        doomed.where(paid_back)
        .groupBy("user_id")
        .agg(F.sum("total_amount").alias("_refund"))
    )
    users = changed(
        t.users.join(refunds, "user_id", "left"),
        F.col("_refund").isNotNull(),
        wallet_balance=F.col("wallet_balance") + F.col("_refund"),
        updated_at=stamp(as_of),
    ).select(*t.users.columns)
    after = t.with_(
        users=users,
        menu_items=menu,
        orders=t.orders.join(ids, "order_id", "left_anti"),
        order_items=t.order_items.join(ids, "order_id", "left_anti"),
    )
    # Fixed value: the message of a delete.
    done = ids.select("order_id", message("Order ", F.col("order_id"), " deleted successfully").alias("message"))
    rejects = refused(wanted.join(known, "order_id", "left_anti"), "order_not_found").unionByName(off)
    return Outcome(after, rejects, done)


@owns_scratch
def purge_cancelled(t: Tables) -> Outcome:
    """Drop cancelled orders and their lines; stock and wallets stay as they are."""
    cancelled = F.coalesce(F.col("order_status") == "cancelled", F.lit(False))
    gone = t.orders.where(cancelled).select("order_id")
    after = t.with_(
        orders=t.orders.where(~cancelled),
        order_items=t.order_items.join(gone, "order_id", "left_anti"),
    )
    return Outcome(after)
