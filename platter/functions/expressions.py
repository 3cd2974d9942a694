"""Column expressions shared by the reports; all are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from platter.schema import EMAIL_PATTERN, LOW_STOCK, MONEY, PHONE_PATTERN, TOTAL


def contains_text(term: str, *columns: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` stand for themselves."""
    needle = F.lit(term.lower())
    return reduce(lambda a, b: a | b, (F.lower(F.col(c)).contains(needle) for c in columns))


def all_of(conditions: Iterable[Column | None]) -> Column:
    """Conjunction of the conditions that are present; true if none is."""
    return reduce(lambda a, b: a & b, (c for c in conditions if c is not None), F.lit(True))


def on_day(column: str, day: date) -> Column:
    """The timestamp falls on ``day``, as a range that reaches the file scan."""
    c = F.col(column)
    return (c >= F.lit(day)) & (c < F.lit(day + timedelta(days=1)))


def money_sum(column: str | Column) -> Column:
    return F.sum(column).cast(TOTAL)


def mean(column: str | Column) -> Column:
    """Mean as a double: the exact decimal sum divided once."""
    value = F.col(column) if isinstance(column, str) else column
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))


def line_amount(price: str | Column = "unit_price", quantity: str | Column = "quantity") -> Column:
    """price x quantity as money."""
    price = F.col(price) if isinstance(price, str) else price
    quantity = F.col(quantity) if isinstance(quantity, str) else quantity
    return (price * quantity).cast(MONEY)


def stock_status(stock: str = "stock", low: int = LOW_STOCK) -> Column:
    """Stock label: out of stock, low (n) or good (n)."""
    n = F.col(stock)
    text = n.cast("string")
    return (
        F.when(n <= 0, F.lit("Out of Stock"))
        .when(n <= low, F.concat(F.lit("Low ("), text, F.lit(")")))
        .when(n.isNotNull(), F.concat(F.lit("Good ("), text, F.lit(")")))
    )


def money_text(amount: str | Column, null_as_zero: bool = False) -> Column:
    """``₹`` and two decimals; null stays null unless it should show as zero."""
    value = F.col(amount) if isinstance(amount, str) else amount
    if null_as_zero:
        value = F.coalesce(value, F.lit(0))
    return F.concat(F.lit("₹"), value.cast(TOTAL).cast("string"))


def yes_no(condition: Column) -> Column:
    return F.when(condition, F.lit("Yes")).otherwise(F.lit("No"))


def delete_type(order_count: str = "order_count") -> Column:
    return F.when(F.col(order_count) > 0, F.lit("Soft Delete")).otherwise(F.lit("Hard Delete"))


def status_label(column: str = "order_status") -> Column:
    return F.upper(F.col(column))


def valid_email(column: str = "email") -> Column:
    return F.col(column).rlike(EMAIL_PATTERN)


def valid_phone(column: str = "phone") -> Column:
    return F.col(column).rlike(PHONE_PATTERN)


def message(*parts: str | Column) -> Column:
    """Text made of literals and columns of any type."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
