"""Table schemas, enum domains and the snapshot container."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
PRICE = T.DecimalType(8, 2)
TOTAL = T.DecimalType(20, 2)

# The most that a money column and a count column hold.
MONEY_MOST = Decimal("99999999.99")
COUNT_MOST = 2**31 - 1

# The domains of the enum columns.
USER_TYPES = ("student", "faculty", "staff")
ORDER_STATUSES = ("pending", "confirmed", "preparing", "ready", "completed", "cancelled")
PAYMENT_METHODS = ("wallet", "cash", "upi", "card")
PAYMENT_STATUSES = ("pending", "completed", "failed", "refunded")

# Which order statuses count as pending on which report.
PENDING_NARROW = ("pending", "confirmed")
PENDING_WIDE = ("pending", "confirmed", "preparing")
TERMINAL = ("completed", "cancelled")

# The accepted e-mail and phone formats.
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
PHONE_PATTERN = r"^[0-9]{10}$"

LOW_STOCK = 5


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


_ID, _INT, _STR, _TS, _BOOL = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampType(), T.BooleanType()

USERS = _struct(
    ("user_id", _ID, False),
    ("srn", _STR, False),
    ("name", _STR, False),
    ("email", _STR, False),
    ("phone", _STR, True),
    ("user_type", _STR, False),
    ("wallet_balance", MONEY, True),
    ("created_at", _TS, True),
    ("updated_at", _TS, True),
)

CATEGORIES = _struct(
    ("category_id", _ID, False),
    ("category_name", _STR, False),
    ("description", _STR, True),
    ("is_active", _BOOL, True),
    ("created_at", _TS, True),
)

MENU_ITEMS = _struct(
    ("item_id", _ID, False),
    ("category_id", _ID, False),
    ("item_name", _STR, False),
    ("description", _STR, True),
    ("price", PRICE, False),
    ("stock", _INT, True),
    ("is_available", _BOOL, True),
    ("preparation_time_minutes", _INT, True),
    ("image_url", _STR, True),
    ("nutritional_info", _STR, True),
    ("created_at", _TS, True),
    ("updated_at", _TS, True),
)

ORDERS = _struct(
    ("order_id", _ID, False),
    ("user_id", _ID, False),
    ("order_date", _TS, True),
    ("total_amount", MONEY, False),
    ("order_status", _STR, True),
    ("payment_method", _STR, False),
    ("payment_status", _STR, True),
    ("estimated_ready_time", _TS, True),
    ("special_instructions", _STR, True),
    ("created_at", _TS, True),
    ("updated_at", _TS, True),
)

ORDER_ITEMS = _struct(
    ("order_item_id", _ID, False),
    ("order_id", _ID, False),
    ("item_id", _ID, False),
    ("quantity", _INT, False),
    ("unit_price", PRICE, False),
    ("subtotal", MONEY, False),
    ("special_requests", _STR, True),
)

SCHEMAS: dict[str, T.StructType] = {
    "users": USERS,
    "categories": CATEGORIES,
    "menu_items": MENU_ITEMS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
}

# The primary key of each table.
KEYS: dict[str, str] = {name: schema.fields[0].name for name, schema in SCHEMAS.items()}

# Columns an insert fills in when the caller leaves them out.
DEFAULTS: dict[str, dict[str, object]] = {
    "users": {"wallet_balance": 0},
    "categories": {"is_active": True},
    "menu_items": {"stock": 10, "is_available": True, "preparation_time_minutes": 10},
    "orders": {"order_status": "pending", "payment_status": "pending"},
    "order_items": {"quantity": 1},
}


Frame = DataFrame | Callable[[], DataFrame]


class Tables:
    """One snapshot of the business: five frames that belong together.

    A table may be given as a function; it is called when the table is first
    used, so a report only sets up the tables it reads.

    ``high_water`` holds the largest id of tables whose snapshot was saved
    with it; a table that is replaced loses its mark.
    """

    def __init__(
        self,
        users: Frame,
        categories: Frame,
        menu_items: Frame,
        orders: Frame,
        order_items: Frame,
        high_water: Mapping[str, int] | None = None,
    ) -> None:
        self.high_water = dict(high_water or {})
        self._frames: dict[str, Frame] = {
            "users": users,
            "categories": categories,
            "menu_items": menu_items,
            "orders": orders,
            "order_items": order_items,
        }

    def _get(self, name: str) -> DataFrame:
        frame = self._frames[name]
        if not isinstance(frame, DataFrame):
            frame = self._frames[name] = frame()
        return frame

    @property
    def users(self) -> DataFrame:
        return self._get("users")

    @property
    def categories(self) -> DataFrame:
        return self._get("categories")

    @property
    def menu_items(self) -> DataFrame:
        return self._get("menu_items")

    @property
    def orders(self) -> DataFrame:
        return self._get("orders")

    @property
    def order_items(self) -> DataFrame:
        return self._get("order_items")

    def with_(self, **frames: Frame) -> "Tables":
        """The same snapshot with some tables replaced."""
        marks = {name: mark for name, mark in self.high_water.items() if name not in frames}
        return Tables(**{**self._frames, **frames}, high_water=marks)

    def items(self) -> list[tuple[str, DataFrame]]:
        return [(name, self._get(name)) for name in SCHEMAS]
