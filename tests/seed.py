"""A small business with known figures: 7 users, 6 categories, 20 items, 5 orders, 9 lines."""

from datetime import datetime
from decimal import Decimal

from platter.schema import SCHEMAS, Tables

T0 = datetime(2024, 3, 1, 8, 0)

USERS = [(1, "student", "500.00"), (2, "student", "750.50"), (3, "student", "300.25"), (4, "faculty", "1000.00"),
         (5, "staff", "400.75"), (6, "student", "600.00"), (7, "student", "550.00")]
NAMES = ["Ada", "Ben", "Cleo", "Dag", "Eva", "Finn", "Gus"]
CATEGORIES = ["Breakfast", "Lunch", "Snacks", "Beverages", "Desserts", "South Indian"]
# category, price, stock; item ids count from 1
MENU = [(1, 45, 20), (1, 65, 15), (1, 35, 25), (1, 30, 30), (2, 85, 12), (2, 120, 8), (2, 95, 10), (2, 70, 15),
        (3, 15, 50), (3, 25, 40), (3, 30, 35), (3, 35, 30), (4, 15, 100), (4, 20, 100), (4, 25, 80), (4, 40, 50),
        (5, 35, 40), (5, 45, 30), (6, 30, 25), (6, 50, 20)]
ORDERS = [(1, 1, "110.00", "completed", "wallet", "completed"), (2, 2, "85.00", "ready", "upi", "completed"),
          (3, 3, "45.00", "preparing", "wallet", "completed"), (4, 6, "150.00", "confirmed", "wallet", "completed"),
          (5, 7, "75.00", "pending", "cash", "pending")]
LINES = [(1, 2, 1, 65), (1, 14, 2, 20), (1, 9, 1, 15), (2, 5, 1, 85), (3, 1, 1, 45), (4, 6, 1, 120), (4, 16, 1, 40),
         (5, 7, 1, 95), (5, 13, 1, 15)]


def frame(spark, table, rows):
    return spark.createDataFrame(rows, SCHEMAS[table])


def user(uid, kind="student", balance="0", name=None, srn=None, email=None, phone="9000000000"):
    name = name or f"User {uid}"
    return (uid, srn or f"R{uid:04d}", name, email or f"u{uid}@example.com", phone, kind, Decimal(balance), T0, T0)


def item(iid, category, price, stock, available=True, name=None):
    return (iid, category, name or f"Item {iid}", None, Decimal(price), stock, available, 5, None, None, T0, T0)


def order(oid, uid, total, status="pending", method="cash", payment="pending", when=None):
    when = when or T0.replace(hour=8 + oid % 12)
    return (oid, uid, when, Decimal(total), status, method, payment, None, None, when, when)


def line(lid, oid, iid, quantity, price, subtotal=None):
    price = Decimal(price)
    return (lid, oid, iid, quantity, price, price * quantity if subtotal is None else Decimal(subtotal), None)


def seed_tables(spark) -> Tables:
    return Tables(
        users=frame(spark, "users", [user(u, k, b, NAMES[u - 1]) for u, k, b in USERS]),
        categories=frame(spark, "categories", [(i, n, None, True, T0) for i, n in enumerate(CATEGORIES, 1)]),
        menu_items=frame(spark, "menu_items", [item(i, c, p, s) for i, (c, p, s) in enumerate(MENU, 1)]),
        orders=frame(spark, "orders", [order(*o) for o in ORDERS]),
        order_items=frame(spark, "order_items", [line(i, *row) for i, row in enumerate(LINES, 1)]),
    )


def tables(spark, users=(), menu=(), orders=(), lines=(), categories=((1, "Food", None, True, T0),)) -> Tables:
    return Tables(
        users=frame(spark, "users", list(users)),
        categories=frame(spark, "categories", list(categories)),
        menu_items=frame(spark, "menu_items", list(menu)),
        orders=frame(spark, "orders", list(orders)),
        order_items=frame(spark, "order_items", list(lines)),
    )


def values(df, *columns):
    """Rows as a set-like sorted list of tuples, decimals as floats."""
    picked = df.select(*columns) if columns else df
    rows = [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in picked.collect()]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def ordered(df, *columns):
    picked = df.select(*columns) if columns else df
    return [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in picked.collect()]
