from datetime import datetime

from pyspark.sql import functions as F

from platter.functions.expressions import money_text, valid_email, valid_phone
from platter.operators import quality
from platter.operators.ordering import derive_subtotal
from platter.operators.stock import enforce_availability
from platter.sources.retail import retail_tables
from tests.seed import T0, item, line, order, tables, user, values


def test_clean_seed(seed):
    assert all(r[1] == 0 for r in values(quality.integrity_report(seed)))
    assert all(r[2] == 0 for r in values(quality.uniqueness_report(seed)))
    for report in (quality.check_report, quality.enum_report, quality.not_null_report):
        assert all(r[1] == 0 for r in values(report(seed), "rule", "violations"))
    assert quality.subtotal_drift(seed).count() == 0


def test_totals_that_differ_from_their_lines(seed):
    assert values(quality.reconcile_order_totals(seed), "order_id", "total_amount", "line_total") == [
        (1, 110.0, 120.0), (4, 150.0, 160.0), (5, 75.0, 110.0)]
    assert quality.reconcile_order_totals(seed, only_drift=False).count() == 5


def test_orphans_per_rule(spark):
    t = tables(spark, [user(1)], [item(1, 1, 5, 5), item(2, 9, 5, 5)], [order(1, 1, 5), order(2, 8, 5), order(3, 8, 5)],
               [line(1, 1, 1, 1, 5), line(2, 7, 1, 1, 5), line(3, 1, 6, 1, 5)])
    assert dict(values(quality.integrity_report(t))) == {
        "Orders without valid user": 2, "Order_Items without valid order": 1,
        "Order_Items without valid menu item": 1, "Menu_Items without valid category": 1}
    assert values(quality.orphans(t, "Orders without valid user"), "order_id") == [(2,), (3,)]
    plan = quality.integrity_report(t)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan


def test_repeated_keys_ignore_case(spark):
    t = tables(spark, [user(1, srn="ab"), user(2, srn="AB"), user(2, email="U1@example.com")],
               lines=[line(1, 1, 1, 1, 5), line(2, 1, 1, 1, 5), line(3, 1, 1, 1, 5)])
    got = {r[0]: r[1:] for r in values(quality.uniqueness_report(t))}
    assert got["users(user_id)"] == (1, 1) and got["users(srn)"] == (1, 1) and got["users(email)"] == (1, 1)
    assert got["order_items(order_id, item_id)"] == (1, 2) and got["order_items(order_item_id)"] == (0, 0)


def test_rules_pass_on_null_and_fail_on_bounds(spark):
    phones = ["900000000", "9000000000", "90000000000", "90000000xx", None]
    people = [user(i, phone=p, balance="-1" if i == 2 else "0") for i, p in enumerate(phones, 1)]
    people.append(user(6, kind="guest", email="someone@nodot"))
    t = tables(spark, people, [item(1, 1, 0, 1), item(2, 1, 5, 1)], [order(1, 1, 0, status="lost"), order(2, 1, 1)],
               [line(1, 1, 1, 0, 5), line(2, 1, 2, 1, 0)])
    got = dict(values(quality.check_report(t), "rule", "violations"))
    assert got == {"wallet_balance_not_negative": 1, "email_format": 1, "phone_format": 3, "price_positive": 1,
                   "preparation_time_positive": 0, "total_amount_positive": 1, "quantity_positive": 1,
                   "unit_price_positive": 1}
    enums = dict(values(quality.enum_report(t), "rule", "violations"))
    assert enums["users.user_type"] == 1 and enums["orders.order_status"] == 1
    broken = {r[0]: r[1] for r in quality.check_violations(t, "users").select("user_id", "broken_rules").collect()}
    assert broken[2] == ["wallet_balance_not_negative"] and broken[6] == ["email_format"]
    missing = t.with_(users=t.users.withColumn("name", F.lit(None).cast("string")))
    assert dict(values(quality.not_null_report(missing), "rule", "violations"))["users.name"] == 6


def test_formats(spark):
    df = spark.createDataFrame([("a.b@c.io", "0123456789"), ("ab@cio", "012345678")], "email string, phone string")
    assert df.select(valid_email(), valid_phone()).collect() == [(True, True), (False, False)]
    text = spark.sql("SELECT CAST(NULL AS DECIMAL(8,2)) n, CAST(3 AS DECIMAL(8,2)) v")
    assert tuple(text.select(money_text("v"), money_text("n"), money_text("n", True)).first()) == ("₹3.00", None, "₹0.00")


def test_triggers(spark):
    lines = tables(spark, lines=[line(1, 1, 9, 2, 15, 1)]).order_items
    assert values(derive_subtotal(lines), "subtotal") == [(30.0,)]
    menu = tables(spark, menu=[item(1, 1, 5, -1), item(2, 1, 5, 0), item(3, 1, 5, 1), item(4, 1, 5, None),
                               item(5, 1, 5, 9, False)]).menu_items
    late = datetime(2025, 1, 1)
    assert values(enforce_availability(menu, late), "item_id", "is_available") == [
        (1, False), (2, False), (3, True), (4, True), (5, False)]
    assert enforce_availability(menu, late).where(F.col("updated_at") == F.lit(late)).count() == 2
    assert T0 < late


def test_audit_counts_what_it_writes(spark, tmp_path):
    t = tables(spark, [user(1), user(2, balance="-1", kind="guest", phone="1")], [item(1, 9, 0, 5)], [order(1, 1, 5), order(2, 8, 0, status="lost")],
               [line(1, 1, 1, 1, 5), line(2, 7, 6, 0, 5)])
    t = t.with_(users=t.users.withColumn("name", F.when(F.col("user_id") == 1, F.col("name"))))
    done = quality.audit(t, str(tmp_path / "violations"))
    rows = done.details.groupBy("kind", "rule").count()
    counts = {(r["kind"], r["rule"]): r["violations"] for r in done.counts.collect()}
    assert {k: n for k, n in counts.items() if n} == {(r["kind"], r["rule"]): r["count"] for r in rows.collect()}
    assert counts == {(r["kind"], r["rule"]): r["violations"] for r in quality.rule_counts(t).collect()}
    assert counts["reference", "Orders without valid user"] == 1 and counts["not_null", "users.name"] == 1
    got = {(r["table_name"], r["row_id"], r["rule"], r["value"]) for r in quality.violations(t, ("enum", "check")).collect()}
    assert got == {("users", 2, "wallet_balance_not_negative", "-1.00"), ("users", 2, "phone_format", "1"), ("users", 2, "users.user_type", "guest"),
                   ("menu_items", 1, "price_positive", "0.00"), ("orders", 2, "total_amount_positive", "0.00"),
                   ("orders", 2, "orders.order_status", "lost"), ("order_items", 2, "quantity_positive", "0")}


def test_a_repeated_parent_does_not_repeat_a_violation(spark):
    t = tables(spark, [user(1), user(1)], [], [order(1, 1, 0)], [])
    assert quality.violations(t, ("reference", "check")).count() == 1


def test_one_scan_per_table(spark):
    t = retail_tables(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    unique = plan(quality.uniqueness_report(t))
    assert unique.count("lineitem.parquet") == unique.count("customer.parquet") == 1
    for frame in (quality.violations(t), quality.rule_counts(t)):
        assert plan(frame).count("lineitem.parquet") == 1
    for frame in (quality.violations(t, ("check", "enum", "not_null")), quality.rule_counts(t, ("check", "enum", "not_null"))):
        assert all(plan(frame).count(f"{name}.parquet") == 1 for name in ("customer", "orders", "lineitem"))
