from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from platter.functions.lookups import register_sql_functions
from platter.operators.quality import check_rules
from platter.plans import menu, orders
from platter.schema import SCHEMAS
from platter.session import fresh_path, shared_dir
from platter.sources import sinks, tables
from platter.streaming import jobs
from tests.seed import T0, item, ordered, user, values
from tests.seed import tables as small_tables


def test_snapshot_survives_the_round_trip(spark, seed, tmp_path):
    folder = str(tmp_path / "books")
    tables.save_tables(seed, folder)
    loaded = tables.load_tables(spark, folder)
    for name, frame in seed.items():
        assert sorted(map(tuple, getattr(loaded, name).collect()), key=str) == sorted(map(tuple, frame.collect()), key=str)
    with pytest.raises(Exception, match="already exists"):
        tables.save_tables(seed, folder)


def test_bucketed_tables_join_without_a_shuffle(spark, seed):
    spark.sql("CREATE DATABASE IF NOT EXISTS books_test")
    try:
        tables.save_bucketed(seed, "books_test", 4)
        stored = tables.from_catalog(spark, "books_test")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = stored.order_items.join(stored.orders, "order_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE books_test CASCADE")


def test_parameters_and_views(spark, seed):
    tables.register_views(seed)
    got = tables.sql(spark, "SELECT order_id FROM order_summary WHERE customer_name = :who", who="Ada' OR '1'='1")
    assert got.count() == 0
    assert ordered(tables.sql(spark, "SELECT order_id FROM order_summary WHERE customer_name = :who", who="Ada")) == [(1,)]
    register_sql_functions(spark)
    row = spark.sql("SELECT get_wallet_balance(6), get_wallet_balance(77), get_order_total(4), get_total_sales_for_item(2)")
    assert [float(v) for v in row.first()] == [600.0, 0.0, 160.0, 65.0]


def test_describe_and_defaults(spark, seed):
    shape = tables.describe_table(seed.users)
    assert values(shape.where("column_name = 'wallet_balance'"), "data_type", "is_nullable", "ordinal") == [
        ("decimal(10,2)", True, 7)]
    wide = tables.with_default_column(seed.menu_items.drop("stock"), "stock", "int", 10)
    assert wide.select("stock").distinct().collect() == [(10,)]
    with pytest.raises(ValueError):
        tables.with_default_column(seed.menu_items, "stock", "int", 10)
    new = spark.createDataFrame([(21, 1, "Tea", Decimal(9))], "item_id int, category_id int, item_name string, price decimal(8,2)")
    row = tables.conform(new, "menu_items", datetime(2024, 1, 1)).first()
    assert (row["stock"], row["is_available"], row["preparation_time_minutes"]) == (10, True, 10)
    assert row["created_at"] == datetime(2024, 1, 1)
    assert tables.conform(new, "menu_items").schema.names == SCHEMAS["menu_items"].names


def test_csv_export(spark, seed, tmp_path):
    path = str(tmp_path / "popular")
    sinks.export_csv(menu.best_sellers(seed, 3), path, single_file=3)
    with pytest.raises(ValueError, match="more than 2 rows"):
        sinks.export_csv(menu.best_sellers(seed, 3), path + "-long", single_file=2)
    back = spark.read.option("header", True).csv(path)
    assert back.columns[0] == "item_id" and back.count() == 3
    sinks.export_csv(orders.all_orders(seed), str(tmp_path / "orders"))
    assert spark.read.option("header", True).csv(str(tmp_path / "orders")).count() == 5


def test_append_takes_only_valid_rows(spark, seed, tmp_path):
    path = str(tmp_path / "users")
    seed.users.write.parquet(path)
    new = small_tables(spark, [user(8), user(9, phone="12"), user(10, email="x@y")]).users
    accepted, rejected = sinks.append_validated(new, check_rules()["users"], path)
    assert accepted.count() == 1 and spark.read.parquet(path).count() == 8
    assert values(rejected, "user_id", "reason") == [(9, "phone_format"), (10, "email_format")]


class _Session:
    """Just enough of a session to ask for the shared folder."""

    def __init__(self, master, configured=None):
        self.conf = {"spark.checkpoint.dir": configured}
        self.sparkContext = self
        self.master = master
        self.chosen = None

    def getCheckpointDir(self):
        return self.chosen

    def setCheckpointDir(self, folder):
        self.chosen = folder


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(_Session("spark://host", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_Session("spark://host"))
    assert "platter-" in shared_dir(_Session("local[2]"))
    assert fresh_path(spark, "x").startswith(shared_dir(spark))


def test_daily_stream_closes_finished_days_only(spark, tmp_path):
    source = str(tmp_path / "events")
    rows = [(datetime(2024, 1, d, h), kind, v) for d, h, kind, v in
            [(1, 1, "purchase", 2.5), (1, 23, "purchase", 1.0), (1, 5, "view", 9.0), (2, 3, "purchase", 4.0),
             (3, 0, "purchase", 8.0)]]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double")
    events.write.parquet(source)
    stream = jobs.daily_activity(jobs.file_stream(spark, source, events.schema), "purchase")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    jobs.write_parquet(stream, out, check).awaitTermination()
    first = values(spark.read.schema(stream.schema).parquet(out).select(F.dayofmonth("activity_day"), "event_count", "total_value"))
    assert first == [(1, 2, 3.5)]
    # more files later: the job goes on from its checkpoint and closes the second day
    late = [(datetime(2024, 1, 3, 5), "purchase", 1.0), (datetime(2024, 1, 1, 7), "purchase", 99.0)]
    spark.createDataFrame(late, events.schema).write.mode("append").parquet(source)
    stream = jobs.daily_activity(jobs.file_stream(spark, source, events.schema), "purchase")
    jobs.write_parquet(stream, out, check).awaitTermination()
    assert values(spark.read.schema(stream.schema).parquet(out).select(F.dayofmonth("activity_day"), "total_value")) == [
        (1, 3.5), (2, 4.0)]


def test_line_stream(spark, tmp_path):
    source = str(tmp_path / "lines")
    lines = spark.createDataFrame(
        [(1, 1, 2, Decimal("7.50")), (1, 2, 3, None), (2, 9, 1, Decimal(1))],
        "order_id int, item_id int, quantity int, unit_price decimal(8,2)")
    lines.write.parquet(source)
    goods = small_tables(spark, menu=[item(1, 1, 5, 0), item(2, 1, 6, 4)]).menu_items
    stream = jobs.enrich_lines(jobs.file_stream(spark, source, lines.schema), goods)
    out = str(tmp_path / "out")
    jobs.write_parquet(stream, out, str(tmp_path / "check")).awaitTermination()
    assert values(spark.read.schema(stream.schema).parquet(out), "item_id", "subtotal", "item_available") == [
        (1, 15.0, False), (2, 18.0, True), (9, 1.0, None)]
    assert T0.year == 2024
