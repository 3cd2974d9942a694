"""Plans: what must, and must not, appear in them; and what happens to a hot key."""

import pytest
from pyspark.sql import functions as F

from platter.plans import customers, menu, orders, overview
from platter.plans.views import order_summary, top_joined
from platter.sources.retail import retail_tables
from tests.seed import item, line, order, ordered, tables, user

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def retail(spark):
    return retail_tables(spark, FOLDER)


def test_never_ordered_is_an_anti_join(retail):
    assert "LeftAnti" in plan(menu.never_ordered(retail))


def test_top_k_keeps_k_rows_per_task(retail):
    for df in (menu.best_sellers(retail), customers.top_customers(retail), menu.low_stock(retail)):
        assert "TakeOrderedAndProject" in plan(df)


def test_scans_read_the_needed_columns_and_filters(retail, spark):
    text = plan(customers.top_customers(retail))
    assert "o_orderdate" not in text and "c_acctbal" not in text
    text = plan(menu.low_stock(retail))
    assert "p_size" in text and "p_retailprice" not in text
    assert "LocalTableScan" in plan(menu.active_categories(retail))


def test_kpis_scan_orders_once_without_joins(retail):
    text = plan(overview.kpis(retail))
    assert text.count("orders.parquet") == 1 and "Join" not in text
    assert "Join" not in plan(overview.day_overview(retail, __import__("datetime").date(1998, 6, 15)))


def test_facts_are_summed_before_they_are_joined(retail):
    text = plan(menu.best_sellers(retail))
    assert text.index("Join") < text.index("partial_sum")
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_no_python_workers(retail):
    for df in (menu.category_statistics(retail), customers.above_average_spenders(retail), orders.latest_orders(retail)):
        assert "Python" not in plan(df) and "ArrowEval" not in plan(df)


def test_day_filter_reaches_the_scan(spark, seed, tmp_path):
    from datetime import date

    from platter.sources.tables import load_tables, save_tables

    save_tables(seed, str(tmp_path / "snapshot"), orders_by_date=True)
    loaded = load_tables(spark, str(tmp_path / "snapshot"))
    assert "GreaterThanOrEqual(order_date" in plan(overview.day_sales(loaded, date(2024, 3, 1)))
    assert ordered(overview.day_sales(loaded, date(2024, 3, 1))) == [(5, 390.0)]


def test_hot_customer_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        ids = spark.range(20000).repartition(6)
        # user 1 placed a third of all orders
        owner = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500 + 2)
        orders_ = ids.select(
            F.col("id").alias("order_id"), owner.alias("user_id"), F.current_timestamp().alias("order_date"),
            F.md5(F.col("id").cast("string")).alias("order_status"), F.lit(1).cast("decimal(10,2)").alias("total_amount"),
            F.lit("cash").alias("payment_method"), F.lit("pending").alias("payment_status"))
        users = spark.range(1, 503).select(
            F.col("id").alias("user_id"), F.lit("n").alias("name"), F.col("id").cast("string").alias("srn"),
            F.lit("student").alias("user_type"), F.lit(1).alias("wallet_balance"))
        t = tables(spark).with_(orders=orders_, users=users)
        df = order_summary(t)
        assert "skew=true" in final_plan(df)
        assert df.count() == 20000
        spent = customers.customer_totals(orders_)
        assert spent.where("user_id = 1").first()["order_count"] == 6667
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)


def test_cut_before_the_join_falls_back_when_rows_drop_out(spark):
    t = tables(spark, [user(1), user(2)], [item(1, 1, 5, 5)],
               [order(i, 1 + i % 3, 5) for i in range(1, 10)],
               [line(1, 1, 1, 1, 5), line(2, 3, 1, 1, 5), line(3, 3, 1, 2, 5)])
    whole = ordered(order_summary(t).orderBy(F.col("order_date").desc(), "order_id").select("order_id"))
    for k in (1, 2, 3, 5, 6, 7, 20):
        assert ordered(overview.recent_orders(t, k), "order_id") == whole[:k]
    assert ordered(orders.line_detail(t, 2), "order_id", "quantity") == [(3, 1), (3, 2)]
    assert ordered(orders.line_detail(t, 10), "order_id", "quantity") == [(3, 1), (3, 2), (1, 1)]
    assert top_joined(t.orders, [F.col("order_id")], None, lambda o: o).count() == 9
