"""Daily activity from an event feed, and new order lines as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from platter.functions.expressions import line_amount
from platter.schema import TOTAL


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, max_files: int = 1000) -> DataFrame:
    """Parquet files below ``path`` as a stream, a bounded number per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def daily_activity(events: DataFrame, event_type: str, lateness: str = "1 hour") -> DataFrame:
    """Events of one type and their value per day.

    A day is final once the feed is ``lateness`` past its end; the day still
    open is not in the result yet.  State holds one row per open day.  Event
    times without a zone are taken in the session zone, which should be UTC.
    """
    return (
        events.where(F.col("event_type") == event_type)
        .select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(12,2)").alias("value"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day").alias("day"))
        .agg(F.count("*").alias("event_count"), F.sum("value").cast(TOTAL).alias("total_value"))
        .select(F.to_date("day.start").alias("activity_day"), "event_count", "total_value")
    )


def enrich_lines(lines: DataFrame, menu: DataFrame) -> DataFrame:
    """New order lines with their subtotal and whether the item can be sold.

    A line without a unit price takes the menu price.  The menu is joined as
    a static table, so each micro-batch is stateless.
    """
    items = menu.select(
        "item_id",
        F.col("price").alias("_price"),
        F.when(F.col("stock") <= 0, F.lit(False)).otherwise(F.col("is_available")).alias("item_available"),
    )
    priced = lines.join(items, "item_id", "left").withColumn("unit_price", F.coalesce("unit_price", "_price"))
    return priced.withColumn("subtotal", line_amount()).drop("_price")


def write_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run a stream over everything that is there, then stop; restarts carry on."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
