"""Load and save snapshots, ask parameterised SQL, inspect and widen tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platter.schema import DEFAULTS, KEYS, SCHEMAS, Tables

# Beside the tables of a saved snapshot: the largest id of each.
HIGH_WATER = "_high_water"
_MARKS = "table_name string, high_water bigint"


def load_tables(spark: SparkSession, folder: str, fmt: str = "parquet", **options: str) -> Tables:
    """Read the five tables below ``folder`` with their declared schemas.

    No schema is inferred, so a missing column reads as null instead of
    shifting the others, and no file is opened before a report needs it.
    """
    frames = {
        name: spark.read.format(fmt).options(**options).schema(schema).load(f"{folder.rstrip('/')}/{name}")
        for name, schema in SCHEMAS.items()
    }
    return Tables(**frames, high_water=load_high_water(spark, folder))


def load_high_water(spark: SparkSession, folder: str) -> dict[str, int]:
    """The largest ids that ``save_tables`` noted; nothing for a folder written by others."""
    try:
        rows = spark.read.schema(_MARKS).parquet(f"{folder.rstrip('/')}/{HIGH_WATER}").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {row["table_name"]: row["high_water"] for row in rows}


def save_high_water(spark: SparkSession, folder: str, marks: dict[str, int | None]) -> None:
    """Note the largest ids beside the tables; a row per table. An empty table starts at 0."""
    rows = spark.createDataFrame([(name, mark or 0) for name, mark in marks.items()], _MARKS)
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{HIGH_WATER}")


def load_tables_jdbc(spark: SparkSession, url: str, properties: dict[str, str], partitions: int) -> Tables:
    """The same snapshot straight from a relational database.

    Each table is read in ``partitions`` key ranges, so that no single task
    pulls a whole fact table, and takes its declared types.  Untested: no
    database was at hand.
    """
    frames = {}
    for name, schema in SCHEMAS.items():
        key = schema.fields[0].name
        reader = spark.read.jdbc
        if partitions > 1:
            low, high = (
                reader(url, f"(select min({key}) lo, max({key}) hi from {name}) bounds", properties=properties)
                .first()
            )
            frames[name] = reader(
                url,
                name,
                column=key,
                lowerBound=low or 0,
                upperBound=(high or 0) + 1,
                numPartitions=partitions,
                properties=properties,
            )
        else:
            frames[name] = reader(url, name, properties=properties)
        frames[name] = frames[name].select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))
    return Tables(**frames)


def save_tables(tables: Tables, folder: str, fmt: str = "parquet", orders_by_date: bool = False) -> None:
    """Write a snapshot to a new folder; an existing one is never replaced.

    ``orders_by_date`` gives every file of ``orders`` its own stretch of
    ``order_date``, so that a day filter skips the other files by their
    statistics.  ``order_id`` as second key keeps a busy day splittable.
    The largest id of each table is observed as it is written and noted last, so
    later batches need not scan a column to number their rows.
    """
    marks = {}
    for name, frame in tables.items():
        if orders_by_date and name == "orders":
            frame = frame.repartitionByRange("order_date", "order_id").sortWithinPartitions("order_date", "order_id")
        largest = Observation()
        frame = frame.observe(largest, F.max(F.col(KEYS[name]).cast("bigint")).alias("id"))
        frame.write.format(fmt).mode("errorifexists").save(f"{folder.rstrip('/')}/{name}")
        marks[name] = largest.get["id"]
    save_high_water(tables.users.sparkSession, folder, marks)


def save_bucketed(tables: Tables, database: str, buckets: int) -> None:
    """Save a snapshot as catalog tables; headers and lines share their buckets.

    Both are bucketed and sorted by ``order_id``, so the header-line join and
    the per-order totals need no shuffle.
    """
    for name, frame in tables.items():
        writer = frame.write.format("parquet")
        if name in ("orders", "order_items"):
            writer = writer.bucketBy(buckets, "order_id").sortBy("order_id")
        writer.saveAsTable(f"{database}.{name}")


def from_catalog(spark: SparkSession, database: str) -> Tables:
    """The snapshot kept as catalog tables in ``database``."""
    return Tables(**{name: spark.table(f"{database}.{name}") for name in SCHEMAS})


def register_views(tables: Tables) -> None:
    """Temporary views: the five tables, ``order_summary`` and ``popular_items``."""
    from platter.plans.views import order_summary, popular_items

    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
    order_summary(tables).createOrReplaceTempView("order_summary")
    popular_items(tables).createOrReplaceTempView("popular_items")


def sql(spark: SparkSession, text: str, **args: object) -> DataFrame:
    """Run a statement with named parameters (``:name``), never by pasting text."""
    return spark.sql(text, args=args)


def describe_table(df: DataFrame) -> DataFrame:
    """Columns of a frame: name, type, whether null is allowed, position."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable, i) for i, f in enumerate(df.schema.fields, start=1)]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, data_type string, is_nullable boolean, ordinal int"
    )


def with_default_column(df: DataFrame, name: str, dtype: str | T.DataType, value: object) -> DataFrame:
    """Add a column that holds ``value`` for the rows already there."""
    if name in df.columns:
        raise ValueError(f"column {name} exists already")
    return df.withColumn(name, F.lit(value).cast(dtype))


def conform(df: DataFrame, table: str, as_of: object | None = None) -> DataFrame:
    """Fit new rows to a table: fill defaults, add missing columns, cast, order.

    A column that is left out, or null where the table has a default, takes
    the default; the audit columns take ``as_of``.
    """
    columns = []
    defaults = DEFAULTS[table]
    for field in SCHEMAS[table].fields:
        value = F.col(field.name) if field.name in df.columns else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        elif as_of is not None and field.name in ("created_at", "updated_at", "order_date"):
            value = F.coalesce(value, F.lit(as_of))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)
