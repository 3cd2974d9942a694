"""Snapshots that share files: a batch writes the buckets of orders it touches and links the others.

Orders and their lines are split into buckets by a hash of ``order_id``, each bucket in a folder of its
own. What a snapshot consists of is written down in a small table, its manifest: a row
per table and folder. A batch that names its orders reads their buckets only, and the new
snapshot's manifest takes the folders of all other buckets from the one before; appended
orders are further folders of their bucket. Nothing is ever written over, so the old snapshot stays
as it was, and a failed batch leaves a folder without a manifest, which is no snapshot.

Users, categories and menu are written whole with every snapshot. A manifest has a row per table and
bucket, and one more for each append that met the bucket since it was last rewritten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from platter.operators.base import Outcome
from platter.schema import KEYS, SCHEMAS, Tables
from platter.sources.tables import load_high_water, save_high_water

FACTS = ("orders", "order_items")
BUCKETS = 64
MANIFEST = "_manifest"
_ROWS = "table_name string, bucket int, path string, buckets int"


@dataclass(frozen=True)
class Version:
    """What a saved snapshot consists of: (table, bucket, path)."""

    buckets: int
    paths: tuple[tuple[str, int, str], ...] = ()

    def of(self, table: str, only: Iterable[int] | None = None) -> list[str]:
        wanted = None if only is None else set(only)
        return [path for name, bucket, path in self.paths if name == table and (wanted is None or bucket in wanted)]


def bucket_of(order_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(order_id.cast("bigint")), F.lit(buckets)).cast("int")


def open_version(spark: SparkSession, folder: str) -> Version:
    rows = spark.read.schema(_ROWS).parquet(f"{folder.rstrip('/')}/{MANIFEST}").collect()
    return Version(rows[0]["buckets"], tuple(sorted((r["table_name"], r["bucket"], r["path"]) for r in rows)))


def load_version(spark: SparkSession, folder: str, only: Iterable[int] | None = None) -> Tables:
    """The snapshot in ``folder``; of orders and lines just the buckets ``only``, if given."""
    version = open_version(spark, folder)

    def read(table: str) -> DataFrame:
        paths = version.of(table, only if table in FACTS else None)
        return spark.read.schema(SCHEMAS[table]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[table])

    return Tables(**{table: read(table) for table in SCHEMAS}, high_water=load_high_water(spark, folder))


def touched_buckets(version: Version, order_ids: DataFrame) -> list[int]:
    """The buckets of some orders, as many numbers as the snapshot has buckets at most."""
    found = order_ids.select(bucket_of(F.col("order_id"), version.buckets).alias("bucket")).where("order_id IS NOT NULL")
    return sorted(row["bucket"] for row in found.distinct().collect())


def _written_buckets(spark: SparkSession, path: str) -> list[int]:
    """Which buckets a write left behind."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(place)
    names = [status.getPath().getName() for status in found]
    return sorted(int(name.split("=")[1]) for name in names if name.startswith("bucket="))


def save_version(
    tables: Tables, folder: str, buckets: int = BUCKETS, base: Version | None = None, touched: Iterable[int] = ()
) -> None:
    """Write a snapshot to a new ``folder``.

    With a ``base``, the rows of ``tables`` stand for its buckets ``touched`` only: those of its
    other buckets are linked, and rows that fall into them are added to them.
    """
    spark = tables.users.sparkSession
    buckets = base.buckets if base else buckets
    gone, paths, marks = set(touched), [], {}
    for table, frame in tables.items():
        path, largest = f"{folder.rstrip('/')}/{table}", Observation()
        rows = frame.select(*SCHEMAS[table].fieldNames()).observe(largest, F.max(F.col(KEYS[table]).cast("bigint")).alias("id"))
        if table in FACTS:
            # The second key lets a large bucket be written by several tasks.
            key = F.pmod(F.xxhash64(KEYS[table]), F.lit(8))
            rows = rows.withColumn("bucket", bucket_of(F.col("order_id"), buckets)).repartition("bucket", key)
            rows.write.mode("errorifexists").partitionBy("bucket").parquet(path)
            paths += [(table, n, f"{path}/bucket={n}") for n in _written_buckets(spark, path)]
            paths += [p for p in base.paths if p[0] == table and p[1] not in gone] if base else []
        else:
            rows.write.mode("errorifexists").parquet(path)
            paths.append((table, 0, path))
        marks[table] = max(largest.get["id"] or 0, tables.high_water.get(table, 0))
    save_high_water(spark, folder, marks)
    rows = spark.createDataFrame([(*p, buckets) for p in paths], _ROWS)
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{folder.rstrip('/')}/{MANIFEST}")


def apply_batch(
    spark: SparkSession, before: str, after: str, change: Callable[[Tables], Outcome], order_ids: DataFrame | None = None
) -> Outcome:
    """Run a state change on the snapshot ``before`` and save the result as ``after``.

    ``order_ids`` (order_id) are the orders that the change looks at; of all others
    neither headers nor lines are read or written. Without any, the change only adds orders.
    The outcome's tables are those buckets. Its ``rejects`` and ``done`` can be read until it is released.
    """
    base = open_version(spark, before)
    touched = touched_buckets(base, order_ids) if order_ids is not None else []
    books = load_version(spark, before, touched)
    outcome = change(books)
    # A table that the change replaced has lost its mark; ids never fall below the old one.
    kept = Tables(**dict(outcome.tables.items()), high_water=books.high_water)
    save_version(kept, after, base=base, touched=touched)
    return outcome
