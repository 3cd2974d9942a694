"""Request order: dense positions, and running values that no hot key can clog.

Requests that must act in order get a dense position.  Cutting the positions
into equal chunks bounds every (key, chunk) group by the chunk size, however
many rows one key holds.  While no key holds more rows than a chunk, work per
key is bounded as it is; once one does (``crowded``), the same work is done
per chunk (``split=True``) and carried over from chunk to chunk through one
small row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platter.session import stored

CHUNK_ROWS = 100_000

# Fixed value: a generated id keeps the row number in its low 33 bits.
_ROW_BITS = 33


def with_position(df: DataFrame, *order: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``position`` (0, 1, 2, ... in the given order) and ``chunk``.

    One distributed sort, stored; each row then only needs the number of rows
    in the partitions before its own.  That frame has one row per sort task.
    """
    slot = F.col("_slot")
    placed = stored(df.orderBy(*order).withColumn("_slot", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("_task", F.shiftright(slot, _ROW_BITS))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_task")
        .agg(F.count("*").alias("_rows"))
        .select("_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    position = F.col("_offset") + slot - F.shiftleft(F.col("_task"), _ROW_BITS)
    return (
        placed.join(F.broadcast(offsets), "_task")
        .withColumn("position", position.cast("bigint"))
        .withColumn("chunk", F.floor(F.col("position") / F.lit(chunk_rows)).cast("bigint"))
        .drop("_slot", "_task", "_offset")
    )


def crowded(rows: DataFrame, key: str, limit: int = CHUNK_ROWS) -> bool:
    """Whether some key holds more than ``limit`` rows; counts are summed in the map tasks."""
    return not rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).isEmpty()


def look_up(rows: DataFrame, key: str, reference: DataFrame, split: bool = False) -> DataFrame:
    """Left join of positioned rows with one reference row per key.

    Split, the reference row is first copied to each chunk that needs it,
    then joined on (key, chunk), so the rows of a hot key spread over tasks.
    """
    if not split:
        return rows.join(reference, key, "left")
    spread = rows.select(key, "chunk").distinct().join(reference, key, "left")
    return rows.join(spread, [key, "chunk"], "left")


def running(
    rows: DataFrame,
    key: str,
    kind: str,
    value: Column,
    name: str,
    inclusive: bool = True,
    split: bool = False,
) -> DataFrame:
    """Running ``sum`` or ``last`` non-null value per key in order of position."""
    if kind not in ("sum", "last"):
        raise ValueError(f"unknown running aggregate {kind}")
    rows = rows.withColumn("_value", value)
    upto = Window.currentRow if inclusive else -1
    if not split:
        window = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, upto)
        if kind == "sum":
            result = F.coalesce(F.sum("_value").over(window), F.lit(0))
        else:
            result = F.last("_value", ignorenulls=True).over(window)
        return rows.withColumn(name, result).drop("_value")
    if kind == "sum":
        of_chunk = F.sum("_value")
    else:
        of_chunk = F.max(F.when(F.col("_value").isNotNull(), F.struct("position", "_value")))["_value"]

    def over(column: str, window):
        return (F.sum(column) if kind == "sum" else F.last(column, ignorenulls=True)).over(window)

    chunks_before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    in_chunk = (
        Window.partitionBy(key, "chunk")
        .orderBy("position")
        .rowsBetween(Window.unboundedPreceding, upto)
    )
    carried = (
        rows.groupBy(key, "chunk")
        .agg(of_chunk.alias("_of_chunk"))
        .select(key, "chunk", over("_of_chunk", chunks_before).alias("_carried"))
    )
    joined = rows.join(carried, [key, "chunk"]).withColumn("_inside", over("_value", in_chunk))
    if kind == "sum":
        result = F.coalesce("_carried", F.lit(0)) + F.coalesce("_inside", F.lit(0))
    else:
        result = F.coalesce("_inside", "_carried")
    return joined.withColumn(name, result).drop("_value", "_carried", "_inside")
