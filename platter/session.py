"""Session defaults and the shared folder that multi-pass jobs write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_collected: ContextVar[list[str] | None] = ContextVar("platter_scratch", default=None)


def build_session(app: str = "platter", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for.

    Money columns need a fixed session zone for their timestamps, and the
    joins rely on adaptive execution to split skewed partitions and to turn
    a sort-merge join into a broadcast only once the size is known.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir`` of the session.

    Only a local session may fall back to a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="platter-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths that ``fresh_path`` hands out inside the block, for whoever removes them later."""
    paths: list[str] = []
    before = _collected.set(paths)
    try:
        yield paths
    finally:
        _collected.reset(before)


def when_read(frame: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """A frame of an operator that is made at its first use; paths it takes then count as the operator's."""
    paths = _collected.get()

    @cache
    def make() -> DataFrame:
        before = _collected.set(paths)
        try:
            return frame()
        finally:
            _collected.reset(before)

    return make


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Remove written tables, from whatever store they are in; a path that is gone already is no error."""
    context = spark.sparkContext
    for path in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (paths := _collected.get()) is not None:
        paths.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage with a table that outlives any executor, and fixes
    values that a recomputation might place differently (row positions).
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_if_small(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """A derived frame as a local one if it has at most ``limit`` rows, else as it is.

    The planner takes a derived frame to be as large as what it is derived
    from, and would shuffle facts to join it.
    """
    few = df.limit(limit + 1).toArrow()
    return df if few.num_rows > limit else df.sparkSession.createDataFrame(few, df.schema)
