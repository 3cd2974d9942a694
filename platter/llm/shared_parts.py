"""Reading, inside a task, a table that Spark has written to the shared folder.

A query set that every row must meet may be too large to broadcast. It is written once by
Spark's own writer, which leaves out what failed attempts wrote, and each task streams it
in batches: neither the driver nor a task ever holds all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame

from platter.session import fresh_path


def shared_table(frame: DataFrame, label: str) -> str:
    """Write ``frame`` to the shared folder; the path of the table."""
    path = fresh_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return path


def table_batches(path: str, rows: int, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a written table, at most ``rows`` at a time, in the order of its files."""
    system, place = fs.FileSystem.from_uri(path)
    found = [f.path for f in system.get_file_info(fs.FileSelector(place)) if f.base_name.startswith("part-")]
    for name in sorted(found):
        with system.open_input_file(name) as source:
            yield from pq.ParquetFile(source).iter_batches(rows, columns=columns)
