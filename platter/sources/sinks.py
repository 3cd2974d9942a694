"""Report export and validated appends."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_csv(df: DataFrame, path: str, single_file: int | None = None) -> None:
    """Write a report as CSV with a header line.

    Every task writes its own part. ``single_file`` is for short reports: the most
    rows that may go into one file. A longer report is refused before anything is written.
    """
    out = df
    if single_file is not None:
        rows = df.limit(single_file + 1).toArrow()
        if rows.num_rows > single_file:
            raise ValueError(f"more than {single_file} rows: export them without single_file")
        out = df.sparkSession.createDataFrame(rows, df.schema).coalesce(1)
    out.write.mode("errorifexists").option("header", True).csv(path)


def split_by_rules(new: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every rule, and the others with the first rule they break.

    A rule that evaluates to null passes, as a CHECK constraint does.
    """
    reason = F.lit(None).cast("string")
    for name, rule in reversed(list(rules.items())):
        reason = F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)).otherwise(reason)
    judged = new.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def append_validated(
    new: DataFrame, rules: Mapping[str, Column], path: str, fmt: str = "parquet"
) -> tuple[DataFrame, DataFrame]:
    """Append the rows that pass to ``path``; returns (accepted, rejected)."""
    accepted, rejected = split_by_rules(new, rules)
    accepted.write.format(fmt).mode("append").save(path)
    return accepted, rejected
