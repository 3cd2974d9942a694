"""Small expressions and worker helpers that the operators share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words is the blank and the five ASCII controls from tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_az(text: Column) -> Column:
    """Lower case of A-Z alone; every other letter stays."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % modulus


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bounded_sample(frame: DataFrame, key: str, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` rows of ``frame``, all of them if it has fewer: those whose hashed key is low.

    The same rows every time, taken without a sort.
    """
    total = frame.count()
    if total <= rows:
        return frame
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    return frame.where(unit < rows / total)


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``frame`` has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
