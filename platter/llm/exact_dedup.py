"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after lower-casing A-Z. Lower-casing changes no
length, so lengths come straight from the text; only texts that share a length are told
apart by a hash of their first characters, and only texts that share both are hashed in
full. Each step shuffles a few bytes per row with partial counts, so a group with a third
of all rows is one row per task; texts themselves are shuffled only by the last step, and
only when no digest of every row is asked for.

Defined results: a null text equals the empty text; of equal texts the largest id stays;
null ids never stay unless a group has nothing else; rows repeated with the same id and
text all count and share their decision. An empty table gives an empty result. Other
columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm.common import lower_az, whole_text
from platter.session import stored

PREFIX_CHARS = 64


def _digest(text: Column) -> Column:
    return F.sha2(lower_az(text).cast("binary"), 256)


def _shared(frame: DataFrame, *keys: str) -> DataFrame:
    """The values of ``keys`` that two rows or more have."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*keys)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digests: bool = False,
    prefix_chars: int = PREFIX_CHARS,
) -> DataFrame:
    """One row per row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``text_sha256`` is null for rows that were told apart earlier, unless ``digests``
    asks for it everywhere; the groups are the same.
    """
    text = whole_text(text_col)
    size = F.octet_length(text).cast("long")
    start = F.xxhash64(lower_az(F.substring(text, 1, prefix_chars)))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body"), size.alias("size"), start.alias("start"))
    if digests:
        heads = stored(rows.select("id", "size", "start", _digest(F.col("body")).alias("sha")), "exact-heads")
    else:
        heads = stored(rows.select("size", "start"), "exact-heads")
    same_size = heads.join(stored(_shared(heads, "size"), "exact-sizes"), "size", "left_semi")
    same_start = stored(_shared(same_size, "size", "start"), "exact-starts")
    if digests:
        prints = heads
    else:
        marked = rows.join(same_start.withColumn("hit", F.lit(True)), ["size", "start"], "left")
        prints = stored(marked.select("id", "size", "start", F.when(F.col("hit"), _digest(F.col("body"))).alias("sha")), "exact-prints")
    groups = (
        prints.join(same_start, ["size", "start"], "left_semi")
        .groupBy("size", "start", "sha")
        .agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
        .where(F.col("n") > 1)
    )
    groups = stored(groups.withColumnRenamed("sha", "group_sha").drop("start"), "exact-groups")
    joined = prints.join(groups.withColumnRenamed("size", "group_bytes"), (F.col("sha") == F.col("group_sha")) & (F.col("size") == F.col("group_bytes")), "left")
    keep = F.when(F.col("n").isNotNull(), F.col("last")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
