"""Which rows of a batch get their keys when every key value goes to the earliest row that is let in.

A row turned away takes none of its keys, so a later row may still get them: whether a row is
let in hangs on earlier rows, those on yet earlier ones, and so on. Taken one by one that is a
chain as long as the batch. Here the clash graph (rows that share a key value) is contracted:

* A row that is the first on all its keys is let in. A row with just one earlier rival is let
  in exactly if that rival is not. Such rows form trees, and pointer jumping brings each of
  them to the root of its tree and the parity of the way there: a chain of n rows takes
  about log2(n) joins.
* What clashes with a row let in is turned away.
* If rows with several undecided rivals are left, their connected components are labelled, by
  contraction again, and each component of at most ``FOLD_ROWS`` rows is folded in order, all
  of them at once. Larger ones go into the next round, which settles at least their first row
  and all that hangs on it.

Every step is a join or a sum over small columns. A key value that very many rows claim is two
rows per task by the time its first claims are known.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platter.session import stored

FOLD_ROWS = 256


def _claims(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(position, key, value), a row per row and key; a null claims nothing."""
    claims = F.array(*(F.struct(F.lit(i).alias("key"), F.col(k).cast("string").alias("value")) for i, k in enumerate(keys)))
    return rows.select("position", F.inline(claims)).where("value IS NOT NULL")


def _rivals(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per row: whether it ``leads`` on all keys, and its only earlier rival (``parent``) if it has just one."""
    claims = _claims(rows, keys)
    turn = F.row_number().over(Window.partitionBy("key", "value").orderBy("position"))
    heads = claims.withColumn("turn", turn).where("turn <= 2").groupBy("key", "value").agg(F.min("position").alias("first"), F.max("position").alias("second"))
    met = claims.join(heads, ["key", "value"])
    behind = F.when(F.col("position") != F.col("first"), F.col("first"))
    tagged = met.groupBy("position").agg(
        F.bool_and(behind.isNull()).alias("leads"),
        F.bool_and(behind.isNull() | (F.col("position") == F.col("second"))).alias("near"),
        F.min(behind).alias("low"),
        F.max(behind).alias("high"),
    )
    free = rows.select("position").join(tagged, "position", "left")
    parent = F.when(F.col("near") & (F.col("low") == F.col("high")), F.col("low"))
    return free.select("position", F.coalesce("leads", F.lit(True)).alias("leads"), parent.alias("parent"))


def _jump(links: DataFrame, label: str) -> DataFrame:
    """Follow (position, up, odd, leads) to the end of each way; ``odd`` and ``leads`` come to be the way's parity and its end's."""
    while True:
        above = links.select(F.col("position").alias("up"), F.col("up").alias("top"), F.col("odd").alias("more"), F.col("leads").alias("end"))
        step = links.join(above, "up").select(
            "position",
            F.col("top").alias("up"),
            (F.col("odd") != F.col("more")).alias("odd"),
            F.col("end").alias("leads"),
            (F.col("top") != F.col("up")).alias("moved"),
        )
        step = stored(step, label)
        links = step.drop("moved")
        if step.where("moved").isEmpty():
            return links


def clash_components(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(position, root): rows that share a key value, directly or through others, have the same root."""
    claims = _claims(rows, keys)
    first = claims.groupBy("key", "value").agg(F.min("position").alias("b"))
    edges = stored(claims.join(first, ["key", "value"]).select(F.col("position").alias("a"), "b").where("a <> b").distinct(), "clashes")
    roots = rows.select("position", F.col("position").alias("root"))
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy(F.col("a").alias("position")).agg(F.min("b").alias("b"))
        up = least.select("position", F.least("position", "b").alias("up"), F.lit(False).alias("odd"), F.lit(False).alias("leads"))
        tops = _jump(stored(up, "clashes"), "clashes").select(F.col("position").alias("root"), F.col("up").alias("top"))
        roots = stored(roots.join(tops, "root", "left").select("position", F.coalesce("top", "root").alias("root")), "clashes")
        a, b = (tops.select(F.col("root").alias(c), F.col("top").alias(f"{c}_top")) for c in ("a", "b"))
        edges = stored(edges.join(a, "a").join(b, "b").where("a_top <> b_top").select(F.col("a_top").alias("a"), F.col("b_top").alias("b")).distinct(), "clashes")
    return roots


def _folded(small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(position, let_in) for rows with a ``root`` whose components are small, each taken in order."""
    tags = F.array_compact(F.array(*(F.concat(F.lit(f"{i}:"), F.col(k).cast("string")) for i, k in enumerate(keys))))
    queue = F.array_sort(F.collect_list(F.struct("position", tags.alias("tags"))))
    start = F.struct(F.array().cast("array<string>").alias("held"), F.array().cast("array<struct<position:bigint,let_in:boolean>>").alias("seen"))

    def take(state: Column, row: Column) -> Column:
        free = ~F.arrays_overlap(state["held"], row["tags"])
        verdict = F.struct(row["position"].cast("bigint").alias("position"), free.alias("let_in"))
        return F.struct(
            F.when(free, F.concat(state["held"], row["tags"])).otherwise(state["held"]).alias("held"),
            F.concat(state["seen"], F.array(verdict)).alias("seen"),
        )

    walked = small.groupBy("root").agg(queue.alias("queue")).select(F.aggregate("queue", start, take)["seen"].alias("seen"))
    return walked.select(F.inline("seen"))


def first_come(rows: DataFrame, keys: Sequence[str], fold_rows: int = FOLD_ROWS) -> tuple[DataFrame, DataFrame]:
    """The positions let in, and those turned away with the first key (``key``) that an earlier row holds.

    ``rows`` is (position, *keys) with positions that no two rows share; a null
    key clashes with nothing.
    """
    open_rows = rows.select("position", *keys)
    let_in, turned_away = [], []
    while True:
        tagged = stored(_rivals(open_rows, keys), "rivals")
        links = tagged.select("position", F.coalesce("parent", "position").alias("up"), F.col("parent").isNotNull().alias("odd"), "leads")
        decided = _jump(links, "rivals").where("leads")
        winners = open_rows.join(decided.where("NOT odd"), "position", "left_semi")
        let_in.append(winners)
        turned_away.append(open_rows.join(decided.where("odd"), "position", "left_semi"))
        rest = open_rows.join(decided, "position", "left_anti")
        beaten = _claims(rest, keys).join(_claims(winners, keys), ["key", "value"], "left_semi").select("position").distinct()
        judged = stored(rest.join(beaten.withColumn("beaten", F.lit(True)), "position", "left"), "rivals")
        turned_away.append(judged.where("beaten").drop("beaten"))
        open_rows = judged.where("beaten IS NULL").drop("beaten")
        if open_rows.isEmpty():
            break
        labels = clash_components(open_rows, keys)
        small = labels.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") <= fold_rows)
        rooted = open_rows.join(labels.join(small, "root", "left_semi"), "position")
        folded = stored(_folded(rooted, keys), "folded")
        let_in.append(open_rows.join(folded.where("let_in"), "position", "left_semi"))
        turned_away.append(open_rows.join(folded.where("NOT let_in"), "position", "left_semi"))
        open_rows = stored(open_rows.join(folded, "position", "left_anti"), "rivals")
        if open_rows.isEmpty():
            break
    holders = stored(reduce(DataFrame.unionByName, let_in), "holders")
    late = reduce(DataFrame.unionByName, turned_away)
    for key in keys:
        late = late.join(holders.select(key, F.col("position").alias(f"_held_{key}")).where(F.col(key).isNotNull()), key, "left")
    held = F.coalesce(*(F.when(F.col(f"_held_{k}") < F.col("position"), F.lit(k)) for k in keys))
    return holders.select("position"), late.select("position", held.alias("key"))
