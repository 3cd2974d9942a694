"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.session import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b: longs); the root is one node of the component.

    Each pass points every node to its least neighbour or itself, follows the pointers to
    their ends, and keeps the links between different ends. A pass at least halves the
    components that still have links; all tables are written, none is collected.
    """
    edges = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    whole = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        roots = stored(roots.withColumn("root", F.least("node", "root")), "roots")
        while True:
            above = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = roots.join(above, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved"))
            jumped = stored(jumped, "roots")
            moved = not jumped.where("moved").isEmpty()
            roots = jumped.select("node", "root")
            if not moved:
                break
        whole = roots if whole is None else _through(whole, roots)
        a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b"))
        left = edges.join(a, "a").join(b, "b").where("a_root <> b_root")
        edges = stored(left.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "links")
    return whole if whole is not None else links.sparkSession.createDataFrame([], "node bigint, root bigint")


def _through(whole: DataFrame, roots: DataFrame) -> DataFrame:
    """The roots of ``whole`` replaced by their own."""
    above = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return stored(whole.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")


def merge(whole: DataFrame | None, links: DataFrame) -> DataFrame:
    """``whole`` (node, root) with the components that further links join."""
    if whole is None:
        return components(links)
    a, b = (whole.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b"))
    lifted = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    more = components(lifted)
    above = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = whole.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = more.join(whole.select("node"), "node", "left_anti").select("node", "root")
    return stored(old.unionByName(new), "roots")
