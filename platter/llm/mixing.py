"""Mixing sources to target weights: token weights raked to margins, documents sampled by them.

Tokens are summed to cells of (source, language, topic). Values that a margin does not
name fall under ``*``, so the cells are at most the product of the named values plus one
each: a bound set by the caller's targets, whatever the data. Iterative proportional
fitting scales the cells to one margin after the other until all hold; the quotient of
fitted and observed tokens is the weight of a cell's documents. A margin that has no target for
``*`` keeps the observed share of its unnamed values, and the named targets share out what is left. The fit is exact: the
weighted tokens meet every margin. With ``max_weight`` a rare cell gives at most that many times what it has, and the
margins are met as far as that allows; ``margin_report`` says how far. A document is drawn with
probability weight / largest weight, by a hash of its id, so the draw repeats anywhere.

Defined results: null source, language or topic count as ``*``; a null text has no tokens
and the weight of its cell; a target value without any tokens is left out and the rest of
its margin scaled up; targets of 0 empty their cells, but a margin none of whose targets has
tokens stays as observed; if no cell has tokens, every weight is 1. Rows with the same id share their draw; a null id is drawn as empty text. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platter.llm.common import free_name, whole_text, words_of

REST = "*"
MAX_ROUNDS = 200
TOLERANCE = 1e-9

#: Topics by the first pattern that the text has; the rest is general prose.
TOPICS = (
    ("licensing", r"(?i)licen[cs]e|copyright"),
    ("contacts", r"(?i)@[a-z0-9-]+\.[a-z]"),
    ("tabular", r"\|[^|\n]{0,200}\|"),
)

TARGETS = {
    "source": {"src0": 0.15, REST: 0.85},
    "lang": {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14},
    "topic": {"licensing": 0.03, "contacts": 0.02, "tabular": 0.03, REST: 0.92},
}


def topic_of(text: Column) -> Column:
    """Topic of a text by ``TOPICS``."""
    topic = F.lit(REST)
    for name, pattern in reversed(TOPICS):
        topic = F.when(text.rlike(pattern), F.lit(name)).otherwise(topic)
    return topic


def rake(observed: np.ndarray, margins: list[np.ndarray], max_weight: float | None = None) -> np.ndarray:
    """``observed`` scaled, ``max_weight`` times at most if given, so that its sums along each axis are in the proportions of ``margins``.

    A margin that gives nothing to any value with tokens is replaced by the observed one.
    """
    total = observed.sum()
    if total <= 0:
        return observed.copy()
    goals = []
    for axis, margin in enumerate(margins):
        now = observed.sum(axis=tuple(a for a in range(observed.ndim) if a != axis))
        goal = np.where(now > 0, margin, 0.0)
        if goal.sum() <= 0:
            goal = now
        goals.append(goal / goal.sum() * total)
    fitted = observed.astype(float)
    for _ in range(MAX_ROUNDS):
        worst = 0.0
        for axis, goal in enumerate(goals):
            others = tuple(a for a in range(fitted.ndim) if a != axis)
            now = fitted.sum(axis=others)
            worst = max(worst, float(np.abs(now - goal).max()) / total)
            factor = np.divide(goal, now, out=np.zeros_like(now), where=now > 0)
            fitted *= np.expand_dims(factor, others)
        if max_weight is not None:
            fitted = np.minimum(fitted, max_weight * observed)
        if worst < TOLERANCE:
            break
    return fitted


def margin_of(named: Mapping[str, float], names: list[str], tokens: np.ndarray) -> np.ndarray:
    """Shares of ``names``, in order: the targets, and for an unnamed ``*`` its share of the observed ``tokens``."""
    margin = np.array([named.get(n, 0.0) for n in names], dtype=float)
    if REST in named or tokens.sum() <= 0:
        return margin
    rest = names.index(REST)
    share = tokens[rest] / tokens.sum()
    there = np.where(tokens > 0, margin, 0.0).sum()
    margin *= (1 - share) / there if there > 0 else 0.0
    margin[rest] = share
    return margin


def _cell(column: Column, named: Mapping[str, float]) -> Column:
    return F.when(column.isin(*[k for k in named if k != REST]), column).otherwise(F.lit(REST))


def mixture(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    topic: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 1,
    max_weight: float | None = None,
) -> tuple[DataFrame, str, Column, Column, Column]:
    """``docs`` with a struct of cell and token count, its name, and weight, probability and draw of a row.

    Keeps all columns of ``docs``; one pass sums the cells, the rest is a projection.
    """
    targets = targets or TARGETS
    axes = ("source", "lang", "topic")
    text = whole_text(text_col)
    parts = {
        "source": F.col("source").cast("string"),
        "lang": F.col("lang").cast("string"),
        "topic": topic_of(text) if topic is None else topic,
    }
    struct = F.struct(
        *[_cell(parts[a], targets[a]).alias(a) for a in axes],
        F.size(words_of(text)).cast("long").alias("n_tokens"),
    )
    cell = free_name(docs, "_mix")
    mixed = docs.withColumn(cell, struct)
    names = [list(dict.fromkeys([*targets[a], REST])) for a in axes]
    sums = mixed.groupBy(*[F.col(cell)[a].alias(a) for a in axes]).agg(F.sum(f"{cell}.n_tokens").alias("tokens")).collect()
    observed = np.zeros([len(n) for n in names])
    for row in sums:  # bounded: one row per cell
        observed[tuple(n.index(row[a]) for n, a in zip(names, axes))] = row["tokens"]
    sums_of = [observed.sum(axis=tuple(x for x in range(len(axes)) if x != i)) for i in range(len(axes))]
    margins = [margin_of(targets[a], n, t) for n, a, t in zip(names, axes, sums_of)]
    fitted = rake(observed, margins, max_weight)
    weights = np.divide(fitted, observed, out=np.ones_like(fitted), where=observed > 0)
    top = weights[observed > 0].max() if (observed > 0).any() else 1.0
    entries = []
    for at in np.ndindex(*weights.shape):
        entries += [F.lit("\t".join(n[i] for n, i in zip(names, at))), F.lit(float(weights[at]))]
    key = F.concat_ws("\t", *[F.col(cell)[a] for a in axes])
    weight = F.element_at(F.create_map(*entries), key)
    probability = F.least(F.lit(1.0), weight / F.lit(float(top)))
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"#{seed}")).cast("binary"))
    unit = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)
    return mixed, cell, weight, probability, unit < probability


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, **options) -> DataFrame:
    """The drawn rows of ``docs``, with the columns of ``docs``."""
    mixed, cell, _, _, drawn = mixture(docs, targets, **options)
    return mixed.where(drawn).drop(cell)


def mixing_report(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, **options) -> DataFrame:
    """One row per row: id, its cell, ``n_tokens``, ``weight``, ``probability``, ``sampled``."""
    id_col = options.get("id_col", "doc_id")
    mixed, cell, weight, probability, drawn = mixture(docs, targets, **options)
    return mixed.select(
        F.col(id_col),
        *[F.col(cell)[a].alias(a) for a in ("source", "lang", "topic")],
        F.col(cell)["n_tokens"].alias("n_tokens"),
        weight.alias("weight"),
        probability.alias("probability"),
        drawn.alias("sampled"),
    )


def margin_report(report: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """Per margin and value of a ``mixing_report``: ``target`` (null where the observed share is kept), shares of tokens ``observed``, ``reached`` by weight and ``drawn``."""
    targets = targets or TARGETS
    axes = ("source", "lang", "topic")
    kept = report.withColumn("_drawn", F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0)).withColumn("_weighted", F.col("weight") * F.col("n_tokens"))
    cells = kept.groupBy(*axes).agg(*[F.sum(c).cast("double").alias(c) for c in ("n_tokens", "_weighted", "_drawn")])
    each = cells.select(F.inline(F.array(*[F.struct(F.lit(a).alias("margin"), F.col(a).alias("value"), "n_tokens", "_weighted", "_drawn") for a in axes])))
    sums = each.groupBy("margin", "value").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "_weighted", "_drawn")])
    of_margin = Window.partitionBy("margin")
    share = [(F.col(c) / F.nullif(F.sum(c).over(of_margin), F.lit(0.0))).alias(n) for c, n in (("n_tokens", "observed"), ("_weighted", "reached"), ("_drawn", "drawn"))]
    named = [(a, v, float(t)) for a, values in targets.items() for v, t in values.items()]
    wanted = report.sparkSession.createDataFrame(named, "margin string, value string, target double")
    return sums.select("margin", "value", *share).join(wanted, ["margin", "value"], "left").select("margin", "value", "target", "observed", "reached", "drawn")
