"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The statistics are the measurements of the rule ledger, worked out by Spark once per text,
as ratios that do not depend on its length alone. Trees are grown by histograms: each
statistic is cut into ``BINS`` quantile bins, and every level of a tree reads sums of
gradients per bin. The finished forest is four flat arrays over complete binary trees, and
a batch of documents walks all trees level by level with numpy indexing.

Training reads at most about ``sample_rows`` labelled rows, chosen by a hash of their id:
the documented bound of the classifier. Everything else covers all documents.

Defined results: null and empty texts get the score of a text without words; labels that
are null, or whose document is missing, are not learned from; of several labels of an id
the highest counts; with no labels, or only one kind, all scores are that kind's share
(0.5 without any). A row per row, repeated ones too; an empty table gives an empty result.
Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm.common import bounded_sample
from platter.llm.quality_rules import MEASURES, ledger
from platter.session import stored

SAMPLE_ROWS = 20_000
BINS = 64
DEPTH = 4
TREES = 60
RATE = 0.15
LEAST_WEIGHT = 4.0
SHRINK = 1.0

STATISTICS = ("words", "word_length", "symbols", "repeated", "repeated_lines", "capitals", "marks", "distinct", "line_words")


def statistics(measured: np.ndarray) -> np.ndarray:
    """Rows of ``STATISTICS`` from rows of ``MEASURES``."""
    m = dict(zip(MEASURES, measured.astype(float).T))
    words, chars, lines = (np.maximum(m[k], 1.0) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack(
        [
            np.log1p(m["n_words"]),
            m["word_chars"] / words,
            m["n_symbols"] / words,
            m["n_repeat_words"] / words,
            m["n_dup_lines"] / lines,
            m["n_capitals"] / chars,
            m["n_marks"] / words,
            m["n_distinct_words"] / words,
            np.log1p(m["n_words"] / lines),
        ],
        axis=1,
    )


@dataclass
class Forest:
    """Complete binary trees as arrays: node i of a tree has the children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; a row goes right if its value is larger
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        for at in range(0, len(x), 8192):
            part = x[at : at + 8192]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(trees)), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.cut[trees, node])
            total[at : at + 8192] += self.value[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """A forest for log loss."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        base = {0.0: -20.0, 1.0: 20.0}.get(share, 0.0)
        return Forest(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(column, np.arange(1, BINS) / BINS)) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    n_features = x.shape[1]
    margin = np.full(len(y), base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            local = node - first
            sums = np.zeros((2, n_features, wide, BINS))
            for f in range(n_features):
                slot = local * BINS + binned[:, f]
                for k, weight in enumerate((g, h)):
                    sums[k, f] = np.bincount(slot, weight, wide * BINS).reshape(wide, BINS)
            left = np.cumsum(sums, axis=3)
            whole = left[..., -1:]
            right = whole - left
            gain = left[0] ** 2 / (left[1] + SHRINK) + right[0] ** 2 / (right[1] + SHRINK) - whole[0] ** 2 / (whole[1] + SHRINK)
            gain = np.where((left[1] >= LEAST_WEIGHT) & (right[1] >= LEAST_WEIGHT), gain, 0.0)
            for k in range(wide):
                f, b = np.unravel_index(np.argmax(gain[:, k]), (n_features, BINS))
                if gain[f, k, b] > 1e-6 and b < len(cuts[f]):
                    feature[first + k], cut[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + SHRINK)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(cut)
        values.append(value)
    return Forest(base, np.array(features), np.array(thresholds), np.array(values))


def train(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """A forest from the ledger rows of labelled documents; ``labels`` holds only rows that may be learned from."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id"))
    known = bounded_sample(known.agg(F.max(F.col(label_col)).cast("double").alias("y")), "label_id", sample_rows)
    # One row for each sampled id, however many documents share it, so that what is collected keeps the bound.
    single = known.join(measured, F.col("label_id") == F.col(id_col)).groupBy("label_id", "y").agg(F.min(F.struct(*MEASURES)).alias("least"))
    rows = single.select("y", "least.*").orderBy("y", *MEASURES).toArrow()
    table = np.stack([rows.column(c).to_numpy() for c in ("y", *MEASURES)], axis=1).astype(float)
    return grow(statistics(table[:, 1:]), table[:, 0])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: id and ``score``; ``learn_from`` says which labels may be read."""
    measured = stored(ledger(docs, id_col, text_col), "statistics")
    forest = train(measured, labels.where(learn_from), id_col, label_col, sample_rows)
    names = list(MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(forest.score(statistics(x)))], names=["id", "score"])

    rows = measured.select(F.col(id_col).alias("id"), *names)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
