"""Hard negatives beside a brute-force version, on rows with ties, copies, gaps and odd vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from platter.llm import hard_negatives as hn


def brute(rows, is_anchor, positives=5, negatives=5):
    held = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (label, [math.floor(256 * x) for x in vector])
        held[key] = min(held.get(key, row), row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for key in filter(is_anchor, held):
        label, own = held[key]
        scores = sorted((-dot(own, v), k, lab) for k, (lab, v) in held.items() if k != key)
        for minus, pos, _ in [s for s in scores if s[2] == label][:positives]:
            fit = [(-m, k) for m, k, lab in scores if lab != label and -80 * minus <= -100 * m <= -100 * minus]
            out += [(key, pos, i + 1, k, -minus, s) for i, (s, k) in enumerate(fit[:negatives])]
    return sorted(out)


def rows_of(seed, n, dims):
    pick = random.Random(seed)
    hot = [pick.uniform(-1, 1) for _ in range(dims)]
    rows = []
    for i in range(n):
        vector = hot if i % 3 == 0 else [pick.uniform(-1, 1) for _ in range(dims)] if i % 3 == 1 else [x + pick.uniform(-0.3, 0.3) for x in hot]
        rows.append((i, [float(np.float32(x)) for x in vector], i % 4 if i % 5 else 1))
    rows += [rows[7], (8, [0.5] * dims, -1), (None, hot, 1), (900, None, 1), (901, hot, None), (902, [math.nan] * dims, 1), (903, [None] * dims, 1)]
    rows += [(904, [math.inf] * dims, 1), (905, [], 2), (906, [1.0, -1.0], 3), (910, [2.0] * dims, 2), (1000, hot + [1.0], 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, planes string, id int")


@pytest.mark.parametrize("dims", [3, 8, 21])
def test_same_as_brute_force(spark, dims, monkeypatch):
    monkeypatch.setattr(hn, "TILE_ROWS", 50)
    rows = rows_of(dims, 240, dims)
    got = hn.hard_negatives(frame(spark, rows).repartition(5), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda k: k % 10 == 0)


def test_empty_tables_lone_rows_and_huge_components(spark):
    assert hn.hard_negatives(frame(spark, []), F.lit(True)).count() == 0
    assert hn.hard_negatives(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)]), F.lit(True)).count() == 0
    with pytest.raises(ValueError, match="55 bits"):
        hn.hard_negatives(frame(spark, [(1, [1e30], 1)]), F.lit(True))


def test_look_ups_are_exact_inner_products():
    some = np.random.default_rng(3)
    anchors, rows = some.integers(-300, 300, (7, 24)), some.integers(-512, 512, (50, 24))
    planes = hn.bit_planes(rows, 11)
    assert (hn.from_planes(planes) == rows).all()
    assert (hn.plane_scores(hn.subset_sums(anchors), planes) == rows @ anchors.T).all()
