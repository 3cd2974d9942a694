"""Claims settled by contraction beside the same claims taken one by one."""

import random

import pytest

from platter.operators import clashes

KEYS = ("srn", "mail")


def one_by_one(rows):
    held, let_in, late = [{}, {}], [], []
    for position, *values in sorted(rows):
        taken = [v is not None and v in h for v, h in zip(values, held)]
        if any(taken):
            late.append((position, KEYS[taken.index(True)]))
        else:
            let_in.append(position)
            for v, h in zip(values, held):
                h[v] = True
    return let_in, late


def settle(spark, rows, **how):
    frame = spark.createDataFrame(rows, "position bigint, srn string, mail string").repartition(3)
    got, late = clashes.first_come(frame, KEYS, **how)
    return sorted(r[0] for r in got.collect()), sorted(map(tuple, late.collect()))


def chain(order):
    """A path of rows in the order of their positions: row i shares its srn with the row before and its mail with the row after, by turns."""
    rows = []
    for i, p in enumerate(order):
        left, right = f"v{i}", f"v{i + 1}"
        rows.append((p, left, right) if i % 2 else (p, right, left))
    return rows


@pytest.fixture
def written(monkeypatch):
    labels = []
    real = clashes.stored

    def counted(frame, label):
        labels.append(label)
        return real(frame, label)

    monkeypatch.setattr(clashes, "stored", counted)
    return labels


def test_a_long_chain_takes_a_logarithm_of_steps(spark, written):
    rows = chain(range(1000))
    assert settle(spark, rows) == one_by_one(rows)
    assert one_by_one(rows)[0] == list(range(0, 1000, 2))
    assert len(written) <= 16


def test_a_shuffled_chain_takes_few_steps(spark, written):
    order = list(range(600))
    random.Random(3).shuffle(order)
    rows = chain(order)
    assert settle(spark, rows) == one_by_one(rows)
    assert len(written) <= 40


@pytest.mark.parametrize("fold_rows", [1, 20, 10_000])
def test_random_claims_with_hot_values_and_nulls(spark, fold_rows):
    pick = random.Random(fold_rows)
    rows = [
        (i * 3, pick.choice(["hot", None, *(f"s{n}" for n in range(60))]) if i % 3 else "hot" if i > 40 else f"s{i}", pick.choice([None, *(f"m{n}" for n in range(50))]))
        for i in range(260)
    ]
    assert settle(spark, rows, fold_rows=fold_rows) == one_by_one(rows)


def test_components(spark):
    pick = random.Random(9)
    rows = [(i, f"s{pick.randrange(120)}", f"m{pick.randrange(120)}") for i in range(100)]
    frame = spark.createDataFrame(rows, "position bigint, srn string, mail string")
    got = dict(map(tuple, clashes.clash_components(frame, KEYS).collect()))
    root = {i: i for i in range(100)}
    for _ in rows:
        for i, *a in rows:
            for j, *b in rows:
                if a[0] == b[0] or a[1] == b[1]:
                    root[i] = root[j] = min(root[i], root[j])
    groups = lambda of: {frozenset(i for i in of if of[i] == r) for r in set(of.values())}
    assert groups(got) == groups(root)


def test_no_rows(spark):
    assert settle(spark, []) == ([], [])
    assert settle(spark, [(5, None, None), (6, None, None)]) == ([5, 6], [])
