"""Ranked search beside a full scan, with ties, repeated and null ids, odd letters and tiny shards."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from platter.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def full_scan(docs, items, k=20):
    held = [(key, Counter(t), len(t)) for key, text in docs if (t := terms(text))]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for key, counts, n in held:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * counts[w] // (1000 * counts[w] + 12 * m))
                for w in terms(text)
                if w in counts
            )
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, i + 1, key, -minus) for i, (minus, _, _, key) in enumerate(sorted(scores)[:k])]
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2:])))


def corpus(seed, n):
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["été", "ÉTÉ", "naïve", "\U0001f600", "ñ", "x9", "K"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, pick.choice([" ", "-", "\n", "\x7f"]).join(pick.choices(words, weights, k=pick.choice([1, 3, 20, 60, 300])))) for i in range(n)]
    docs += [(5, "w1 W2 w3"), (5, "w1 W2 w3"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (n, None), (n + 1, ""), (n + 2, " .,;\t"), (n + 3, "w9 " * 5000)]
    docs += [(n + 10 + i, "w3 w70 w70 same text") for i in range(150)]
    items = [(i, " ".join(pick.choices(words, weights, k=pick.choice([1, 2, 8, 40])))) for i in range(40)]
    return docs, items + [(90, None), (91, "unheard-of"), (92, "w1 w1 w1 W1"), (92, "w2"), (None, "w3 same"), (93, "w70 same text"), (94, "!!")]


@pytest.mark.parametrize("seed, docs_a_shard, postings", [(1, 1 << 16, 1 << 21), (2, 300, 1 << 21), (3, 1 << 16, 700)])
def test_same_as_a_full_scan(spark, monkeypatch, seed, docs_a_shard, postings):
    monkeypatch.setattr(ls, "SHARD_DOCS", docs_a_shard)
    monkeypatch.setattr(ls, "SHARD_POSTINGS", postings)
    monkeypatch.setattr(ls, "WINDOWS", (0, 16, 64, 256, 1024))
    docs, items = corpus(seed, 1500)
    left = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id bigint, text string, term string, score int").repartition(3)
    right = spark.createDataFrame([(*i, 1) for i in items], "item_id int, text string, mark int")
    got = ls.search(ls.build_index(left), right, k=7)
    assert order(map(tuple, got.collect())) == order(full_scan(docs, items, 7))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id int, text string")
    none = ls.build_index(docs.where("false"))
    assert ls.search(none, items).count() == 0
    assert ls.search(ls.build_index(docs.where("doc_id = 2")), items).count() == 0
    assert ls.search(ls.build_index(docs), items.where("false")).count() == 0


def shard_lists(docs):
    """The lists of one shard, and its document lengths."""
    built = ls.ShardBuilder()
    for key, text in docs:
        built.add(key, text.encode())
    rows = built.rows(0).to_pylist()
    sizes = np.frombuffer(rows[0]["heads"], "<i8").reshape(-1, 3)[:, 2]
    n_docs, n_terms = rows[0]["n_docs"], rows[0]["n_terms"]
    norm = ls.norms(sizes, n_docs, n_terms)
    return {r["term"].decode(): ls.Postings(r["n_docs"], r["heads"], r["peaks"], r["body"], norm, n_docs, n_terms) for r in rows[1:]}, sizes


def test_blocks_come_back_as_they_went_in_and_their_maxima_are_exact():
    pick = random.Random(4)
    docs = [(i, " ".join(["a"] * (pick.randrange(1, 4) if i % 2 else 90_000 * (i == 700)) + ["b"] * (i % 5 == 0) + [f"c{i}"] + ["pad"] * pick.randrange(40))) for i in range(3000)]
    lists, sizes = shard_lists(docs)
    for word in ("a", "b", "c7", "pad"):
        held = lists[word]
        held.unpack(np.arange(len(held.first))[::2])
        held.unpack(np.arange(len(held.first)))
        want = [(i, n) for i, (_, text) in enumerate(docs) if (n := text.split().count(word))]
        assert held.docs.tolist() == [i for i, _ in want]
        assert held.impact.tolist() == ls.impacts(np.array([n for _, n in want]), held.norm[held.docs]).tolist()
        assert held.bound.tolist() == [held.impact[b : b + ls.BLOCK].max() for b in range(0, len(want), ls.BLOCK)]


def test_most_blocks_of_idle_lists_stay_packed():
    docs = [(i, "common " + ("rare words here" if i < 30 else f"filler{i} other{i}")) for i in range(20_000)]
    lists, sizes = shard_lists(docs)
    heap = ls.Heap(20, np.arange(len(docs)), np.zeros(len(docs), int))
    ls.best_documents([(9000, lists["rare"]), (9000, lists["words"]), (1, lists["common"])], heap, len(docs))
    assert sorted(heap.docs.tolist()) == list(range(20))
    assert lists["common"].open.mean() < 0.1


def test_long_documents_leave_64_bits_only_on_paper():
    sizes = np.array([3, 1 << 40], np.int64)
    assert ls.norms(sizes, 1 << 30, 1 << 41).tolist() == [75 + 25 * s * (1 << 30) // (1 << 41) for s in (3, 1 << 40)]
