"""Interpolated modified Kneser-Ney over word pairs, counted in Spark, read from mapped arrays.

Counting. Words of the training rows are counted by their 64-bit hash; the sorted hashes are
the vocabulary, and a word's place in them is its id. With that, a pair (word before, word) is
one number, exact and without a table of strings; scrambled by a bijection it falls into one
of S shards of even size, whatever words are frequent. Tasks count the pairs of a few million
tokens at a time and send each shard one packed block. A shard is merged to a sorted array of
pairs with their counts, and sends on what it knows of each word: how often and with how many
different words it is followed (by one, two, three or more sightings), and by how many it is
preceded. These are summed by ranges of ids. No task sees more than a shard or a range, whose
number follows the size of the corpus; the driver sees file names and ten sums.

Scoring. Workers map the arrays and look a batch's distinct pairs up by binary search:

    P(w | u) = max(c(u w) - D(c), 0) / c(u) + share(u) * P(w)
    P(w) = max(n(w) - D'(n), 0) / pairs + share / (V + 1)

n(w) is the number of different words before w, D and D' the three discounts that the counts
of counts give, each ``LEAST_DISCOUNT`` at least, so every score is finite, also where all training
rows are copies. An unknown word has the last term alone; after an unknown word P(w) counts.

Tokens are words in lower-case A-Z and one end per text, which also counts as a token; a text
starts after a begin mark that is never predicted.

Defined results: null and empty texts consist of the end; rows whose ``learn_from`` is null
are not learned from; with nothing to learn from every token has probability 1 / (V + 1) = 1.
A row per row, repeated ones too; an empty table gives an empty result. Very long texts are
read whole. Other columns are not read. A pair seen 2^32 times or more, or over 3 billion different words, are
refused with an error. Two words share an id if their 64-bit hashes are equal.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm.arrays import Maps, mix64, pack, unmix64, unpack, write_arrays
from platter.llm.common import WORD, whole_text
from platter.session import fresh_path, stored

#: No word, as it is white space.
END = "\n"

#: A discount of 0 would leave unseen words after some words without any probability; copied texts give such counts.
LEAST_DISCOUNT = 0.1

TOKENS_AT_ONCE = 1_500_000
SHARD_TOKENS = 2_000_000
SHARD_WORDS = 2_000_000
RANGE_IDS = 1 << 18
TEXTS_AT_ONCE = 512

_WORDS, _PAIRS, _STATS = ("<u8", "<i8"), ("<u8", "<u4"), ("<i8", "<u4", "<u4", "<u4", "<u4")


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def tokens(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All tokens of the (lower-cased) texts, and the number of each text's tokens."""
    each = [WORD.findall(t) for t in texts]
    for words in each:
        words.append(END)
    return list(chain.from_iterable(each)), np.fromiter(map(len, each), np.int64, len(each))


def discounts(counts: list[int]) -> np.ndarray:
    """D by count 0, 1, 2 and 3 or more, from how many have count 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (float(c) for c in counts)
    d = np.array([0.0, 0.5, 1.0, 1.5])
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        d[1] = 1 - 2 * y * n2 / n1
        d[2] = 2 - 3 * y * n3 / n2
        if n3:
            d[3] = 3 - 4 * y * n4 / n3
    return np.clip(d, [0.0, *[LEAST_DISCOUNT] * 3], [0.0, 1.0, 2.0, 3.0])


def _lower_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(at, TEXTS_AT_ONCE)
            yield part, pc.ascii_lower(part.column(column)).to_pylist()


class Vocabulary:
    """Sorted word hashes with counts, one file for each range of hashes."""

    def __init__(self, files: list[tuple[str, int]]):
        self.shards = Maps(files, _WORDS)
        self.before = np.cumsum([0, *(n for _, n in files)])

    def find(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and training counts of ``words``."""
        hashes = np.fromiter(map(word_hash, words), np.uint64, len(words))
        ids, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        order = np.argsort(hashes)
        bits = len(self.shards).bit_length() - 1
        shard = (hashes[order] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(words), np.int64)
        for k in np.unique(shard).tolist():
            rows = order[shard == k]
            known, count = self.shards[k]
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, hashes[rows]), len(known) - 1)
            hit = known[at] == hashes[rows]
            ids[rows[hit]] = at[hit] + self.before[k]
            counts[rows[hit]] = count[at[hit]]
        return ids, counts


@dataclass
class Model:
    """The finished arrays; a worker maps those that it needs."""

    vocabulary: Vocabulary
    n_words: int
    n_tokens: int
    pairs: Maps  # by shard
    ranges: Maps  # by range of ids
    pair_counts: list[int]
    word_counts: list[int]
    n_pairs: int

    def stats(self, ids: np.ndarray) -> np.ndarray:
        """Rows of (followed, by 1, by 2, by 3 or more, preceded) for ids; zeros for -1."""
        out = np.zeros((5, len(ids)))
        part = ids // RANGE_IDS
        for k in np.unique(part[ids >= 0]).tolist():
            rows = np.flatnonzero((part == k) & (ids >= 0))
            at = ids[rows] - k * RANGE_IDS
            for i, column in enumerate(self.ranges[k]):
                out[i, rows] = column[at]
        return out

    def count(self, pairs: np.ndarray) -> np.ndarray:
        """Training counts of scrambled pairs, given in ascending order."""
        out = np.zeros(len(pairs), np.int64)
        if not len(self.pairs):
            return out
        bits = len(self.pairs).bit_length() - 1
        shard = (pairs >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(pairs), np.int64)
        ends = np.searchsorted(shard, np.arange(len(self.pairs) + 1))
        for k in np.unique(shard).tolist():
            known, count = self.pairs[k]
            if len(known):
                wanted = pairs[ends[k] : ends[k + 1]]
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                out[ends[k] : ends[k + 1]] = np.where(known[at] == wanted, count[at], 0)
        return out

    def word_probability(self, preceded: np.ndarray) -> np.ndarray:
        """P(w) from the number of different words before w."""
        floor = 1.0 / (self.n_words + 1)
        if not self.n_pairs:
            return np.full(len(preceded), floor)
        d = discounts(self.word_counts[:4])
        share = (d[1] * self.word_counts[0] + d[2] * self.word_counts[1] + d[3] * self.word_counts[4]) / self.n_pairs
        return np.maximum(preceded - d[np.minimum(preceded, 3).astype(int)], 0) / self.n_pairs + share * floor

    def score(self, texts: list[str]) -> list[np.ndarray]:
        """For lower-cased texts: tokens, known tokens, base score, score."""
        words, sizes = tokens(texts)
        distinct = list(set(words))
        ids, counts = self.vocabulary.find(distinct)
        place = dict(zip(distinct, range(len(distinct))))
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        base = np.log10((counts + 0.5) / (self.n_tokens + 0.5 * (self.n_words + 1)))
        stats = self.stats(ids)
        alone = self.word_probability(stats[4])
        #: One place more, for the begin mark.
        before = np.empty_like(at)
        before[1:] = at[:-1]
        before[starts] = len(distinct)
        begin = self.stats(np.array([self.n_words])) if self.n_pairs else np.zeros((5, 1))
        context = np.concatenate([stats, begin], axis=1)
        all_ids = np.append(ids, self.n_words)
        u, w = all_ids[before], ids[at]
        seen = np.zeros(len(at), np.int64)
        both = np.flatnonzero((u >= 0) & (w >= 0))
        if len(both) and self.n_pairs:
            keys, back = np.unique(mix64(u[both] * (self.n_words + 1) + w[both]), return_inverse=True)
            seen[both] = self.count(keys)[back]
        followed = context[0][before]
        d = discounts(self.pair_counts[:4])
        share = d[1] * context[1] + d[2] * context[2] + d[3] * context[3]
        p = alone[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            mixed = (np.maximum(seen - d[np.minimum(seen, 3)], 0) + share[before] * p) / followed
        p = np.where(followed > 0, mixed, p)
        sums = [np.add.reduceat(x, starts) for x in ((counts[at] > 0).astype(np.int64), base[at], np.log10(p))]
        return [sizes, *sums]


def _range_of(ids: np.ndarray) -> np.ndarray:
    return (ids // np.uint64(RANGE_IDS)).astype(np.int64)


def count_words(rows: DataFrame, folder: str) -> tuple[Vocabulary, int, int]:
    """The vocabulary of ``rows`` (one column, text), its size and the number of tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()

        def out():
            keys = np.fromiter(map(word_hash, tally), np.uint64, len(tally)).view(np.int64)
            made = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(tally.values()), pa.int64())], names=["h", "n"])
            tally.clear()
            return made

        for _, texts in _lower_batches(batches, 0):
            tally.update(tokens(texts)[0])
            if len(tally) > 500_000:
                yield out()
        yield out()

    counts = stored(rows.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "lm-words")
    n_words, n_tokens = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(0, int(np.ceil(np.log2(max(1, n_words / SHARD_WORDS)))))
    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)

    def write(group: pa.Table) -> pa.Table:
        h = group.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h)
        path = write_arrays(folder, "words", [h[order], group.column("n").to_numpy()[order]])
        return pa.table({"shard": group.column("shard")[:1], "path": [path], "n": pa.array([len(h)], pa.int64())})

    files = counts.withColumn("shard", shard).groupBy("shard").applyInArrow(write, "shard int, path string, n bigint").collect()
    by_shard = {f["shard"]: (f["path"], f["n"]) for f in files}
    return Vocabulary([by_shard.get(k, ("", 0)) for k in range(1 << bits)]), n_words, n_tokens


def _occurrences(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4, and 3 or more."""
    few = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)
    return [int(few[1]), int(few[2]), int(few[3]), int(few[4]), int(few[3:].sum())]


def train(rows: DataFrame) -> Model:
    """A model of ``rows``: one column, whole texts."""
    folder = fresh_path(rows.sparkSession, "lm")
    vocabulary, n_words, n_tokens = count_words(rows, folder)
    if not n_tokens:
        return Model(vocabulary, 0, 0, Maps([], _PAIRS), Maps([], _STATS), [0] * 5, [0] * 5, 0)
    bits = max(0, int(np.ceil(np.log2(n_tokens / SHARD_TOKENS)))) if n_tokens > SHARD_TOKENS else 0
    wide = n_words + 1
    if wide * wide >= 1 << 63:
        raise ValueError(f"{n_words} different words: a pair of them does not fit 63 bits")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out():
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            shard = (pairs >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(pairs), np.int64)
            there = np.unique(shard)
            ends = np.append(np.searchsorted(shard, there), len(pairs))
            blocks = [pack([pairs[a:b], n[a:b]]) for a, b in zip(ends[:-1], ends[1:])]
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(blocks, pa.binary())], names=["shard", "block"])

        for _, texts in _lower_batches(batches, 0):
            words, sizes = tokens(texts)
            distinct = list(set(words))
            known = dict(zip(distinct, vocabulary.find(distinct)[0].tolist()))
            ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            before = np.empty_like(ids)
            before[1:] = ids[:-1]
            before[np.cumsum(sizes) - sizes] = n_words
            held.append(mix64(before * wide + ids))
            if sum(map(len, held)) >= TOKENS_AT_ONCE:
                yield out()
        if held:
            yield out()

    def merge(group: pa.Table) -> pa.Table:
        blocks = [unpack(b, 2) for b in group.column("block").to_pylist()]
        pairs, n = (np.concatenate([b[i] for b in blocks]) for i in (0, 1))
        del blocks
        order = np.argsort(pairs)
        pairs, n = pairs[order], n[order]
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
        pairs, n = pairs[first], np.add.reduceat(n, first)
        if n.max() > 0xFFFFFFFF:
            raise ValueError("a pair of words occurs 2^32 times or more")
        path = write_arrays(folder, "pairs", [pairs, n.astype("<u4")])
        shard = group.column("shard")[0].as_py()
        parts, out = [-1], [json.dumps([shard, path, len(pairs), *_occurrences(n)]).encode()]
        key = unmix64(pairs)
        u, w = key // np.uint64(wide), key % np.uint64(wide)
        order = np.argsort(u, kind="stable")
        u, n = u[order], n[order]
        first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        follow = [u[first], *(np.add.reduceat(x.astype(np.uint64), first) for x in (n, n == 1, n == 2, n >= 3))]
        heads, preceded = np.unique(w, return_counts=True)
        for kind, columns in enumerate((follow, [heads, preceded])):
            ranges = _range_of(columns[0])
            there = np.unique(ranges)
            ends = np.append(np.searchsorted(ranges, there), len(ranges))
            for r, a, b in zip(there, ends[:-1], ends[1:]):
                parts.append(int(r))
                out.append(bytes([kind]) + pack([c[a:b] for c in columns]))
        return pa.table({"part": pa.array(parts, pa.int64()), "block": pa.array(out, pa.binary())})

    def gather(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        blocks = group.column("block").to_pylist()
        if part < 0:
            return pa.table({"part": pa.array([-1] * len(blocks), pa.int64()), "said": [b.decode() for b in blocks]})
        low = part * RANGE_IDS
        size = min(RANGE_IDS, n_words + 1 - low)
        stats = np.zeros((5, size), np.int64)
        for block in blocks:
            columns = unpack(block[1:], 2 if block[0] else 5)
            at = columns[0].astype(np.int64) - low
            if block[0]:
                stats[4][at] += columns[1].astype(np.int64)
            else:
                stats[:4, at] += np.stack(columns[1:]).astype(np.int64)
        path = write_arrays(folder, "stats", [s.astype(t) for s, t in zip(stats, _STATS)])
        said = json.dumps([part, path, size, int(stats[4].sum()), *_occurrences(stats[4])])
        return pa.table({"part": pa.array([part], pa.int64()), "said": [said]})

    blocks = rows.mapInArrow(count, "shard int, block binary")
    sums = blocks.groupBy("shard").applyInArrow(merge, "part bigint, block binary")
    found = sums.groupBy("part").applyInArrow(gather, "part bigint, said string").collect()  # a row for each file
    shards = sorted(json.loads(f["said"]) for f in found if f["part"] < 0)
    ranges = sorted(json.loads(f["said"]) for f in found if f["part"] >= 0)
    by_shard = {s[0]: (s[1], s[2]) for s in shards}
    by_range = {r[0]: (r[1], r[2]) for r in ranges}
    return Model(
        vocabulary,
        n_words,
        n_tokens,
        Maps([by_shard.get(k, ("", 0)) for k in range(1 << bits)], _PAIRS),
        Maps([by_range.get(k, ("", 0)) for k in range(n_words // RANGE_IDS + 1)], _STATS),
        [sum(s[3 + i] for s in shards) for i in range(5)],
        [sum(r[4 + i] for r in ranges) for i in range(5)],
        sum(r[3] for r in ranges),
    )


def score_texts(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``perplexity``.

    The model is counted from the rows where ``learn_from`` holds, then all rows are scored.
    """
    model = train(docs.where(learn_from).select(whole_text(text_col).alias("body")))
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _lower_batches(batches, 1):
            sizes, known, base, score = model.score(texts)
            out = [part.column(0), sizes, known, np.full(len(sizes), model.n_tokens), base, score, 10.0 ** (-score / sizes)]
            yield pa.RecordBatch.from_arrays([out[0], *map(pa.array, out[1:])], names=names)

    names = ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
