"""Ranked lexical search by Block-Max MaxScore over sharded, block-compressed postings.

``build_index`` is one pass over the documents without a shuffle: each task cuts its rows
into shards of bounded size and writes, for every term of a shard, the postings in blocks of
128, bit-packed with the widths each block needs. A block also carries its competitive pairs
of (occurrences, document length): those that no other pair of the block beats in both. From
them the exact block maximum follows for any collection figures, so an index needs no figures
of the corpus, and shards of further documents can be added to it as rows.

``search`` takes the collection figures from the index, weighs the items' terms, and sends
each shard's lists of those terms to one task. There the lists of an item are ordered by
their largest possible contribution; as long as the smallest of them together cannot reach
the score of the k-th best document so far, they are non-essential: only documents of the
other, essential lists are candidates. A candidate is dropped as soon as its score so far
and the maxima of its blocks in the remaining lists stay below that mark, before any of these
blocks is unpacked. The shards' best documents meet in a window that keeps the k best.

The items are streamed to each shard from the shared folder and may be many; a shard holds
at most ``SHARD_DOCS`` documents and, unless one document alone has more, ``SHARD_POSTINGS``
distinct terms of documents. No candidates are capped: results are those of a full scan.

Terms are the maximal runs of characters other than ASCII separators, A-Z in lower case.
Defined results: null and empty texts have no terms, are in no result and do not count as
documents; every row counts, those with repeated or null ids too (null ids come last among
equal scores); every row of the items is a query of its own, also where ids repeat; an item
without terms that any document holds has no rows; empty tables give none. Very long texts
are read whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platter.llm.common import lower_az, whole_text
from platter.llm.shared_parts import shared_table, table_batches
from platter.session import stored

BLOCK = 128
SHARD_DOCS = 1 << 16
SHARD_POSTINGS = 1 << 21
WINDOWS = (0, 512, 4096, SHARD_DOCS)
ITEM_BATCH = 256

#: The ASCII characters that separate terms.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

INDEX = "shard bigint, term binary, n_docs bigint, n_terms bigint, heads binary, peaks binary, body binary"


def _cells(data: np.ndarray, ends: np.ndarray, width: int) -> pa.Array:
    """Binary cells out of one array: each ends where ``ends`` says, in entries of ``width`` bytes."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * width
    raw = pa.py_buffer(np.ascontiguousarray(data).tobytes())
    cells = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), raw])
    return cells.cast(pa.binary())


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1]


class ShardBuilder:
    """The rows of one shard, from the terms of its documents."""

    def __init__(self):
        self.ids, self.sizes, self.owner, self.terms, self.times = [], array("q"), array("i"), array("i"), array("i")
        self.vocabulary: defaultdict[bytes, int] = defaultdict(count().__next__)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.terms) >= SHARD_POSTINGS

    def add(self, key: int | None, text: bytes) -> None:
        words = text.translate(_PLAIN).split()
        if words:
            counted = Counter(words)
            self.owner.extend([len(self.ids)] * len(counted))
            self.terms.extend(map(self.vocabulary.__getitem__, counted))
            self.times.extend(counted.values())
            self.ids.append(key)
            self.sizes.append(len(words))

    def rows(self, shard: int) -> pa.RecordBatch:
        sizes = np.array(self.sizes, np.int64)
        names = sorted(self.vocabulary)
        place = np.empty(len(names), np.int64)
        place[[self.vocabulary[n] for n in names]] = np.arange(len(names))
        order = np.argsort(place[np.array(self.terms, np.int32)], kind="stable")
        term, doc, times = place[np.array(self.terms, np.int32)][order], np.array(self.owner, np.int64)[order], np.array(self.times, np.int64)[order]

        lists = np.searchsorted(term, np.arange(len(names) + 1))
        within = np.arange(len(term)) - np.repeat(lists[:-1], np.diff(lists))
        starts = np.flatnonzero(within % BLOCK == 0)
        counts = np.diff(np.append(starts, len(term)))
        block = np.repeat(np.arange(len(starts)), counts)
        gaps = np.diff(doc, prepend=0) - 1
        gaps[starts] = 0
        extra = times - 1
        wide, deep = _bits(np.maximum.reduceat(gaps, starts)), _bits(np.maximum.reduceat(extra, starts))
        size = (counts * (wide + deep) + 7) // 8
        at = 8 * (np.cumsum(size) - size)
        bits = np.zeros(8 * int(size.sum()), np.uint8)
        inner = np.arange(len(term)) - np.repeat(starts, counts)
        for values, width, first in ((gaps, wide, at), (extra, deep, at + counts * wide)):
            own, place_ = width[block], first[block] + inner * width[block]
            for k in range(int(width.max())):
                has = own > k
                bits[place_[has] + k] = (values[has] >> k) & 1

        length = sizes[doc]
        order = np.lexsort((length, -times, block))
        key = length[order] - block[order] * (int(sizes.max()) + 1)
        beats = np.append(True, key[1:] < np.minimum.accumulate(key)[:-1])
        pairs = np.stack([times[order][beats], length[order][beats]], 1).astype("<i4")
        n_pairs = np.bincount(block[order][beats], minlength=len(starts))
        heads = np.stack([doc[starts], wide + 256 * deep, n_pairs], 1).astype("<i4")

        blocks = np.searchsorted(starts, lists[1:])  # how many blocks end before each list does
        upto = lambda x: np.append(0, np.cumsum(x))[blocks]
        known = pa.array(self.ids, pa.int64())
        own = np.stack([known.fill_null(0).to_numpy(), known.is_null().to_numpy(zero_copy_only=False), sizes], 1).astype("<i8")
        out = [
            pa.array([None, *names], pa.binary()),
            pa.array(np.append(len(sizes), np.diff(lists))),
            pa.array(np.append(sizes.sum(), np.add.reduceat(times, lists[:-1]))),
            pa.concat_arrays([pa.array([own.tobytes()], pa.binary()), _cells(heads, blocks, 12)]),
            pa.concat_arrays([pa.array([b""], pa.binary()), _cells(pairs, upto(n_pairs), 8)]),
            pa.concat_arrays([pa.array([b""], pa.binary()), _cells(np.packbits(bits, bitorder="little"), upto(size), 1)]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(names) + 1, shard)), *out], names=[f.split()[0] for f in INDEX.split(", ")])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``docs`` as a written table: a row per shard and term, and one per shard with its documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = TaskContext.get().partitionId() << 32, ShardBuilder()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                held.add(key.as_py(), text.as_py())
                if held.full():
                    yield held.rows(shard)
                    shard, held = shard + 1, ShardBuilder()
        if held.ids:
            yield held.rows(shard)

    return stored(rows.mapInArrow(run, INDEX), "search-index")


def norms(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The length figure of each document."""
    if len(sizes) and 25 * int(sizes.max()) * n_docs >= 1 << 63:
        return np.array([75 + 25 * int(s) * n_docs // n_terms for s in sizes], np.int64)
    return 75 + 25 * sizes * n_docs // n_terms


def impacts(times: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What an occurrence count adds to a score, for weight 1."""
    return 1_000_000_000 * times // (1000 * times + 12 * norm)


class Postings:
    """A term's list in a shard; blocks are unpacked when they are needed, once."""

    def __init__(self, n: int, heads: bytes, peaks: bytes, body: bytes, norm: np.ndarray, n_docs: int, n_terms: int):
        table, pairs = np.frombuffer(heads, "<i4").reshape(-1, 3), np.frombuffer(peaks, "<i4").reshape(-1, 2).astype(np.int64)
        self.first, self.wide, self.deep = table[:, 0].astype(np.int64), table[:, 1] & 255, table[:, 1] >> 8
        self.counts = np.full(len(table), BLOCK)
        self.counts[-1] = n - BLOCK * (len(table) - 1)
        size = (self.counts * (self.wide + self.deep) + 7) // 8
        self.at = 8 * (np.cumsum(size) - size)
        self.body = np.frombuffer(body + bytes(8), np.uint8)
        best = impacts(pairs[:, 0], norms(pairs[:, 1], n_docs, n_terms))
        self.bound = np.maximum.reduceat(best, np.cumsum(table[:, 2]) - table[:, 2])
        self.most = int(self.bound.max())
        self.norm, self.open = norm, np.zeros(len(table), bool)
        #: Until a block is unpacked its first document stands in for all of it, which keeps the order.
        self.docs, self.impact = np.repeat(self.first, self.counts), np.zeros(n, np.int64)

    def _read(self, at: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The numbers of ``width`` bits that begin at the bits ``at``."""
        byte, value = at >> 3, np.zeros(len(at), np.int64)
        for k in range((int(width.max()) + 14) // 8 if len(width) else 0):
            value |= self.body[byte + k].astype(np.int64) << (8 * k)
        return (value >> (at & 7)) & ((np.int64(1) << width) - 1)

    def unpack(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.open[blocks]]
        if not len(blocks):
            return
        self.open[blocks] = True
        counts = self.counts[blocks]
        starts = np.cumsum(counts) - counts
        inner = np.arange(counts.sum()) - np.repeat(starts, counts)
        wide, deep = (np.repeat(w[blocks].astype(np.int64), counts) for w in (self.wide, self.deep))
        at = np.repeat(self.at[blocks], counts)
        steps = self._read(at + inner * wide, wide) + 1
        steps[starts] = 0
        run = np.cumsum(steps)
        docs = np.repeat(self.first[blocks] - run[starts], counts) + run
        times = self._read(at + np.repeat(counts, counts) * wide + inner * deep, deep) + 1
        place = np.repeat(blocks * BLOCK, counts) + inner
        self.docs[place], self.impact[place] = docs, impacts(times, self.norm[docs])

    def between(self, low: int, high: int) -> slice:
        """Where the documents from ``low`` to ``high`` stand, unpacked."""
        self.unpack(np.arange(max(0, np.searchsorted(self.first, low, "right") - 1), np.searchsorted(self.first, high)))
        return slice(*np.searchsorted(self.docs, [low, high]))

    def block_of(self, docs: np.ndarray) -> np.ndarray:
        """The block that would hold each document; -1 before the first."""
        return np.searchsorted(self.first, docs, "right") - 1

    def at_docs(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Impacts of single documents, 0 where the list does not have them."""
        self.unpack(np.unique(blocks[blocks >= 0]))
        place = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(self.docs[place] == docs, self.impact[place], 0)


class Heap:
    """The k best documents so far: higher scores first, then smaller ids, null ids last."""

    def __init__(self, k: int, ids: np.ndarray, absent: np.ndarray):
        self.k, self.ids, self.absent = k, ids, absent
        self.docs, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    def mark(self) -> int:
        """The least score that can still enter."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.k else 1

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        docs, scores = np.append(self.docs, docs), np.append(self.scores, scores)
        best = np.lexsort((self.ids[docs], self.absent[docs], -scores))[: self.k]
        self.docs, self.scores = docs[best], scores[best]


def best_documents(lists: list[tuple[int, Postings]], heap: Heap, n_docs: int) -> None:
    """Fill ``heap`` with the best documents of a shard for weighted lists."""
    lists = sorted(lists, key=lambda x: x[0] * x[1].most)
    sums = np.cumsum([weight * postings.most for weight, postings in lists])
    edges = [*(w for w in WINDOWS if w < n_docs), n_docs]
    for low, high in zip(edges, edges[1:]):
        mark = heap.mark()
        idle = int(np.searchsorted(sums, mark))  # lists that cannot reach the mark together
        if idle == len(lists):
            return
        scores = np.zeros(high - low, np.int64)
        for weight, postings in lists[idle:]:
            part = postings.between(low, high)
            scores[postings.docs[part] - low] += weight * postings.impact[part]
        found = np.flatnonzero(scores)
        if idle:
            found = found[scores[found] + sums[idle - 1] >= mark]
        docs, score = found + low, scores[found]
        if idle and len(docs):
            blocks = np.stack([p.block_of(docs) for _, p in lists[:idle]])
            bounds = np.stack([np.where(b >= 0, w * p.bound[b], 0) for (w, p), b in zip(lists, blocks)])
            rest = bounds.sum(axis=0)
            for i in range(idle - 1, -1, -1):
                fit = score + rest >= mark
                docs, score, rest, blocks, bounds = docs[fit], score[fit], rest[fit], blocks[:, fit], bounds[:, fit]
                if not len(docs):
                    break
                weight, postings = lists[i]
                score = score + weight * postings.at_docs(docs, blocks[i])
                rest = rest - bounds[i]
        fit = score >= mark
        if fit.any():
            heap.add(docs[fit], score[fit])


def terms_of(text: Column) -> Column:
    return F.filter(F.split(lower_az(text), SEPARATORS), lambda w: w != "")


def search(index: DataFrame, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Each item's ``k`` best documents: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    figures = index.where("term IS NULL").agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = figures["n"] or 0, figures["l"] or 0
    marked = stored(items.select(F.col(id_col).alias("item"), terms_of(whole_text(text_col)).alias("terms")).withColumn("mark", F.monotonically_increasing_id()), "search-items")
    words = marked.select("mark", F.explode("terms").alias("word")).groupBy("mark", "word").agg(F.count(F.lit(1)).alias("times"))
    words = words.select("mark", F.col("word").cast("binary").alias("term"), "times")
    lists = index.join(words.select("term").distinct(), "term", "left_semi")
    held_by = lists.groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))) * F.col("times")
    weighed = words.join(held_by, "term").select("mark", F.struct("term", weight.cast("long").alias("weight")).alias("part"))
    wanted = shared_table(weighed.where("part.weight > 0").groupBy("mark").agg(F.collect_list("part").alias("parts")), "search-wanted")

    def run(shard: pa.Table) -> pa.Table:
        rows = dict(zip(shard.column("term").to_pylist(), zip(*(shard.column(c).to_pylist() for c in ("n_docs", "heads", "peaks", "body")))))
        own = np.frombuffer(rows.pop(None)[1], "<i8").reshape(-1, 3)
        ids, absent, norm = own[:, 0], own[:, 1], norms(own[:, 2], n_docs, n_terms)
        postings: dict[bytes, Postings] = {}
        out = []
        for batch in table_batches(wanted, ITEM_BATCH):
            for mark, parts in zip(batch.column("mark").to_pylist(), batch.column("parts").to_pylist()):
                own_lists = []
                for part in parts:
                    term = part["term"]
                    if term not in postings and term in rows:
                        postings[term] = Postings(*rows.pop(term), norm, n_docs, n_terms)
                    if term in postings:
                        own_lists.append((part["weight"], postings[term]))
                if own_lists:
                    heap = Heap(k, ids, absent)
                    best_documents(own_lists, heap, len(ids))
                    found = pa.array(ids[heap.docs], mask=absent[heap.docs].astype(bool))
                    out.append(pa.table([pa.array(np.full(len(heap.docs), mark)), found, pa.array(heap.scores)], schema=result))
        return pa.concat_tables(out) if out else result.empty_table()

    result = pa.schema([("mark", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    needed = lists.unionByName(index.where("term IS NULL")).select("shard", "term", "n_docs", "heads", "peaks", "body")
    tops = needed.groupBy("shard").applyInArrow(run, "mark bigint, doc_id bigint, score bigint")
    place = Window.partitionBy("mark").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = tops.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return best.join(marked.select("mark", "item"), "mark").select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
