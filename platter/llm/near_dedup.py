"""Near duplicates by Order MinHash, verified by banded alignment.

Shingles are ``SHINGLE`` words, lower-cased in A-Z, each labelled with its number among equal
ones of the text, so that they are all different. For each of ``SKETCHES`` orders the
``SAMPLED`` least shingles are taken and put back in text order; their hash is a bucket key. Two texts
meet in a bucket if they agree on these shingles and their sequence: the chance grows with the
similarity to the power of ``SAMPLED`` and falls when passages are moved. Texts of up to ``SHORT``
shingles and those that can be similar to one have single shingles as keys: of n shingles at least
similarity x n are in any similar text, so of the n, in the order of their hashes, the first n less that number, plus one,
cannot all be missing from the first of the other. Such texts always share a key.

Similarity is that of an alignment: the longest chain of equal labelled shingles that keeps the
order in both texts, over all shingles of both less the chain. Chains lie in a band around the
diagonal; whoever leaves it has too many unmatched shingles to reach the threshold, so the band
changes no verdict. ``SIMILAR`` or more makes a link.

Equal texts (same words) become one node first, so groups of copies cost nothing later. Each
bucket compares its members with one anchor, the node that meets most others in all its buckets:
in a group of near copies that is the text they come from, or close to it, and the group becomes
one class without being compared pair by pair. From then on only nodes of different classes are
compared. Buckets of up to ``FEW`` members are compared in full. In larger buckets that still hold
several classes only pairs can be similar that differ from the anchor in the same shingles: with
D(x) the shingles that only one of x and the anchor has, x and y differ in |D(x)| + |D(y)| - 2 |D(x) and D(y)|
shingles, and two texts that are not both similar to the anchor need a part of D in common. So the members
meet again by the rarest elements of D, and only if each shares enough of them with other classes. Which elements several classes have, and how many rows, is
counted in packed blocks and kept in sorted arrays that workers map; an element that one class alone has never becomes a row. That is
exact but for texts with the anchor's shingles in another order, which only meet anchors. Under each element they meet ``ANCHORS`` anchors, then 8 times as many, until it holds one class or
all its members have been anchors. Edits made once, and whatever stands around one frequent
passage, bring no texts together, and no pair that could still join two classes is left out.
Before an alignment, pairs are held against samples of ``SIGNATURE`` least shingles: if the share
they agree on is under ``ROUGH``, the chance of a similarity of 0.8 is about 2e-08 (of 64 shingles at most 31 agree).

The chance that long texts of similarity 0.8 share no bucket is (1 - 0.8^5)^32, 3 in a million; it is highest
just above ``SHORT`` shingles, 25 in a million for 16 of 20 in common.

Defined results: texts without words (null, empty, blank) are equal; a text of fewer words than a
shingle is one shingle; of a class the least id stays, nulls last, and rows repeated with the same
id and text stay together here (``drop_near`` keeps one of them). An empty table gives an empty result. Columns other than
id and text are not read. Different texts are one node if 64-bit hashes of their words are equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platter.llm.arrays import map_arrays, mix64, pack, unpack, write_arrays
from platter.llm.common import WORD, free_name, whole_text
from platter.llm.components import merge
from platter.session import fresh_path, stored

SHINGLE = 5
SIMILAR = 0.8
SAMPLED = 5
SKETCHES = 32
SIGNATURE = 64
ROUGH = 0.5
ANCHORS = 4
FEW = 8
SHORT = 12
ELEMENTS_AT_ONCE = 1 << 20
SHARD_ELEMENTS = 1 << 17
PAIRS_AT_ONCE = 256

_SEEDS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix64(_SEEDS) | np.uint64(1)
_SINGLE = np.uint64(0xD1B54A32D192ED03)
_PLACES = mix64(np.arange(101, 101 + max(SHINGLE, SAMPLED), dtype=np.uint64)) | np.uint64(1)


class Hasher:
    """Word hashes of one worker, kept up to a bound."""

    def __init__(self, most: int = 200_000):
        self.most, self.known = most, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = {w for w in words if w not in known}
        if len(known) + len(new) > self.most:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def node_of(words: list[str]) -> int:
    """63-bit hash of a sequence of words."""
    return xxhash.xxh3_64_intdigest(" ".join(words)) >> 1


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Labelled shingles of a text, in order, given the hashes of its words."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    k = min(SHINGLE, n)
    grams = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        grams += hashes[i : n - k + 1 + i] * _PLACES[i]
    grams = mix64(grams)
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if same.any():
        first = np.flatnonzero(np.append(True, ~same))
        number = np.arange(len(ranked)) - np.repeat(first, np.diff(np.append(first, len(ranked))))
        label = np.empty(len(ranked), np.uint64)
        label[order] = number.astype(np.uint64)
        grams = np.where(label > 0, mix64(grams + label * _PLACES[0]), grams)
    return grams


def bucket_keys(labelled: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """One key for each order: the least shingles, in text order; for short texts single shingles."""
    n = len(labelled)
    if not n:
        return np.empty(0, np.int64)
    if n * similar <= SHORT + 1e-9:
        some = n - max(1, math.ceil(similar * n - 1e-9)) + 1
        single = mix64(np.sort(labelled)[:some] ^ _SINGLE).view(np.int64)
        #: Whatever is similar to a text of up to SHORT shingles has such keys too.
        return single if n <= SHORT else np.concatenate([single, _sketched_keys(labelled)])
    return _sketched_keys(labelled)


def _sketched_keys(labelled: np.ndarray) -> np.ndarray:
    take = min(SAMPLED, len(labelled))
    ranks = (labelled[None, :] ^ _SEEDS[:, None]) * _ODD[:, None]
    ranks ^= ranks >> np.uint64(32)
    if take < len(labelled):
        at = np.sort(np.argpartition(ranks, take - 1, axis=1)[:, :take], axis=1)
    else:
        at = np.broadcast_to(np.arange(take), (SKETCHES, take))
    return mix64((labelled[at] * _PLACES[:take]).sum(axis=1, dtype=np.uint64) ^ _SEEDS).view(np.int64)


def signature(labelled: np.ndarray) -> np.ndarray:
    least = labelled if len(labelled) <= SIGNATURE else np.partition(labelled, SIGNATURE - 1)[:SIGNATURE]
    return np.sort(least)


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity estimated from two signatures; exact if both hold all shingles."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    first = np.append(True, both[1:] != both[:-1])
    size = min(SIGNATURE, int(first.sum()))
    last = both[np.flatnonzero(first)[size - 1]]
    return float((~first & (both <= last)).sum()) / size


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Similarity of two sequences of labelled shingles by the longest chain in the band."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b[order], a), max(len(b) - 1, 0))
    i = np.flatnonzero(b[order][at] == a) if len(b) else np.empty(0, np.int64)
    j = order[at[i]]
    #: A chain through (i, j) leaves |i - j| shingles unmatched at least.
    band = total * (1 - least) / (1 + least) + 1e-9
    j = j[np.abs(i - j) <= band]
    if len(j) * (1 + least) < least * total - 1e-9:
        return len(j) / (total - len(j))
    if (np.diff(j) > 0).all():
        chain = len(j)
    else:
        ends: list[int] = []
        from bisect import bisect_left

        for x in j.tolist():
            k = bisect_left(ends, x)
            ends[k : k + 1] = [x]
        chain = len(ends)
    return chain / (total - chain)


def _words(batch: pa.RecordBatch, column: int) -> Iterator[list[str]]:
    return (WORD.findall(t) for t in pc.ascii_lower(batch.column(column)).to_pylist())


def _sketch(batches: Iterator[pa.RecordBatch], similar: float = SIMILAR) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            nodes, sizes, keys, signs = [], [], [], []
            for words in _words(part, 2):
                labelled = shingles(hasher(words))
                nodes.append(node_of(words))
                sizes.append(len(labelled))
                keys.append(bucket_keys(labelled, similar))
                signs.append(signature(labelled).tobytes())
            columns = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["id", "mark", "node", "size", "keys", "sign"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            nodes, held = [], []
            for node, words in zip(part.column(0).to_pylist(), _words(part, 1)):
                if node_of(words) == node:
                    nodes.append(node)
                    held.append(shingles(hasher(words)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(held, pa.binary())], names=["node", "shingles"])


def _passing(test, least: float):
    """Keeps the pairs (a, b) whose two arrays reach ``least`` in ``test``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in (2, 3))
            good = [test(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(left, right)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return run


def _links(pairs: DataFrame, signs: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """The pairs that are similar.

    They are written first, so that the number of tasks can follow from their number: rounds with few pairs start few workers.
    """
    pairs = stored(pairs, "pairs")
    tasks = max(1, math.ceil(pairs.count() / PAIRS_AT_ONCE))

    def with_both(frame: DataFrame, values: DataFrame) -> DataFrame:
        value = values.columns[1]
        for side in ("a", "b"):
            frame = frame.join(values.select(F.col("node").alias(side), F.col(value).alias(f"of_{side}")), side)
        return frame.select("a", "b", "of_a", "of_b").coalesce(tasks)

    rough = with_both(pairs, signs).mapInArrow(_passing(agreement, ROUGH * similar / SIMILAR), "a bigint, b bigint")
    return with_both(rough, texts).mapInArrow(_passing(aligned, similar - 1e-9), "a bigint, b bigint")


def _may_meet(rows: DataFrame, by: str, similar: float) -> DataFrame:
    """The ``rows`` that can be similar to a row of another class (``root``) with the same ``by``.

    A row has ``size``, ``differs`` and ``shared`` as in ``_pairs``, and what is left out there for any partner is left
    out here before it is joined or dealt out. Two texts can only be similar if differs + differs - 2 shared is at most a part
    of both sizes, whichever of the two ``shared`` is taken. So each class is brought to the least that it adds to
    either side, each group to the least of any class and the least of the others, and a row is held against the classes
    not its own.
    """
    part = (1 - similar) / (1 + similar)
    own = F.col("differs") - part * F.col("size")
    least = rows.groupBy(by, "root").agg(F.min(own).alias("one"), F.min(own - 2 * F.col("shared")).alias("two"))
    group = Window.partitionBy(by)
    firsts = [F.min(F.struct(c, "root")).over(group).alias(f"first_{c}") for c in ("one", "two")]
    least = least.select(by, "root", "one", "two", *firsts)
    seconds = [F.min(F.when(F.col("root") != F.col(f"first_{c}.root"), F.col(c))).alias(f"next_{c}") for c in ("one", "two")]
    bounds = least.groupBy(by).agg(F.first("first_one").alias("first_one"), F.first("first_two").alias("first_two"), *seconds)
    bounds = bounds.where("next_one IS NOT NULL").withColumnRenamed(by, "_by")

    def others(c: str) -> Column:
        return F.when(F.col("root") != F.col(f"first_{c}.root"), F.col(f"first_{c}.{c}")).otherwise(F.col(f"next_{c}"))

    room = part * F.col("size") - F.col("differs") + 1e-6
    fits = (others("one") <= room + 2 * F.col("shared")) & (others("two") <= room)
    return rows.join(bounds, (F.col(by) == F.col("_by")) & fits, "left_semi")


def _open_groups(groups: DataFrame, whole: DataFrame | None, similar: float) -> DataFrame:
    """The rows of ``groups`` (key, node, ...) that may be similar to one of another class, with the class as ``root``."""
    now = groups.join(whole, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return _may_meet(now, "key", similar)


def _pairs(anchors: DataFrame, members: DataFrame, similar: float) -> DataFrame:
    """Pairs of an anchor and a member of its group that are of different classes and may be similar.

    A row tells ``differs``, the size of its set in the group, and ``shared``, how much of that another class
    may have too; sets differ in no less than both sizes without twice the smaller shared part.
    """
    columns = ("node", "size", "differs", "shared", "root")
    left = anchors.select("key", *[F.col(c).alias(f"a_{c}") for c in columns]).withColumnRenamed("a_node", "a")
    right = members.select("key", *[F.col(c).alias(f"b_{c}") for c in columns]).withColumnRenamed("b_node", "b")
    most = (1 - similar) / (1 + similar) * (F.col("a_size") + F.col("b_size")) + 1e-6
    near = F.col("a_differs") + F.col("b_differs") - 2 * F.least("a_shared", "b_shared") <= most
    met = left.join(right, (left["key"] == right["key"]) & (F.col("a") != F.col("b")) & (F.col("a_root") != F.col("b_root")) & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _differences(crowd: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """(key, node, size, differs, shared): members of large groups by what tells them from their anchor.

    ``crowd``: node, anchor, root. A key is an anchor and a shingle that only one of it and the node has.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own, base = ([np.frombuffer(x, np.uint64) for x in part.column(c).to_pylist()] for c in (3, 4))
                apart = [np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in zip(own, base)]
                columns = [*(pa.array(list(map(len, x)), pa.int32()) for x in (own, base)), pa.array(apart, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=["node", "anchor", "root", "size", "base", "apart"])

    of_anchor = texts.select(F.col("node").alias("anchor"), F.col("shingles").alias("base"))
    #: The short rows meet by anchor, which many have in common; with the texts of both they are dealt out by node.
    both = crowd.join(of_anchor, "anchor").join(texts, "node").select("node", "anchor", "root", "shingles", "base")
    apart = both.mapInArrow(tell, "node bigint, anchor bigint, root bigint, size int, base int, apart array<bigint>")
    apart = stored(apart.withColumn("differs", F.size("apart")).withColumn("shared", F.size("apart")), "apart")
    apart = stored(_may_meet(apart, "anchor", similar).select("node", "anchor", "root", "size", "base", "apart"), "apart")
    table = _mixed_elements(apart)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "node", "size", "differs", "shared", "members"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                node, size, base = (part.column(c).to_numpy() for c in ("node", "size", "base"))
                sets = part.column("apart")
                differs = sets.value_lengths().to_numpy().astype(np.int64)
                row, keys = _element_keys(part)
                members = table.find(keys)
                row, keys, members = row[members > 0], keys[members > 0], members[members > 0]
                shared = np.bincount(row, minlength=len(node))
                order = np.lexsort((keys, members, row))
                rank = np.arange(len(row)) - np.repeat(np.cumsum(shared) - shared, shared)
                #: Rare ones first, two texts with ``least`` in common share one of the first of each.
                kept = rank < np.maximum(shared - _least_shared(size, base, differs, similar) + 1, 0)[row]
                row, keys, members = row[order][kept], keys[order][kept], members[order][kept]
                columns = [keys.view(np.int64), node[row], size[row], differs[row].astype(np.int32), shared[row].astype(np.int32), members]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return apart.mapInArrow(rarest, "key bigint, node bigint, size int, differs int, shared int, members bigint")


def _least_shared(size: np.ndarray, base: np.ndarray, differs: np.ndarray, similar: float) -> np.ndarray:
    """The part of its differences that a text has in common with a similar text of another class at least.

    A text near its anchor can only meet one that is not.
    """
    most = (1 - similar) / (1 + similar)
    close = differs <= most * (size + base)
    least = np.where(close, differs + (base - size.astype(np.int64)) * most, differs + 1 - (1 - similar) / similar * size)
    return np.maximum(1, np.ceil(least / 2 - 1e-6)).astype(np.int64)


def _element_keys(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """For all elements of the rows' difference sets: the row, and a hash of anchor and element."""
    sets = part.column("apart")
    row = np.repeat(np.arange(len(sets)), sets.value_lengths().to_numpy())
    anchor = mix64(part.column("anchor").to_numpy().view(np.uint64))
    return row, mix64(anchor[row] + sets.flatten().to_numpy().view(np.uint64))


class Elements:
    """Elements that several classes have, with the number of their members: sorted arrays, mapped when first needed."""

    def __init__(self, shards: list[tuple[str, int]]):
        self.shards, self.open = shards, {}

    def __getstate__(self):
        return {"shards": self.shards, "open": {}}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Members of each key, 0 if it is not there."""
        out, bits = np.zeros(len(keys), np.int64), len(self.shards).bit_length() - 1
        shard = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        for k in np.unique(shard).tolist():
            if k not in self.open:
                self.open[k] = map_arrays(*self.shards[k], ("<u8", "<i8"))
            known, members = self.open[k]
            if len(known):
                rows = np.flatnonzero(shard == k)
                at = np.minimum(np.searchsorted(known, keys[rows]), len(known) - 1)
                out[rows] = np.where(known[at] == keys[rows], members[at], 0)
        return out


def _summed(columns: list[np.ndarray]) -> list[np.ndarray]:
    """(key, members, least root, largest root) with one entry per key, sorted."""
    order = np.argsort(columns[0])
    key, members, low, high = (c[order] for c in columns)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return [key[first], np.add.reduceat(members, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)] if len(key) else columns


def _mixed_elements(apart: DataFrame) -> Elements:
    """The elements of ``apart`` (anchor, root, apart) that rows of different classes have.

    Tasks sum up what they read before they pass it on, as packed blocks by hash range: an
    element that very many rows have is one entry per block. A shard is merged to sorted arrays.
    """
    folder = fresh_path(apart.sparkSession, "elements")
    total = apart.agg(F.coalesce(F.sum(F.size("apart")), F.lit(0))).first()[0]
    bits = max(0, math.ceil(math.log2(max(1, total / SHARD_ELEMENTS))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            columns = _summed([np.concatenate(c) for c in zip(*held)])
            held.clear()
            shard = (columns[0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(columns[0]), np.int64)
            there = np.unique(shard)
            ends = np.append(np.searchsorted(shard, there), len(shard))
            blocks = [pack([c[x:y] for c in columns]) for x, y in zip(ends[:-1], ends[1:])]
            return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(blocks, pa.binary())], names=["shard", "block"])

        for batch in batches:
            row, keys = _element_keys(batch)
            root = batch.column("root").to_numpy()[row]
            held.append(_summed([keys, np.ones(len(keys), np.int64), root, root]))
            if sum(len(h[0]) for h in held) >= ELEMENTS_AT_ONCE:
                yield out()
        if held:
            yield out()

    def merge(group: pa.Table) -> pa.Table:
        blocks = [unpack(b, 4) for b in group.column("block").to_pylist()]
        key, members, low, high = _summed([np.concatenate(c) for c in zip(*blocks)])
        mixed = low != high
        path = write_arrays(folder, "elements", [key[mixed], members[mixed]])
        return pa.table({"shard": group.column("shard")[:1], "path": [path], "n": [int(mixed.sum())]})

    blocks = apart.select("anchor", "root", "apart").mapInArrow(count, "shard int, block binary")
    files = blocks.groupBy("shard").applyInArrow(merge, "shard int, path string, n bigint").collect()  # a row for each file
    by_shard = {f["shard"]: (f["path"], f["n"]) for f in files}
    return Elements([by_shard.get(k, ("", 0)) for k in range(1 << bits)])


def _classes(nodes: DataFrame, texts_of, similar: float) -> DataFrame | None:
    """(node, root) of the nodes that have links; ``nodes``: node, mark, size, keys, sign."""
    keyed = nodes.select("node", "size", F.col("size").alias("differs"), F.col("size").alias("shared"), F.explode("keys").alias("key"))
    several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = stored(keyed.join(several, "key"), "buckets")
    if buckets.isEmpty():
        return None
    known = stored(buckets.groupBy("node").agg(F.sum("members").alias("meets")), "active")
    signs = stored(nodes.select("node", "mark", "sign").join(known, "node", "left_semi"), "signatures")
    texts = stored(texts_of(signs.select("node", "mark")), "shingles")
    signs = signs.select("node", "sign")

    def linked(pairs: DataFrame, whole: DataFrame | None) -> DataFrame:
        links = stored(_links(pairs, signs, texts, similar), "links")
        return merge(whole, links) if whole is None or not links.isEmpty() else whole

    alone = buckets.withColumn("root", F.col("node"))
    best = buckets.join(known, "node").groupBy("key").agg(F.max(F.struct("meets", "node", "size")).alias("best"))
    best = stored(best.select("key", F.col("best.node").alias("anchor"), "best.size"), "anchors")
    whole_size = [F.col("size").alias(c) for c in ("differs", "shared")]
    whole = linked(_pairs(best.select("key", F.col("anchor").alias("node"), "size", *whole_size, F.col("anchor").alias("root")), alone, similar), None)
    few = stored(_open_groups(buckets.where(F.col("members").between(3, FEW)), whole, similar), "few")
    if not few.isEmpty():
        whole = linked(_pairs(few, few, similar), whole)
    crowd = _open_groups(buckets.where(F.col("members") > FEW), whole, similar).join(best.select("key", "anchor"), "key")
    crowd = stored(crowd.select("node", "anchor", "root").distinct(), "crowd")
    if crowd.isEmpty():
        return whole
    lists = stored(_differences(crowd, texts, similar), "differences")
    unit = F.col("node").cast("double") / float(1 << 63)
    tried, wanted = 0, ANCHORS
    while True:
        mixed = stored(_open_groups(lists.where(F.col("members") > tried), whole, similar), "open")
        if mixed.isEmpty():
            return whole
        fresh = (unit * F.col("members") < wanted) | (F.col("members") <= wanted)
        if tried:
            fresh &= unit * F.col("members") >= tried
        whole = linked(_pairs(mixed.where(fresh), mixed, similar), whole)
        tried, wanted = wanted, 8 * wanted


def _marked(docs: DataFrame, id_col: str, text_col: str):
    """A hash of id and text, which tells rows apart."""
    return F.xxhash64(F.col(id_col).cast("string"), whole_text(text_col))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, marks: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id`` (the id that stays), ``class_size``, ``copies``, ``kept``.

    ``copies`` counts the rows with the same words, ``class_size`` those of the class. With ``marks`` the row's hash
    of id and text comes too.
    """
    rows = docs.select(F.col(id_col).alias("id"), _marked(docs, id_col, text_col).alias("mark"), whole_text(text_col).alias("body"))
    kind = rows.schema["id"].dataType.simpleString()
    sketched = stored(rows.mapInArrow(lambda batches: _sketch(batches, similar), f"id {kind}, mark bigint, node bigint, size int, keys array<bigint>, sign binary"), "sketches")
    #: Of equal texts the row that stays; nulls last.
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("mark").alias("mark")))
    copies = stored(sketched.groupBy("node").agg(best.alias("best"), F.count(F.lit(1)).alias("copies")), "copies")
    chosen = copies.select("node", "best.id", "best.mark")
    nodes = sketched.join(chosen.select("node", "mark"), ["node", "mark"], "left_semi").where("size > 0").dropDuplicates(["node"])
    nodes = stored(nodes.select("node", "mark", "size", "keys", "sign"), "nodes")

    def texts_of(wanted: DataFrame) -> DataFrame:
        found = rows.select("mark", "body").join(wanted, "mark")
        return found.select("node", "body").mapInArrow(_shingled, "node bigint, shingles binary").dropDuplicates(["node"])

    whole = _classes(nodes, texts_of, similar)
    if whole is None:
        of_node = copies.withColumn("root", F.col("node"))
    else:
        of_node = copies.join(whole, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = of_node.groupBy("root").agg(F.min("best").alias("head"), F.sum("copies").alias("class_size"))
    of_node = stored(of_node.join(heads, "root").select("node", "copies", "head", "class_size"), "classes")
    out = sketched.select("id", "mark", "node").join(of_node, "node")
    return out.select(
        F.col("id").alias(id_col),
        F.col("head.id").alias("class_id"),
        F.col("class_size").cast("long").alias("class_size"),
        F.col("copies").cast("long").alias("copies"),
        (F.col("mark") == F.col("head.mark")).alias("kept"),
        *[F.col("mark")] * marks,
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` with one row of each class, all columns kept."""
    mark = free_name(docs, "_mark")
    stays = near_classes(docs, id_col, text_col, similar, marks=True).where("kept").select(F.col("mark").alias(mark))
    marked = docs.withColumn(mark, _marked(docs, id_col, text_col))
    return marked.join(stays, mark, "left_semi").dropDuplicates([mark]).select(*[F.col(f"`{c}`") for c in docs.columns])
