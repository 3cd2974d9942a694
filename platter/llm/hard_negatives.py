"""Hard negatives by Four-Russians scoring.

Components become integers, and a candidate is stored as bit planes: for each bit of its
two's complement components one byte per group of eight dimensions. For an anchor, a table
of 256 subset sums per group holds what each such byte contributes, so an inner product is
a sum of looked-up entries, planes added from the highest to the lowest with a shift in
between and the sign plane subtracted. All of it is integer arithmetic: scores are exact.

Each task turns its candidates into tiles of bounded size and streams the anchors past them
in blocks from the shared folder. One pass finds the nearest rows of an anchor's own label
(it scores only those), the next the rows of other labels within each positive's window of
scores. A tile keeps a few rows per anchor, and a window over these partial lists merges
them, so no task, and not the driver, holds all anchors or all rows.

Defined results: rows with a null id, label or vector, or with a null or non-finite
component, take no part. Rows with the same id count as one row, the one whose label,
then whose bit planes, are least. Vectors of different lengths meet as if the shorter ended in zeros; an
empty vector scores 0. Equal scores are ranked by id. Anchors without other rows of their
label, and positives without rows in their window, give no rows; so does an empty table.
Other columns are not read, whatever their names. If a component is so large that an inner
product could leave 55 bits, the job is refused with an error before any scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platter.llm.shared_parts import shared_table, table_batches
from platter.session import stored

TILE_ROWS = 131_072
ANCHOR_BLOCK = 256
CHUNK_ROWS = 1_024
LEAST = np.iinfo(np.int64).min


def subset_sums(anchors: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """Tables (group, byte, anchor): the sum of the group's components whose bits the byte has; the first dimension is the highest bit."""
    count, dims = anchors.shape
    out = np.zeros((dims // 8, 256, count), kind)
    for group in range(dims // 8):
        for bit in range(8):
            out[group, 1 << bit : 2 << bit] = out[group, : 1 << bit] + anchors[:, 8 * group + 7 - bit].astype(kind)
    return out


def bit_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """Bytes (row, plane, group) of the two's complement of ``values`` (row, dimension), lowest plane first."""
    return np.stack([np.packbits(((values >> p) & 1).astype(np.uint8), axis=1) for p in range(planes)], axis=1)


def from_planes(planes: np.ndarray) -> np.ndarray:
    """The values (row, dimension) of ``bit_planes``."""
    bits = np.unpackbits(planes, axis=2).astype(np.int64)
    weights = np.left_shift(np.int64(1), np.arange(planes.shape[1], dtype=np.int64))
    weights[-1] = -weights[-1]
    return np.tensordot(bits, weights, axes=(1, 0))


def plane_scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact inner products (row, anchor) by looking up every byte of every plane."""
    total = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    part = np.empty_like(total)
    top = planes.shape[1] - 1
    for plane in range(top, -1, -1):
        total += total
        for group in range(planes.shape[2]):
            np.take(tables[group], planes[:, plane, group], axis=0, out=part, mode="clip")
            if plane == top:
                total -= part
            else:
                total += part
    return total


class Best:
    """The ``k`` best (score, id) of each of ``n`` lists: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), LEAST), np.zeros((n, k), np.int64)

    def last(self) -> np.ndarray:
        """Score of each list's last entry; ``LEAST`` while it is not full."""
        return self.score[:, -1]

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(lists):
            return
        touched = np.unique(lists)
        lists = np.concatenate([np.repeat(touched, self.k), lists])
        score = np.concatenate([self.score[touched].reshape(-1), score])
        ids = np.concatenate([self.id[touched].reshape(-1), ids])
        order = np.lexsort((ids, -score, score == LEAST, lists))
        lists, score, ids = lists[order], score[order], ids[order]
        starts = np.searchsorted(lists, touched)
        rank = np.arange(len(lists)) - np.repeat(starts, np.diff(np.append(starts, len(lists))))
        kept = rank < self.k
        self.score[lists[kept], rank[kept]] = score[kept]
        self.id[lists[kept], rank[kept]] = ids[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, id) of all entries."""
        lists, places = np.nonzero(self.score != LEAST)
        return lists, self.score[lists, places], self.id[lists, places]


def _pieces(start: int, end: int) -> Iterator[slice]:
    """Slices from ``start`` to ``end``: short ones first, so that the lists fill before most rows come."""
    size = 64
    while start < end:
        yield slice(start, min(end, start + size))
        start, size = start + size, min(CHUNK_ROWS, size * 4)


def _planes_of(cells: pa.Array, planes: int, groups: int) -> np.ndarray:
    """Binary cells as bytes (row, plane, group)."""
    return np.frombuffer(b"".join(cells.to_pylist()), np.uint8).reshape(len(cells), planes, groups)


def _tiles(batches: Iterator[pa.RecordBatch], planes: int, groups: int, keys: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Candidates (id, label, planes) in tiles of at most ``TILE_ROWS``, sorted by ``keys``."""

    def tile(held: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        whole = pa.Table.from_batches(held)
        out = {c: whole.column(c).to_numpy() for c in ("id", "label")}
        out["planes"] = _planes_of(whole.column("planes"), planes, groups)
        order = np.lexsort([out[k] for k in reversed(keys)])
        return {c: v[order] for c, v in out.items()}

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(at, TILE_ROWS)
            if size + part.num_rows > TILE_ROWS:
                yield tile(held)
                held, size = [], 0
            held.append(part)
            size += part.num_rows
    if size:
        yield tile(held)


def _packed(rows: DataFrame, planes: int, groups: int) -> DataFrame:
    """(id, label, anchor, planes); vectors are padded with zeros to whole groups."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                cells = part.column("ints")
                sizes = cells.value_lengths().to_numpy()
                values = np.zeros((len(sizes), 8 * groups), np.int64)
                values[np.arange(8 * groups)[None, :] < sizes[:, None]] = cells.flatten().to_numpy()
                bits = bit_planes(values, planes)
                out = [part.column("id"), part.column("label"), part.column("anchor"), pa.array([r.tobytes() for r in bits], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["id", "label", "anchor", "planes"])

    return rows.mapInArrow(pack, "id bigint, label bigint, anchor boolean, planes binary")


def _nearest(rows: DataFrame, anchors: str, planes: int, groups: int, kind: type, k: int) -> DataFrame:
    """Per tile and anchor: the ``k`` best other rows of the anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches, planes, groups, ("label", "id")):
            for block in table_batches(anchors, ANCHOR_BLOCK):
                own, label = (block.column(c).to_numpy() for c in ("id", "label"))
                tables = subset_sums(from_planes(_planes_of(block.column("planes"), planes, groups)), kind)
                best = Best(len(own), k)
                for value in np.unique(label):
                    at = np.flatnonzero(label == value)
                    some = np.ascontiguousarray(tables[:, :, at])
                    for piece in _pieces(*np.searchsorted(tile["label"], [value, value + 1])):
                        scores = plane_scores(some, tile["planes"][piece])
                        row, col = np.nonzero(scores > best.last()[at][None, :])
                        ids = tile["id"][piece][row]
                        fit = ids != own[at[col]]
                        best.add(at[col][fit], scores[row[fit], col[fit]].astype(np.int64), ids[fit])
                lists, score, ids = best.rows()
                yield pa.RecordBatch.from_arrays([pa.array(own[lists]), pa.array(ids), pa.array(score)], names=["anchor_id", "positive_id", "positive_score"])

    return rows.select("id", "label", "planes").mapInArrow(run, "anchor_id bigint, positive_id bigint, positive_score bigint")


def _in_window(rows: DataFrame, anchors: str, planes: int, groups: int, kind: type, positives: int, k: int, low: int, high: int) -> DataFrame:
    """Per tile, anchor and positive: the ``k`` best rows of other labels between ``low`` and ``high`` percent of the positive's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches, planes, groups, ("id",)):
            for block in table_batches(anchors, ANCHOR_BLOCK):
                own, label = (block.column(c).to_numpy() for c in ("id", "label"))
                tables = subset_sums(from_planes(_planes_of(block.column("planes"), planes, groups)), kind)
                lists = block.column("positives")
                counts, flat = lists.value_lengths().to_numpy(), lists.flatten()
                there = np.arange(positives)[None, :] < counts[:, None]
                score, with_id = np.full(there.shape, LEAST), np.zeros(there.shape, np.int64)
                score[there], with_id[there] = flat.field("score").to_numpy(), flat.field("id").to_numpy()
                floor, roof = np.where(there, -((-low * score) // 100), 1), np.where(there, (high * score) // 100, 0)
                open_ = floor <= roof
                best = Best(there.size, k)
                for piece in _pieces(0, len(tile["id"])):
                    last = best.last().reshape(there.shape)
                    need = np.where(last == LEAST, floor, np.maximum(floor, last + 1))
                    least = np.where(open_, need, np.iinfo(np.int64).max).min(axis=1)
                    most = np.where(open_, roof, LEAST).max(axis=1)
                    scores = plane_scores(tables, tile["planes"][piece])
                    row, col = np.nonzero((scores >= least[None, :]) & (scores <= most[None, :]))
                    fit = tile["label"][piece][row] != label[col]
                    row, col = row[fit], col[fit]
                    found, ids = scores[row, col].astype(np.int64), tile["id"][piece][row]
                    for j in range(positives):
                        hit = open_[col, j] & (found >= need[col, j]) & (found <= roof[col, j])
                        best.add(col[hit] * positives + j, found[hit], ids[hit])
                at, found, ids = best.rows()
                out = [own[at // positives], with_id.reshape(-1)[at], score.reshape(-1)[at], ids, found]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=[f.split()[0] for f in fields])

    fields = ["anchor_id bigint", "positive_id bigint", "positive_score bigint", "negative_id bigint", "negative_score bigint"]
    return rows.select("id", "label", "planes").mapInArrow(run, ", ".join(fields))


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: Column | str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """For each anchor and each of its ``positives`` nearest rows of the same label: the ``negatives`` best-scoring rows of other labels.

    ``anchor`` is a condition on ``rows``; components become floor(``scale`` * x). A negative's
    score lies between ``low`` and ``high`` percent of the positive's.
    """
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    vector = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    plain = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = plain.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(finite)
    scaled = F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))))
    most = F.transform("vector", lambda x: F.abs(F.floor(x * F.lit(float(scale))).cast("double")))
    sizes = plain.agg(F.max(F.size("vector")).alias("dims"), F.max(F.array_max(most)).alias("most")).first()
    dims, most = sizes["dims"] or 0, sizes["most"] or 0.0
    if dims * most * most >= 2.0**55:
        raise ValueError(f"components up to {most:g} in {dims} dimensions: inner products would leave 55 bits")
    planes, groups = int(most).bit_length() + 1, max(1, -(-dims // 8))
    kind = np.int32 if dims * most * most < 2**30 else np.int64

    packed = _packed(plain.select("id", "label", "anchor", scaled.alias("ints")), planes, groups)
    single = packed.groupBy("id").agg(F.min(F.struct("label", "planes")).alias("row"), F.max("anchor").alias("anchor"))
    held = stored(single.select("id", "row.*", "anchor"), "negatives-rows")
    anchors = held.where("anchor").select("id", "label", "planes")
    blocks = shared_table(anchors.repartitionByRange("label", "id").sortWithinPartitions("label", "id"), "negatives-anchors")

    near = _nearest(held, blocks, planes, groups, kind, positives)
    place = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(place)).where(F.col("place") <= positives)
    lists = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", F.col("positive_score").alias("score"), F.col("positive_id").alias("id")))).alias("positives"))
    known = anchors.join(lists.withColumnRenamed("anchor_id", "id"), "id")
    blocks = shared_table(known.repartitionByRange("label", "id").sortWithinPartitions("label", "id"), "negatives-known")

    found = _in_window(held, blocks, planes, groups, kind, positives, negatives, low, high)
    place = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    best = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
