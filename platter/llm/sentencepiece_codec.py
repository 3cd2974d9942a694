"""SentencePiece encoding by a table of distinct chunks, and decoding.

The library turns every blank into a marker and puts one in front of a text. If no piece
of the vocabulary has a marker after another character, no merge crosses the place where
a marker follows something else; nor does any merge touch a character that no piece has,
such as the line feed. A text is cut there into chunks, marked words for the most part.

The chunk table is made once for all texts. Tasks collect the distinct chunks of their texts, a
shuffle brings these down to one row each (never a row per word of a text), and each is segmented
once by the library. The table is kept as sorted arrays in the shared folder, by hash range: 128-bit
hashes of the chunks, where their ids begin, and the ids. Workers map the arrays into memory, look a
batch's distinct chunks up by binary search, and join their ids back by position in the text.

Whether a model can be cut so is read off its vocabulary when it is loaded; a
model that allows pieces across markers, or normalises its input, is run on whole texts.

Bounds: a task holds ``PART_BYTES`` of distinct chunks before it passes them on, which changes
no result, and encodes ``TEXTS_AT_ONCE`` texts at a time. A shard
of the table has about ``SHARD_CHUNKS`` chunks, the driver sees one row per shard.

Defined results: a null or empty text has no ids and decodes to the empty text; a row per
row, repeated ones too; an empty table gives an empty result; very long texts, and chunks
without any blank, are encoded whole; other columns of the input are not read. Ids are plain positions,
with no begin, end or sampling. Two chunks share their ids if their 128-bit hashes are equal.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.llm.arrays import map_arrays, write_arrays
from platter.llm.common import whole_text
from platter.session import fresh_path, stored

MARK = "▁"
PART_BYTES = 32 << 20
SHARD_CHUNKS = 1_000_000
TEXTS_AT_ONCE = 256

_TABLE = ("<u8", "<u8", "<i8")
_codecs: dict[str, Codec] = {}


class Codec:
    """One model in one worker: how texts are cut, and what the library makes of a chunk."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        known = set(chain.from_iterable(plain))
        #: A text of blanks, marks and odd letters comes back as it went in only if nothing is normalised.
        probe = "  a \n ﬁ Ａ  b  "
        self.cut = (
            not any(MARK in p.lstrip(MARK) for p in plain)
            and "\n" not in known
            and self.model.decode(self.model.encode(probe)) == probe
            and self._lead("\n") == 1
        )
        self.numbers = [str(i) for i in range(len(pieces))]
        self.pattern = re.compile(f"{MARK}+[^{MARK}\n]*|\n+|[^{MARK}\n]+")

    def _lead(self, text: str) -> int:
        """Ids before those of the line feeds that ``text`` is made of."""
        return len(self.model.encode(text)) - len(text.encode())

    def chunks(self, text: str) -> list[str]:
        return self.pattern.findall(MARK + text.replace(" ", MARK)) if text else []

    def segment(self, chunk: str) -> list[int]:
        """The ids of a chunk inside a text."""
        if chunk[0] == MARK:
            return self.model.encode(chunk[1:]) if len(chunk) > 1 else self.model.encode("\n")[:1]
        if chunk[0] == "\n":
            return self.model.encode(chunk)[1:]
        return self.model.encode("\n" + chunk)[2:]

    def decimals(self, ids: list[int]) -> str:
        """The ids as decimals, joined by commas."""
        return ",".join(map(self.numbers.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids) if ids else ""


def codec(path: str) -> Codec:
    """The worker's codec for a model file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _hashes(chunks: Iterable[str]) -> np.ndarray:
    """128-bit hashes, as rows of two numbers."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(c) for c in chunks), ">u8").astype("<u8").reshape(-1, 2)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class ChunkTable:
    """The distinct chunks of a corpus with their ids, mapped from the shared folder when first needed."""

    def __init__(self, shards: list[tuple[str, int, str, int]]):
        #: By shard: file and number of the chunks, file and number of their ids.
        self.shards, self.open = shards, {}

    def __getstate__(self):
        return {"shards": self.shards, "open": {}}

    def _shard(self, k: int) -> tuple[list[np.ndarray], np.ndarray]:
        if k not in self.open:
            chunks, n, ids, n_ids = self.shards[k]
            self.open[k] = (map_arrays(chunks, n, _TABLE), map_arrays(ids, n_ids, ("<i4",))[0])
        return self.open[k]

    def look_up(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct chunks: all ids, and where those of each chunk begin and how many they are."""
        hashes = _hashes(chunks)
        bits = len(self.shards).bit_length() - 1
        shard = (hashes[:, 0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(chunks), np.int64)
        starts, sizes = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        flat, before = [np.empty(0, np.int32)], 0
        for k in np.unique(shard).tolist():
            rows = np.flatnonzero(shard == k)
            (high, low, ends), ids = self._shard(k)
            at = np.searchsorted(high, hashes[rows, 0])
            for i in np.flatnonzero(low[at] != hashes[rows, 1]).tolist():  # equal first halves are next to each other
                while low[at[i]] != hashes[rows[i], 1]:
                    at[i] += 1
            first = np.where(at > 0, ends[at - 1], 0)
            sizes[rows] = ends[at] - first
            starts[rows] = before + np.cumsum(sizes[rows]) - sizes[rows]
            flat.append(ids[_spans(first, sizes[rows])])
            before += len(flat[-1])
        return np.concatenate(flat), starts, sizes

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, given by their chunks, one text after the other, and where each text ends."""
        place: dict[str, int] = {}
        at = np.array([place.setdefault(c, len(place)) for chunks in texts for c in chunks], np.int64)
        flat, starts, sizes = self.look_up(list(place))
        ends = np.append(0, np.cumsum(sizes[at]))[np.cumsum([len(chunks) for chunks in texts])]
        return flat[_spans(starts[at], sizes[at])], ends


def chunk_table(rows: DataFrame, model_path: str) -> ChunkTable:
    """The table of the distinct chunks of ``rows`` (id, body): each is segmented once."""
    folder = fresh_path(rows.sparkSession, "chunks")

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, distinct, size = codec(model_path), set(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                new = set(tool.chunks(text)) - distinct
                distinct |= new
                size += sum(map(len, new)) + 60 * len(new)
                if size > PART_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(list(distinct), pa.string())], names=["chunk"])
                    distinct, size = set(), 0
        yield pa.RecordBatch.from_arrays([pa.array(list(distinct), pa.string())], names=["chunk"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_path)
        for batch in batches:
            chunks = batch.column(0).to_pylist()
            halves = _hashes(chunks)
            ids = [np.array(tool.segment(c), "<i4").tobytes() for c in chunks]
            columns = [pa.array(halves[:, 0].view(np.int64)), pa.array(halves[:, 1].view(np.int64)), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["high", "low", "ids"])

    distinct = rows.select("body").mapInArrow(collect, "chunk string").distinct()
    known = stored(distinct.mapInArrow(segment, "high bigint, low bigint, ids binary"), "segmented")
    n_chunks = known.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n_chunks / SHARD_CHUNKS)))))
    shard = F.shiftrightunsigned("high", 64 - bits).cast("int") if bits else F.lit(0)

    def write(group: pa.Table) -> pa.Table:
        high, low = (group.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
        order = np.lexsort((low, high))
        ids = [np.frombuffer(x, "<i4") for x in group.column("ids").take(pa.array(order)).to_pylist()]
        ends = np.cumsum([len(x) for x in ids])
        chunks = write_arrays(folder, "chunks", [high[order], low[order], ends.astype("<i8")])
        flat = write_arrays(folder, "ids", [np.concatenate(ids)])
        said = {"shard": group.column("shard")[:1], "chunks": [chunks], "n": [len(high)], "ids": [flat], "n_ids": [int(ends[-1])]}
        return pa.table(said, schema=pa.schema([("shard", pa.int32()), ("chunks", pa.string()), ("n", pa.int64()), ("ids", pa.string()), ("n_ids", pa.int64())]))

    by_shard = known.withColumn("shard", shard).groupBy("shard").applyInArrow(write, "shard int, chunks string, n bigint, ids string, n_ids bigint")
    files = {f["shard"]: (f["chunks"], f["n"], f["ids"], f["n_ids"]) for f in by_shard.collect()}
    return ChunkTable([files.get(k, ("", 0, "", 0)) for k in range(1 << bits)])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_decode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = True
) -> DataFrame:
    """One row per row: id, ``n_tokens``, the ids if asked for, digests of ids and decoded text if asked for."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = "id " + id_type + ", n_tokens bigint" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests
    table = chunk_table(rows, model_path) if codec(model_path).cut else None

    def encoded(tool: Codec, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if table is not None:
            return table.encode([tool.chunks(t) for t in texts])
        found = [np.array(tool.model.encode(t), np.int32) for t in texts]
        return np.concatenate([np.empty(0, np.int32), *found]), np.cumsum([len(f) for f in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                flat, ends = encoded(tool, part.column(1).to_pylist())
                bounds = np.append(0, ends)
                out = [part.column(0), pa.array(np.diff(bounds), pa.int64())]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())))
                if digests:
                    lists = [flat[a:b].tolist() for a, b in zip(bounds, ends)]
                    out.append(pa.array([_sha(tool.decimals(x)) for x in lists], pa.string()))
                    out.append(pa.array([_sha(tool.decode(x)) for x in lists], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["id", "n_tokens", *["ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests]
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
