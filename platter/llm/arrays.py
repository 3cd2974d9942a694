"""Flat numpy arrays in the shared folder: tasks write them, workers map them into memory."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import zstandard
from pyarrow import fs


def write_arrays(folder: str, label: str, arrays: list[np.ndarray]) -> str:
    """Write ``arrays`` one after the other to a new file of ``folder``; a retried task writes another file."""
    path = f"{folder}/{label}-{uuid.uuid4().hex}.bin"
    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as out:
        for array in arrays:
            out.write(np.ascontiguousarray(array).tobytes())
    return path


def map_arrays(path: str, rows: int, types: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of a file, of ``rows`` entries each, mapped and not read.

    A folder that the machine mounts is mapped in place. From another store the file is
    fetched to a temporary file that is unlinked at once and goes with the process.
    """
    if not rows:
        return [np.empty(0, t) for t in types]
    system, place = fs.FileSystem.from_uri(path)
    if isinstance(system, fs.LocalFileSystem):
        whole = np.memmap(place, dtype=np.uint8, mode="r")
    else:
        with tempfile.TemporaryFile() as held, system.open_input_stream(place) as source:
            while piece := source.read(1 << 22):
                held.write(piece)
            held.flush()
            whole = np.memmap(held, dtype=np.uint8, mode="r")
    out, at = [], 0
    for kind in types:
        size = rows * np.dtype(kind).itemsize
        out.append(whole[at : at + size].view(kind))
        at += size
    return out


class Maps:
    """Files of arrays, each mapped when it is first needed; beyond ``most``, the one not used for longest is let go.

    A map holds a file descriptor, of which a process has a bounded number, while files grow in number with the corpus.
    """

    def __init__(self, files: list[tuple[str, int]], types: tuple[str, ...], most: int = 512):
        self.files, self.types, self.most = files, types, most
        self.open: dict[int, list[np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def __len__(self) -> int:
        return len(self.files)

    def __getitem__(self, k: int) -> list[np.ndarray]:
        arrays = self.open.pop(k, None)
        if arrays is None:
            if len(self.open) >= self.most:
                del self.open[next(iter(self.open))]
            arrays = map_arrays(*self.files[k], self.types)
        self.open[k] = arrays  # last in the order of use
        return arrays


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length, the first one sorted, as a small block.

    The first is stored as steps, and all as planes of bytes, most of which are zero.
    """
    steps = np.diff(columns[0].astype(np.uint64), prepend=np.uint64(0))
    planes = [c.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in (steps, *columns[1:])]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(block: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(columns, 8, -1)
    out = [np.ascontiguousarray(c.T).view("<u8").reshape(-1) for c in raw]
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters neighbours."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix64``."""
    x = (x ^ (x >> np.uint64(32))) * _INVERSE
    x = (x ^ (x >> np.uint64(32))) * _INVERSE
    return x ^ (x >> np.uint64(32))
