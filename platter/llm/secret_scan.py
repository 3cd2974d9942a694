"""Secret scans with structural confirmation.

Three plain patterns are reported as they stand: assignments to a secret-like name, access
ids and long hex runs. Everything else that only looks random is decoded first and must
prove itself by its structure:

* ``key``: base64 (wrapped or not, with real or escaped line ends) or hex that decodes to a
  private key. The nested lengths of its encoding must fit into each other to the byte, the
  fields must be those of a key, an RSA modulus must be the product of its primes, and the
  outermost length says where the span ends. Base64 of a key begins a line and has at most
  ``MOST_KEY`` characters, over twice what the longest keys in use need. Public keys and certificates are no secrets.
* ``token``: dot-joined base64url whose header is JSON that names an algorithm, with a
  claims object and a signature as long as that algorithm makes it (or the five parts of
  an encrypted token).
* ``nested``: base64 or hex that decodes to text in which an assignment, an access id, a
  key or a token stands, down to ``DEPTH`` layers.

A plain map over whole texts: no shuffle, one row per row. Each text is passed over a few
times by compiled searches that look for runs only where a cheap byte search has found one;
nothing scans a run twice, so time is linear in the text, however long.

Defined results: a null or empty text has no spans. Spans count code points, the end
excluded, and come by start, then by kind in the order of ``KINDS``. Repeated rows and
null ids give their row each; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platter.llm.common import whole_text

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "key", "token", "nested")
DEPTH = 3

# The patterns of the plain kinds and the fewest characters of a match.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: Runs that may hold base64, over line ends; hex of either case; dotted tokens.
_SIXTY_FOUR = re.compile(rb"[A-Za-z0-9+/_-]{20,}(?:={0,2}(?:\r?\n|\\n|\\r\\n)[A-Za-z0-9+/_-]+)*={0,2}")
_HEX_RUN = re.compile(rb"[0-9A-Fa-f]{40,}")
_DOTTED = re.compile(rb"[A-Za-z0-9_.-]{20,}")
_LINE_END = re.compile(rb"={0,2}(?:\r?\n|\\n|\\r\\n)")

#: How the base64 of a key begins, and the most characters that one has: that of an RSA key of 16,384 bits has about 13,000.
_KEY_STARTS, MOST_KEY = (b"M", b"b3BlbnNzaC1rZXktdjE"), 1 << 15

#: Bytes of a signature by algorithm; those of RSA are as long as their key.
_SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}


def _marks(members: bytes) -> bytes:
    return bytes(120 if b in members else 32 for b in range(256))


_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_HEX_MARKS, _WORD_MARKS = _marks(b"0123456789abcdefABCDEF"), _marks(_LETTERS + b"+/_-.")


def der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the value that begins at ``at``, if its length is well formed and fits."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 128:
        more = size & 127
        if not 1 <= more <= 4 or at + more > end or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + more]), at + more
        if size < 128:
            return None
    return (tag, at, at + size) if at + size <= end else None


def fields(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values between ``start`` and ``end``, if they fill that space exactly."""
    out = []
    while start < end:
        item = der(data, start, end)
        if item is None:
            return None
        out.append(item)
        start = item[2]
    return out


def der_key(data: bytes) -> int:
    """Length of the private key that ``data`` begins with; 0 if it begins with none."""
    whole = der(data, 0, len(data))
    parts = fields(data, *whole[1:]) if whole and whole[0] == 0x30 else None
    if not parts:
        return 0
    tags = [p[0] for p in parts]
    number = lambda i: int.from_bytes(data[parts[i][1] : parts[i][2]], signed=True)
    named = lambda part: (f := fields(data, *part[1:])) is not None and bool(f) and f[0][0] == 0x06
    if tags[:9] == [0x02] * 9 and number(0) in (0, 1):  # RSA
        fit = number(1) > 1 and number(1) == number(4) * number(5)
    elif tags == [0x02] * 6 and number(0) == 0:  # DSA
        fit = number(1) > number(2) > 1 and 0 < number(5) < number(2)
    elif tags[:3] == [0x02, 0x30, 0x04] and number(0) in (0, 1):  # any algorithm, named
        fit = named(parts[1]) and parts[2][2] - parts[2][1] >= 16
    elif tags[:2] == [0x02, 0x04] and number(0) == 1:  # elliptic curve
        fit = 16 <= parts[1][2] - parts[1][1] <= 66 and all(t in (0xA0, 0xA1) for t in tags[2:])
    elif tags == [0x30, 0x04]:  # encrypted, algorithm named
        fit = named(parts[0]) and parts[1][2] - parts[1][1] >= 16
    else:
        fit = False
    return whole[2] if fit else 0


def ssh_key(data: bytes) -> int:
    """The same for the length-prefixed form of ssh keys."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return 0
    at = len(magic)

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4]) if at + 4 <= len(data) else len(data)
        start, at = at + 4, at + 4 + size
        return data[start:at] if at <= len(data) else None

    head = [string() for _ in range(3)]
    count = int.from_bytes(data[at : at + 4])
    at += 4
    if None in head or not 1 <= count <= 16:
        return 0
    bodies = [string() for _ in range(count + 1)]
    return at if None not in bodies and all(bodies) else 0


def key_length(data: bytes) -> int:
    return der_key(data) or ssh_key(data)


def unpad(run: bytes) -> bytes | None:
    """The bytes of a base64 run of either alphabet, as far as whole groups go; None if it is none."""
    run = run.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    run = run[:-1] if len(run) % 4 == 1 else run
    try:
        return base64.b64decode(run + b"=" * (-len(run) % 4), validate=True)
    except binascii.Error:
        return None


def _object(part: bytes) -> dict | None:
    """The JSON object that a part of a token holds."""
    try:
        found = json.loads(unpad(part) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def token_parts(parts: list[bytes]) -> int:
    """How many of ``parts`` make up the signed or encrypted token that they begin with; 0 if none."""
    head = _object(parts[0]) if parts[0].startswith(b"eyJ") else None
    name = head.get("alg") if head else None
    if not isinstance(name, str):
        return 0
    if isinstance(head.get("enc"), str):
        return 5 if len(parts) >= 5 and all(parts[2:5]) and all(unpad(p) is not None for p in parts[1:5]) else 0
    if len(parts) < 3 or _object(parts[1]) is None:
        return 0
    size = len(unpad(parts[2]) or b"")
    fit = size == _SIGNATURE[name] if name in _SIGNATURE else name[:2] in ("RS", "PS") and size >= 128 and size % 8 == 0
    return 3 if fit else 0


def _tokens(data: bytes) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(data) if b"eyJ" in data else ():
        parts, at, skip = run[0].split(b"."), run.start(), 0
        for i, part in enumerate(parts):
            if not skip and part.startswith(b"eyJ") and (skip := token_parts(parts[i : i + 5])):
                yield at, at + sum(len(p) + 1 for p in parts[i : i + skip]) - 1
            skip = max(0, skip - 1)
            at += len(part) + 1


def _inside(data: bytes | None, depth: int) -> bool:
    """Whether decoded bytes are text that holds a secret."""
    if not data or depth <= 0 or len(data) < 12:
        return False
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return False
    if not text.replace("\n", " ").replace("\r", " ").replace("\t", " ").isprintable():
        return False
    return any(kind != "hex" for kind, _, _ in byte_spans(data, depth - 1))


def _keys(heads: list[int], lines: list[bytes]) -> Iterator[tuple[int, int]]:
    """Spans of the keys that begin with a line; ``heads`` is where each line begins."""
    flat, offsets = b"".join(lines), [0, *accumulate(map(len, lines))]
    ends = 0
    for i, line in enumerate(lines):
        if offsets[i] >= ends and line.startswith(_KEY_STARTS):
            size = key_length(unpad(flat[offsets[i] : offsets[i] + MOST_KEY]) or b"")
            if size:  # the key's own length says in which line it ends
                ends = offsets[i] - (-size * 4 // 3)
                last = bisect_left(offsets, ends) - 1
                yield heads[i], heads[last] + ends - offsets[last]


def _decoded(data: bytes, depth: int) -> Iterator[tuple[str, int, int]]:
    """Spans of what must be decoded: keys, and text with secrets."""
    if b"x" * 20 not in data.translate(_WORD_MARKS):
        return
    for run in _SIXTY_FOUR.finditer(data):
        cuts = [m.span() for m in _LINE_END.finditer(run[0])]
        heads = [0, *(c[1] for c in cuts)]
        lines = [run[0][a:b].rstrip(b"=") for a, b in zip(heads, [*(c[0] for c in cuts), len(run[0])])]
        keys = list(_keys(heads, lines))
        if not keys and len(lines) > 1 and _inside(unpad(b"".join(lines)), depth):
            yield "nested", *run.span()
            continue
        yield from (("key", run.start() + start, run.start() + end) for start, end in keys)
        for head, line in zip(heads, lines):
            if len(line) >= 20 and not any(a <= head < b for a, b in keys) and _inside(unpad(line), depth):
                yield "nested", run.start() + head, run.start() + head + len(line)
    if b"x" * 40 in data.translate(_HEX_MARKS):
        for run in _HEX_RUN.finditer(data):
            body = binascii.unhexlify(run[0][: len(run[0]) & ~1])
            if size := key_length(body):
                yield "key", run.start(), run.start() + 2 * size
            elif _inside(body, depth):
                yield "nested", *run.span()


def byte_spans(data: bytes, depth: int = DEPTH) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by start and kind."""
    out: list[tuple[str, int, int]] = []
    low = data.lower()
    if any(name in low for name in _NAMES):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(data) if len(m[2]) >= LEAST_VALUE]
    if b"AKIA" in data:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(data) if len(m[0]) >= LEAST_ACCESS]
    if b"x" * 24 in data.translate(_HEX_MARKS):
        out += [("hex", m.start(), m.end()) for m in _HEX.finditer(data)]
    out += [("token", *span) for span in _tokens(data)]
    out += _decoded(data, depth)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def text_spans(data: bytes) -> list[dict[str, str | int]]:
    """The spans of a text in UTF-8, in code points."""
    spans = byte_spans(data)
    place, seen, count = {}, 0, 0
    for at in sorted({p for _, start, end in spans for p in (start, end)}):
        count += len(data[seen:at].decode(errors="replace"))
        place[at], seen = count, at
    return [{"kind": kind, "start": place[start], "end": place[end]} for kind, start, end in spans]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id and ``secrets``, an array of (kind, start, end)."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).cast("binary").alias("body"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = pa.array([text_spans(t.as_py()) for t in part.column(1)], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), found], names=["id", "secrets"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, secrets array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def span_list(secrets: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
