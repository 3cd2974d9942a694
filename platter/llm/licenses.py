"""License scan by conditional compression.

Spark keeps the texts that have a cue word at all. In those, each line with a cue is a
candidate block (neighbouring cue lines make one block; of very long lines the stretch
around each cue). A block is compressed alone and once more with each template as a raw
zstandard dictionary: the more of the block a template already holds, the more bytes that
saves. Templates are ranked by the share saved, and the best ones are confirmed by the exact
wording differences: every decisive word of the template must stand in the block in order,
and of its other words only ``MISSING_SHARE`` may be missing.

License texts are usually wrapped, so the words of a template may go on in lines without a cue: each template whose
decisive words stand in the paragraph around a block (up to ``AROUND`` characters to either side) is also confirmed
there, in a window of its own length around the longest common run, and the block grows to the lines it takes up. A longer wording
outranks a shorter one. ``BODIES`` are texts of several paragraphs; where one opens, it is looked for across blank
lines. Headers right before a text (its title, copyright line, ``All rights reserved``) belong to its block.

Blocks repeat a lot, so a worker keeps the verdicts of those it has seen, up to a bound.
A plain map over the rows, without a shuffle; whole texts are scanned.

Defined results: null and empty texts have no blocks and so no rows; repeated rows get rows
of their own; between templates that save the same share, more confirmed words and then the
order of ``TEMPLATES`` decide; a block that no template is confirmed for has a row with a null
license. Other columns of the input are not read.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platter.llm.common import whole_text

#: Between words, also where a line ends and the next begins with a comment mark.
_G = r"[\s*#/]+"
CUES = r"(?i)licen[cs]e|copyright|all_rights_reserved|public_domain|creative_commons|\bcc[ -]by|\bcc0\b|spdx|permission_is_hereby_granted|redistribution_and_use".replace("_", _G)
LONG_LINE = 1200
AROUND = 500
TRIED = 4
LEAST_SAVED = 0.15
MISSING_SHARE = 0.3
SEEN_BLOCKS = 50_000

#: Fixed values: (license, kind, decisive words, wording). The wordings are those the licenses ask to be used as notices.
TEMPLATES = (
    ("MIT", "permissive", "mit", "Released under the MIT License."),
    ("MIT", "permissive", "mit", "This project is licensed under the terms of the MIT license."),
    ("MIT", "permissive", "permission hereby granted free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("Apache-2.0", "permissive", "apache 2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "apache 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "permissive", "bsd 3", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "permissive", "bsd 2", "Released under the BSD 2-Clause License."),
    ("BSD", "permissive", "redistribution source binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "permissive", "isc", "Released under the ISC License."),
    ("ISC", "permissive", "permission use copy modify distribute fee granted notice appear", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-3.0", "copyleft", "gnu general public 3", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "copyleft", "gnu general public 2", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "copyleft", "gnu general public 3 later", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "copyleft", "gnu general public 2 later", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "copyleft", "2 gnu general public", "it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation."),
    ("LGPL-2.1", "copyleft", "gnu lesser general public 2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1-or-later", "copyleft", "gnu lesser general public 2.1 later", "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "copyleft", "gnu lesser general public 3 later", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "copyleft", "gnu affero general public 3 later", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSL-1.0", "permissive", "boost software 1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "copyleft", "eclipse public 2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("LGPL-3.0", "copyleft", "gnu lesser general public 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "copyleft", "gnu affero general public 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "copyleft", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "attribution", "cc by 4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "share-alike", "cc by sa 4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "non-commercial", "cc by nc 4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "non-commercial", "cc by nc nd 4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "attribution", "creative commons attribution 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "share-alike", "creative commons attribution sharealike 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "non-commercial", "creative commons attribution noncommercial 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "public-domain", "cc0 1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "public-domain", "free unencumbered public domain", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "reserved", "all rights reserved", "Copyright. All rights reserved."),
)

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
    " in the documentation and/or other materials provided with the distribution."
)
_ADVERTISING = " 3. All advertising materials mentioning features or use of this software must display the following acknowledgement:"
_NEITHER = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission."
)
#: Texts of several paragraphs, as ``TEMPLATES``.
BODIES = (
    ("BSD-4-Clause", "permissive", "redistribution source binary forms advertising neither name endorse", _BSD + _ADVERTISING + _NEITHER),
    ("BSD-3-Clause", "permissive", "redistribution source binary forms retain reproduce neither name endorse", _BSD + _NEITHER),
    ("BSD-2-Clause", "permissive", "redistribution source binary forms retain reproduce", _BSD),
)
#: A wording of so many words is a text, which headers go before.
TEXT_WORDS = 20

_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
_BETWEEN = " \t\r\n*#/-="
_TOKEN = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Words that make another license of the same family.
_TELLING = frozenset("lesser affero later sa nc nd sharealike noncommercial noderivatives noderivs".split())


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


class Scanner:
    """Templates ready for compression, in one worker."""

    def __init__(self, templates=TEMPLATES, bodies=BODIES):
        self.ranked = len(templates)
        templates = self.templates = (*templates, *bodies)
        self.alone = zstandard.ZstdCompressor(level=3)
        self.given = [
            zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t[3].encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for t in templates
        ]
        self.words = [tokens_of(t[3]) for t in templates]
        self.decisive = [t[2].split() for t in templates]
        self.cue = re.compile(CUES)
        self.seen: dict[str, tuple] = {}
        self.openers = [" " + " ".join(w[:4]) + " " for w in self.words]

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """Candidate blocks as (start, end), in order and not overlapping."""
        start = end = -1
        for found in self.cue.finditer(text):
            low = text.rfind("\n", 0, found.start()) + 1
            high = text.find("\n", found.end())
            high = len(text) if high < 0 else high
            if high - low > LONG_LINE:
                low, high = max(low, found.start() - AROUND), min(high, found.end() + AROUND)
            if start >= 0 and low <= end + 1:
                end = max(end, high)
            else:
                if start >= 0:
                    yield start, end
                start, end = low, high
        if start >= 0:
            yield start, end

    def confirm(self, k: int, words: list[str]) -> tuple[int, int] | None:
        """(words of the template that are missing, words added between its first and last); None if it isn't this license."""
        wanted = self.words[k]
        runs = difflib.SequenceMatcher(None, wanted, words, autojunk=False).get_matching_blocks()[:-1]
        if not runs:
            return None
        first, last = runs[0].b, runs[-1].b + runs[-1].size
        inside = words[first:last]
        rest = iter(inside)
        if not all(w in rest for w in self.decisive[k]):
            return None
        if (_TELLING & set(inside)) - set(wanted):
            return None
        matched = sum(r.size for r in runs)
        missing = len(wanted) - matched
        return (missing, len(inside) - matched) if missing <= MISSING_SHARE * len(wanted) else None

    def around(self, text: str, low: int, high: int, after: int) -> Iterator[tuple[int, tuple[int, int], int, int]]:
        """(template, words missing and added, start, end) of the wordings that reach into the block from low to high.

        They lie behind ``after`` and in the block's paragraph; those of ``BODIES`` may go on in the next ones.
        """
        before = [m.end() for m in _PARAGRAPH.finditer(text, max(low - AROUND, after), low)]
        start = before[-1] if before else max(low - AROUND, after)
        end = _PARAGRAPH.search(text, high, high + AROUND)
        end = end.start() if end else min(high + AROUND, len(text))
        near = list(_TOKEN.finditer(text[start:end].lower()))
        spread = " " + " ".join(m.group() for m in near) + " "
        for k, wanted in enumerate(self.words):
            tokens = near
            if k >= self.ranked:
                if self.openers[k] not in spread:
                    continue
                tokens = list(_TOKEN.finditer(text[start : low + 2 * len(self.templates[k][3]) + AROUND].lower()))
            words = [m.group() for m in tokens]
            there = set(words)
            if not all(w in there for w in self.decisive[k]):
                continue
            run = difflib.SequenceMatcher(None, wanted, words, autojunk=False).find_longest_match()
            slack = len(wanted) // 3 + 3
            first, last = max(0, run.b - run.a - slack), run.b - run.a + len(wanted) + slack
            part = words[first:last]
            if (diff := self.confirm(k, part)) is None or diff[1] > max(3, len(wanted) // 2):
                continue
            runs = difflib.SequenceMatcher(None, wanted, part, autojunk=False).get_matching_blocks()[:-1]
            at, to = start + tokens[first + runs[0].b].start(), start + tokens[first + runs[-1].b + runs[-1].size - 1].end()
            if at < high and to > low:
                yield k, diff, at, to

    def scan(self, text: str) -> Iterator[tuple]:
        """(start, end, license, kind, saved, missing words, added words) of the blocks of a text, in order and not overlapping."""
        out: list[tuple] = []
        after = 0
        for low, high in self.blocks(text):
            if low < after:
                low = after + (text[after : after + 1] == "\n")
                if high <= low or not self.cue.search(text, low, high):
                    continue
            verdict, k = self.judge(text[low:high])
            best = verdict[3] - 0.1 * len(self.words[k]) if k is not None else 0.0
            found = min(((diff[0] - 0.1 * len(self.words[j]), j, diff, at, to) for j, diff, at, to in self.around(text, low, high, after)), default=None)
            if found and (k is None or found[0] < best - 1e-9):
                _, k, diff, at, to = found
                line, stop = text.rfind("\n", after, at) + 1, text.find("\n", to)
                line, stop = max(line, after), len(text) if stop < 0 else stop
                if stop - line > LONG_LINE + len(self.templates[k][3]):
                    line, stop = at, to
                low, high = min(low, line), max(high, stop)
                verdict = (*self.templates[k][:2], self.share(k, text[low:high].encode()), *diff)
            if k is not None and len(self.words[k]) >= TEXT_WORDS:
                while out and out[-1][3] in (None, "reserved") and out[-1][1] - out[-1][0] <= AROUND and not text[out[-1][1] : low].strip(_BETWEEN):
                    low = out.pop()[0]
            out.append((low, high, *verdict))
            after = high
        return iter(out)

    def share(self, k: int, raw: bytes) -> float:
        """Share of the bytes of ``raw`` that template ``k`` saves."""
        return 1 - len(self.given[k].compress(raw)) / len(self.alone.compress(raw))

    def judge(self, block: str) -> tuple[tuple[str | None, str | None, float, int | None, int | None], int | None]:
        """License, kind, share of bytes saved, missing words and added words of a block by itself; and its template."""
        if block in self.seen:
            return self.seen[block]
        raw = block.encode()
        size = len(self.alone.compress(raw))
        saved = [1 - len(c.compress(raw)) / size for c in self.given[: self.ranked]]
        words = tokens_of(block)
        ranked = sorted(range(len(saved)), key=lambda k: (-saved[k], k))
        best = (None, None, max(saved), None, None), None
        sure = []
        for place, k in enumerate(ranked):
            if place >= TRIED and sure or saved[k] <= 0 or saved[k] < LEAST_SAVED and len(raw) < 200:
                break
            if (diff := self.confirm(k, words)) is not None:
                sure.append((diff[0] - 0.1 * len(self.words[k]), place, k, diff))
        if sure:
            _, _, k, diff = min(sure)
            best = (self.templates[k][0], self.templates[k][1], saved[k], *diff), k
        if len(self.seen) >= SEEN_BLOCKS:
            self.seen.clear()
        self.seen[block] = best
        return best


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per block: id, ``block_no``, ``start``, ``length``, ``license``, ``kind``, ``saved``, ``missing_words``, ``added_words``, ``block``."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body")).where(F.col("body").rlike(CUES))
    schema = (
        f"id {rows.schema['id'].dataType.simpleString()}, block_no int, start int, length int, license string, kind string,"
        " saved double, missing_words int, added_words int, block string"
    )
    names = [part.split()[0] for part in schema.split(", ")[:1]] + "block_no start length license kind saved missing_words added_words block".split()
    types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            found, at = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n, (low, high, *verdict) in enumerate(scanner.scan(text)):
                    found.append((n, low, high - low, *verdict, text[low:high]))
                    at.append(i)
            columns = [pa.array(list(c), t) for c, t in zip(zip(*found), types)] if found else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
