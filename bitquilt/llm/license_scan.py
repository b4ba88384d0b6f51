"""License scans by conditional compression with one raw dictionary per template."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notice texts by licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC0-1.0": "Released under CC0 1.0 Universal, to the public domain.",
    "All-rights-reserved": "All rights reserved.",
}
#: A text without any of these (lower case) has no candidate block.
CUES = ("licens", "licenc", "copyright", "redistribut", "all rights reserved", "permission is", "public domain", "spdx")
#: Share of a template's words that may be missing from, or foreign in, the stretch of a block that it covers.
TOLERANCE = 0.2
#: Fields that are filled in: differences there are no differences of wording.
FILLED = re.compile(r"^(\d{4}|\(c\)|©|by|copyright)$")

WORDS = re.compile(r"[\w.\-+/:©]*\w|©")
#: Words of a cue may be parted by the end of a line and what a comment puts before the next; Python and Java read this alike.
CUE_PATTERN = "|".join(r"[^a-z0-9]+".join(c.split(" ")) for c in CUES)
CUE = re.compile(CUE_PATTERN)
#: A difference in a word with a digit is never within the tolerance: it costs more than any number of words.
NUMBER = re.compile(r"\d")
BARRED = 1 << 20


def lower(text: str) -> str:
    """In lower case, letter by letter: if a letter is longer in lower case, only A-Z."""
    lowered = text.lower()
    return lowered if len(lowered) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


def cue_places(lowered: str) -> list[int]:
    return [m.start() for m in CUE.finditer(lowered)]


def blocks(text: str, reach: int) -> list[tuple[int, int]]:
    """Spans of candidate blocks: every cue with `reach` words on both sides, over lines and blank lines; those that meet are one.

    Words that are filled in do not count, as they are no differences: a notice of so many words around a cue is whole.
    """
    lowered = lower(text)
    hits = cue_places(lowered)
    if not hits:
        return []
    words = list(WORDS.finditer(lowered))
    starts, ends = np.array([m.start() for m in words]), np.array([m.end() for m in words])
    counted = np.concatenate([[0], np.cumsum([not FILLED.match(m.group()) for m in words])])
    at = np.searchsorted(ends, hits, "right")  # the word that holds the cue's first letter
    first = np.searchsorted(counted, counted[at] - reach, "left")
    last = np.searchsorted(counted, counted[at] + reach + 1, "right") - 1
    spans: list[list[int]] = []
    for i, j in zip(first.tolist(), last.tolist(), strict=True):
        if spans and i <= spans[-1][1]:
            spans[-1][1] = max(j, spans[-1][1])
        else:
            spans.append([i, j])
    return [(int(starts[i]), int(ends[j - 1])) for i, j in spans]


class Scanner:
    def __init__(self, templates: dict[str, str]) -> None:
        import zstandard as zstd

        flags = {"level": 3, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstd.ZstdCompressor(**flags)
        self.names = sorted(templates)
        self.words = {n: WORDS.findall(templates[n].lower()) for n in self.names}
        self.counts = {n: Counter(self.words[n]) for n in self.names}
        self.reach = max(len(self.words[n]) + self.allowed(n) for n in self.names)
        self.with_dict = {
            n: zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(templates[n].encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT), **flags)
            for n in self.names
        }

    def ranked(self, block: str) -> tuple[int, list[tuple[int, str]]]:
        """Plain compressed size, and (bytes saved, template) from the best on."""
        data = block.encode("utf-8", "replace")
        size = len(self.plain.compress(data))
        return size, sorted(((size - len(self.with_dict[n].compress(data)), n) for n in self.names), key=lambda x: (-x[0], x[1]))

    def allowed(self, name: str) -> int:
        """Differences that a confirmed notice may have: none in a short template."""
        n = len(self.words[name])
        return int(TOLERANCE * n) if n > 12 else 0

    def possible(self, name: str, have: Counter) -> bool:
        """Whether so many words of the template occur at all that it may be confirmed; a number must."""
        missing = self.counts[name] - have
        return sum(missing.values()) <= self.allowed(name) and not any(NUMBER.search(w) for w in missing)

    def last_row(self, want: list[str], words: np.ndarray, costs: np.ndarray, strict: bool) -> np.ndarray:
        """Least differences between the template and any stretch that ends before each place, for all places."""
        total = np.concatenate([[0], np.cumsum(costs)])
        row = np.zeros(len(words) + 1, np.int64)
        for w in want:
            through = np.full(len(row), BARRED)
            through[1:][words == w] = row[:-1][words == w]
            best = np.minimum(through, row + (BARRED if strict and NUMBER.search(w) else 1))
            row = np.minimum.accumulate(best - total) + total  # words of the stretch that the template lacks
        return row

    def aligned(self, want: list[str], words: list[str], costs: list[int], strict: bool) -> list[tuple[int, int]]:
        """(word of the template, word) that agree in the stretch of least differences that ends with the last word."""
        rows = [[0] * (len(words) + 1)]
        lacks = [BARRED if strict and NUMBER.search(w) else 1 for w in want]
        for w, lack in zip(want, lacks, strict=True):
            up, row = rows[-1], [rows[-1][0] + lack]
            for j, (x, c) in enumerate(zip(words, costs, strict=True)):
                row.append(min(up[j + 1] + lack, row[j] + c, up[j] if x == w else BARRED))
            rows.append(row)
        i, j, pairs = len(want), len(words), []
        while i and j:
            if words[j - 1] == want[i - 1] and rows[i][j] == rows[i - 1][j - 1]:
                i, j = i - 1, j - 1
                pairs.append((i, j))
            elif rows[i][j] == rows[i][j - 1] + costs[j - 1]:  # rather a foreign word than a missing one: more agree
                j -= 1
            else:
                i -= 1
        return pairs[::-1]

    def stretch(self, name: str, words: np.ndarray, costs: np.ndarray, counted: np.ndarray, end: int, strict: bool = True) -> tuple[list[int], list[str]]:
        """Places of the words that agree with the template in its best stretch before `end`, and the exact differences in it."""
        want = self.words[name]
        low = int(np.searchsorted(counted, counted[end] - 2 * len(want) - 1, "left"))
        pairs = self.aligned(want, words[low:end].tolist(), costs[low:end].tolist(), strict)
        places = [low + j for _, j in pairs]
        same, own = {i for i, _ in pairs}, set(places)
        extra = [j for j in range(places[0], places[-1]) if j not in own] if places else []
        return places, [f"-{w}" for i, w in enumerate(want) if i not in same] + [f"+{words[j]}" for j in extra if not FILLED.match(words[j])]

    def notices(self, words: list[str]) -> list[tuple[str, list[int], list[str]]]:
        """All notices within the tolerance: template, places of its words, differences.

        Every template that the words' counts do not rule out is aligned with every stretch. A word belongs to one
        notice, that with the most words in common, less the differences. The words left are looked through again
        until nothing more is confirmed; a notice may stand within another's foreign words.
        """
        have = np.array(words, object)
        costs = np.array([0 if FILLED.match(w) else BARRED if NUMBER.search(w) else 1 for w in words], np.int64)
        counted = np.concatenate([[0], np.cumsum(costs > 0)])
        names, taken, found = self.names, np.zeros(len(words), bool), []
        while names:
            left = Counter(have[~taken].tolist())
            names = [n for n in names if self.possible(n, left)]
            offers = []
            for n in names:
                row = self.last_row(self.words[n], have, costs, True)
                ends = np.flatnonzero(row <= self.allowed(n))
                for run in np.split(ends, np.flatnonzero(np.diff(ends) > 1) + 1) if len(ends) else []:
                    places, diff = self.stretch(n, have, costs, counted, int(run[row[run] == row[run].min()][-1]))
                    offers.append((len(diff) - len(places), n, places, diff))
            before = len(found)
            for _, n, places, diff in sorted(offers):
                if not taken[places].any():
                    taken[places] = True
                    found.append((n, places, diff))
            if len(found) == before:
                return found
            have[taken], costs[taken] = None, BARRED
        return found

    def unconfirmed(self, block: str) -> dict:
        """The template that saves most bytes in a block without a notice, and how the nearest stretch differs from it."""
        size, ranked = self.ranked(block)
        saved, name = ranked[0] if ranked[0][0] > 0 else (0, None)
        places, diff = [], []
        if name:
            words = WORDS.findall(block.lower())
            have, costs = np.array(words, object), np.array([0 if FILLED.match(w) else 1 for w in words], np.int64)
            end = int(np.argmin(self.last_row(self.words[name], have, costs, False)))
            places, diff = self.stretch(name, have, costs, np.concatenate([[0], np.cumsum(costs)]), end, False)
        return {"license": name, "plain_bytes": size, "saved_bytes": saved, "words_same": len(places), "differences": diff, "confirmed": False}

    def scan(self, text: str) -> list[dict]:
        found = []
        lowered = lower(text)
        for start, end in blocks(text, self.reach):
            words = [(m.group(), start + m.start(), start + m.end()) for m in WORDS.finditer(lowered[start:end])]
            spans = []
            for name, places, diff in self.notices([w for w, _, _ in words]):
                a, b = words[places[0]][1], words[places[-1]][2]
                data = text[a:b].encode("utf-8", "replace")
                size = len(self.plain.compress(data))
                found.append({"start": a, "end": b, "license": name, "plain_bytes": size, "saved_bytes": size - len(self.with_dict[name].compress(data)),
                              "words_same": len(places), "differences": diff, "confirmed": True})
                spans.append((a, b))
            # what is left of the block, as far as it has a cue
            at = start
            for a, b in [*sorted(spans), (end, end)]:
                if at < a and cue_places(lowered[at:a]):
                    found.append({"start": at, "end": a, **self.unconfirmed(text[at:a])})
                at = max(at, b)
        return sorted(found, key=lambda r: (r["start"], r["end"]))


RESULT = "start bigint, end bigint, license string, plain_bytes bigint, saved_bytes bigint, words_same bigint, differences array<string>, confirmed boolean"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Notices and other candidates of every whole text: doc_id, start, end (characters), license, plain_bytes,
    saved_bytes, words_same, differences, confirmed.

    Each notice in a block whose wording differs from a template within the tolerance has a row of its own, with its
    own span, and is confirmed, if it holds a cue. A block is each cue with as many words around it as the longest
    notice has. Each stretch of the block before, between and after them that holds a cue has one row
    with confirmed = false: it is compressed alone and with each template as a raw dictionary, and the template that
    saves most bytes is named; license is null if none saves a byte. Sizes are of the row's span. Ties go to the first name. Null
    and empty texts have no block; repeated rows repeat their blocks; a null id is passed on; other columns are left
    out. There is no shuffle: the cue filter runs in the scan, only texts with a cue reach Python.
    """
    templates = templates or TEMPLATES
    kind = docs.schema["doc_id"].dataType.simpleString()
    lowered = F.lower(F.col("text"))
    # a plain search first: most texts hold no word of a cue
    some = F.lit(False)
    for c in CUES:
        some = some | F.contains(lowered, F.lit(c.split(" ")[-1] if c != "permission is" else "permission"))
    cue = some & F.rlike(lowered, F.lit(CUE_PATTERN))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            ids, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = scanner.scan(text or "")
                ids += [i] * len(found)
                rows += found
            names = [x.strip().split(" ")[0] for x in RESULT.split(", ")]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), *[pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)]],
                names=["doc_id", *names],
            )

    return docs.where(F.col("text").isNotNull() & cue).select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {RESULT}")
