"""License scans by an exact set-similarity join of text blocks with templates.

A block is a line, or a paragraph (lines up to a blank one). A template is met
where at least its threshold of its distinct words stands in the block. Words are
ordered by how many documents have them, rarest first. A block that meets a
template of m words at need = ceil(threshold x m) has one of the template's
m - need + 1 rarest words (prefix filter), has at least `need` distinct words
(length filter), and with the k-th word of that order as its first shared one, can
share at most m - k + 1 (positional filter). What is left is counted exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_rows, text_of

#: Phrases with their labels, as the scan's contract names them.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, blocks to compare ("line" or "paragraph"), least share of words, wording of public licenses and their notices.
TEMPLATES = (
    ("apache-2.0-notice", "line", 0.9, "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0-notice", "line", 0.9, "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc-4.0-notice", "line", 0.9, "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0-notice", "line", 0.9, "Licensed under CC BY-SA 4.0"),
    (
        "mit-text",
        "paragraph",
        0.8,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    (
        "apache-2.0-text",
        "paragraph",
        0.8,
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    ),
    (
        "gpl-text",
        "paragraph",
        0.8,
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    (
        "bsd-text",
        "paragraph",
        0.8,
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    (
        "isc-text",
        "paragraph",
        0.8,
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl-2.0-text",
        "paragraph",
        0.8,
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
    (
        "lgpl-text",
        "paragraph",
        0.9,
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    ),
    (
        "agpl-text",
        "paragraph",
        0.9,
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    (
        "epl-2.0-text",
        "paragraph",
        0.8,
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "unlicense-text",
        "paragraph",
        0.8,
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ),
    (
        "cc0-text",
        "paragraph",
        0.8,
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    ),
    (
        "cc-by-4.0-text",
        "paragraph",
        0.8,
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ),
)

#: ASCII characters other than digits and letters part words.
APART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().translate(APART).split()


@dataclass(frozen=True)
class Template:
    label: str
    block: str
    need: int
    #: Distinct words, rarest first.
    order: tuple[bytes, ...]

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.order[: len(self.order) - self.need + 1]

    def share(self, block: set[bytes]) -> float:
        """The share of the template's words in the block; 0 where it stays under the threshold."""
        m = len(self.order)
        if len(block) < self.need:
            return 0.0
        first = next((k for k, w in enumerate(self.prefix) if w in block), None)
        if first is None or m - first < self.need:
            return 0.0
        hits = sum(w in block for w in self.order[first:])
        return hits / m if hits >= self.need else 0.0


def ordered(templates: tuple, counts: dict[bytes, int]) -> tuple[Template, ...]:
    out = []
    for label, block, least, text in templates:
        distinct = sorted(set(words_of(text)), key=lambda w: (counts.get(w, 0), w))
        out.append(Template(label, block, math.ceil(round(least * len(distinct), 9)), tuple(distinct)))
    return tuple(out)


def blocks_of(text: str) -> dict[str, list[str]]:
    """Lines, and paragraphs: lines up to one of spaces, tabs and carriage returns only."""
    lines = text.split("\n")
    paragraphs, run = [], []
    for line in [*lines, ""]:
        if line.strip(" \t\r"):
            run.append(line)
        elif run:
            paragraphs.append("\n".join(run))
            run = []
    return {"line": lines, "paragraph": paragraphs}


def phrase_places(words: list[bytes], phrases: dict[str, str]) -> tuple[list[tuple[int, str]], int]:
    """(first word, label) of each place where a phrase stands."""
    joined = b" " + b" ".join(words) + b" "
    places = []
    for phrase, label in phrases.items():
        needle = b" " + phrase.encode() + b" "
        before, word, at = 0, 0, joined.find(needle)
        while at >= 0:
            word += joined.count(b" ", before, at)
            places.append((word, label))
            before, at = at, joined.find(needle, at + len(needle) - 1)
    return places, len(words)


def _counted(vocabulary: frozenset[bytes]):
    def run(batches):
        seen: Counter[bytes] = Counter()
        for b in few_rows(batches):
            for t in b.column("text").to_pylist():
                seen.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return run


def _scanned(templates: tuple[Template, ...], phrases: dict[str, str]):
    rare = frozenset(w for t in templates for w in t.prefix)

    def run(batches):
        for b in few_rows(batches):
            rows = []
            for t in b.column("text").to_pylist():
                words = words_of(t)
                places, n = phrase_places(words, phrases)
                labels = {label for _, label in places}
                base, score = ",".join(sorted(labels)), 1.0 if places else 0.0
                if not rare.isdisjoint(words):
                    for kind, blocks in blocks_of(t).items():
                        some = [x for x in templates if x.block == kind]
                        for block in blocks:
                            own = set(words_of(block))
                            if rare.isdisjoint(own):
                                continue
                            for x in some:
                                if share := x.share(own):
                                    labels.add(x.label)
                                    score = max(score, share)
                at = [p for p, _ in places]
                rows.append((n, len(places), min(at, default=None), max(at, default=None), base, ",".join(sorted(labels)), score))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", *names])

    return run


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per record: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Two passes over whole texts: one counts in how many documents each template word stands (so many counts
    reach the driver as templates have words), one joins. Null text is empty: no words, null places, no
    labels, score 0. Null ids and repeated rows pass through; ids are cast to long. A text's time and memory grow with
    its length. An empty table gives no rows. No text moves.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(df, text_col).alias("text"))
    vocabulary = frozenset(w for _, _, _, text in templates for w in words_of(text))
    counts = docs.mapInArrow(_counted(vocabulary), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = ordered(templates, {bytes(r["word"]): r["n"] for r in counts})
    return docs.mapInArrow(_scanned(found, phrases), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
