"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a window of 64 words, one every 32, so any stretch of 32 words lies whole in some block; longer templates
have blocks of twice 64, 128, ... words, every half of that, so that a stretch of their length does. A block meets a
template when it contains at least THRESHOLD of the template's distinct words, and the template's phrases word for
word, which tell notices apart that differ in a word or two. The join is exact: template words are
ordered by how many documents hold them, and a block that meets the threshold must hold one of the
|T| - need + 1 rarest (prefix filter); it must have `need` distinct words left (length filter); and the words of both
that follow the matching one in that order must still reach `need` (positional filter). Only then is it counted.
Templates are bounded, so the join runs inside the scan: no document is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reverbtable.llm import flatwords as fw
from reverbtable.llm.book import query, table
from reverbtable.llm.vocabulary import document_counts, lookup

THRESHOLD = 0.9
STRIDE = 32      # words; a template of more takes the next double that holds it
MAX_TEMPLATE_BYTES = 1 << 20

# fixed values: phrases and the labels of their places
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# fixed values: wording of common license notices
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License You may obtain a copy of the License"),
    ("gpl-3.0", "licensed under the GNU General Public License version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License version 2"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY SA 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY ND 4.0"),
    ("cc0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License v 2.0"),
    ("isc", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

# fixed values: whole notices and paragraphs, with phrases that must stand there word for word
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published "
        "by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.")
_NONE = ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
         "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details.")
_GPL, _LGPL, _AGPL = "gnu general public license", "gnu lesser general public license", "gnu affero general public license"
PARAGRAPHS = [
    ("gpl-3.0", _GNU.format(_GPL, 3), [_GPL, "version 3"]),
    ("gpl-2.0", _GNU.format(_GPL, 2), [_GPL, "version 2"]),
    ("lgpl", _GNU.format(_LGPL, 3), [_LGPL]),
    ("lgpl", _GNU.format(_LGPL, 2.1), [_LGPL]),
    ("agpl", _GNU.format(_AGPL, 3), [_AGPL]),
    ("gpl", _NONE.format(_GPL), [_GPL]),
    ("lgpl", _NONE.format(_LGPL), [_LGPL]),
    ("agpl", _NONE.format(_AGPL), [_AGPL]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at", ["apache license"]),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied. See the License for the specific language governing permissions and limitations under the "
                   "License.", []),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:", []),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
            "of the Software.", []),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
            "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
            "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
            "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
            "DEALINGS IN THE SOFTWARE.", []),
]


class Index(NamedTuple):
    stride: int
    words: np.ndarray    # sorted word hashes of all templates
    rank: np.ndarray     # their place in the global order, rarest first
    labels: list[str]
    sets: list[np.ndarray]              # per template its word numbers in that order
    need: list[int]
    phrases: list[list[np.ndarray]]     # per template hashes that must follow one another in the block
    prefix: dict[int, list[tuple[int, int]]]  # word number: (template, place in its order)


def build(docs: DataFrame, templates: list[tuple], threshold: float = THRESHOLD, text: str = "text") -> list[Index]:
    """One index for each block length; templates are (label, wording) or (label, wording, phrases)."""
    if sum(len(t[1]) for t in templates) > MAX_TEMPLATE_BYTES:
        raise ValueError("templates take more than MAX_TEMPLATE_BYTES")
    parsed = [fw.words(pa.array([t[1]], pa.string()), fw.alphanumeric()) for t in templates]
    if any(not len(p.hashes) for p in parsed):
        raise ValueError("a template has no word")
    words = np.unique(np.concatenate([p.hashes for p in parsed])) if parsed else np.empty(0, np.uint64)
    n = document_counts(docs, words, text)
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((words, n))] = np.arange(len(words))
    out: dict[int, Index] = {}
    for t, p in zip(templates, parsed):
        stride = STRIDE
        while stride < len(p.hashes):
            stride *= 2
        index = out.setdefault(stride, Index(stride, words, rank, [], [], [], [], {}))
        own = np.unique(lookup(words, p.hashes)[0])
        own = own[np.argsort(rank[own])]
        need = math.ceil(threshold * len(own) - 1e-9)
        for place, word in enumerate(own[:len(own) - need + 1]):
            index.prefix.setdefault(int(word), []).append((len(index.sets), place))
        index.labels.append(t[0])
        index.sets.append(own)
        index.need.append(need)
        index.phrases.append([fw.hash_words(x.split()) for x in (t[2] if len(t) > 2 else [])])
    return [out[k] for k in sorted(out)]


def blocks(w: fw.Words, index: Index) -> Iterator[tuple[int, int, int, float]]:
    """(row, first word, template, containment) of every block that meets a template."""
    stride = index.stride
    number, has = lookup(index.words, w.hashes)
    at = np.flatnonzero(has)
    if not len(at):
        return
    number, doc = number[at], w.doc[at]
    place = at - w.first[doc]
    keys = np.array(sorted(index.prefix), np.int64)
    rare = np.flatnonzero(np.isin(number, keys))
    # a word stands in the block that starts at or before it, and in the one before that
    block = place[rare] // stride
    pairs = np.unique(np.concatenate([np.stack([doc[rare], np.maximum(block - back, 0)], 1) for back in (0, 1)]), axis=0)
    order = doc * (1 << 40) + place
    for row, b in pairs:
        lo, hi = np.searchsorted(order, [row * (1 << 40) + b * stride, row * (1 << 40) + (b + 2) * stride])
        own = np.unique(number[lo:hi])
        own = own[np.argsort(index.rank[own])]
        met = set(own.tolist())
        tried = set()
        for i, word in enumerate(own.tolist()):
            for t, j in index.prefix.get(word, ()):
                need, size = index.need[t], len(index.sets[t])
                if t in tried or len(own) < need or 1 + min(size - j - 1, len(own) - i - 1) < need - j:
                    continue
                tried.add(t)
                common = sum(x in met for x in index.sets[t].tolist())
                begin = w.first[row] + b * stride
                if common >= need and all(_stands(x, w.hashes[begin:min(begin + 2 * stride, w.first[row] + w.count[row])])
                                          for x in index.phrases[t]):
                    yield int(row), int(b) * stride, t, common / size


def _stands(phrase: np.ndarray, block: np.ndarray) -> bool:
    size = len(block) - len(phrase) + 1
    return size > 0 and bool(np.all([block[k:k + size] == word for k, word in enumerate(phrase)], axis=0).any())


def scan(docs: DataFrame, templates: list[tuple] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES,
         threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the A-Z-lower-cased text; null is an empty text. n_base counts
    the places of the phrases, first_word and last_word are the smallest and largest of their starts (null if none).
    labels adds those of met templates to the base ones; score is the best containment of a met block, 0 if none;
    blocks lists (first_word, n_words, label, containment). Repeated rows each give a row; other columns are not read.
    """
    index = docs.sparkSession.sparkContext.broadcast(build(docs, templates, threshold, text))
    spoken = [(fw.hash_words(p.split()), label) for p, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in fw.slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                yield _scan(part, fw.words(part.column(1), fw.alphanumeric()), index.value, spoken)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(run, (
        f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_base long, first_word long, "
        "last_word long, base_labels string, labels string, score double, "
        "blocks array<struct<first_word: long, n_words: long, label: string, containment: double>>"))


def _scan(part: pa.RecordBatch, w: fw.Words, indexes: list[Index], spoken: list) -> pa.RecordBatch:
    n = len(part)
    base = np.zeros(n, np.int64)
    first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    base_labels, labels, met = [set() for _ in range(n)], [set() for _ in range(n)], [[] for _ in range(n)]
    for phrase, label in spoken:
        size = len(w.hashes) - len(phrase) + 1
        if size <= 0:
            continue
        here = w.doc[:size] == w.doc[len(phrase) - 1:]
        for k, word in enumerate(phrase):
            here &= w.hashes[k:k + size] == word
        at = np.flatnonzero(here)
        row = w.doc[at]
        base += np.bincount(row, minlength=n)
        np.minimum.at(first, row, at - w.first[row])
        np.maximum.at(last, row, at - w.first[row])
        for r in np.unique(row).tolist():
            base_labels[r].add(label)
    for index in indexes:
        for row, at, t, share in blocks(w, index):
            labels[row].add(index.labels[t])
            met[row].append({"first_word": at, "n_words": min(2 * index.stride, int(w.count[row]) - at),
                             "label": index.labels[t], "containment": share})
    return pa.RecordBatch.from_arrays([
        part.column(0), pa.array(w.count), pa.array(base), pa.array(first, mask=base == 0), pa.array(last, mask=base == 0),
        pa.array([",".join(sorted(b)) for b in base_labels]),
        pa.array([",".join(sorted(b | x)) for b, x in zip(base_labels, labels)]),
        pa.array([max((m["containment"] for m in x), default=0.0) for x in met], pa.float64()),
        pa.array(met, pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("label", pa.string()),
                                          ("containment", pa.float64())])))],
        ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])


@query("op9_license_scan")
def op9(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), TEMPLATES + PARAGRAPHS).drop("blocks")
