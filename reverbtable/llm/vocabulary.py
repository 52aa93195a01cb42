"""Counts of a bounded vocabulary over all documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reverbtable.llm import flatwords as fw


def document_counts(docs: DataFrame, words: np.ndarray, text: str = "text") -> np.ndarray:
    """In how many documents each of the (sorted, bounded) word hashes stands; counts over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for lo, hi in fw.slices(batch.column(0)):
                w = fw.words(batch.column(0).slice(lo, hi - lo), fw.alphanumeric())
                number, has = lookup(words, w.hashes)
                seen = np.unique(w.doc[has] * len(words) + number[has])
                total += np.bincount(seen % len(words), minlength=len(words))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    out = np.zeros(len(words), np.int64)
    for r in docs.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]  # at most len(words) rows
    return out


def lookup(words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each hash in the sorted words, and whether it is one of them."""
    at = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
    return at, (words[at] == hashes) if len(words) else np.zeros(len(hashes), bool)
