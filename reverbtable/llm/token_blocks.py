"""Token ids in patched frame-of-reference blocks.

A segment is the binary form of a run of whole documents' ids, in blocks of 128 ids: each block keeps its minimum,
packs the differences at a width that holds 95 of 100 of them, and lists the others as exceptions. The block index
names where each block's packed words and exceptions start, so any range of ids is read without the rest.

    header  5 x uint32: magic, ids, blocks, packed words (uint32), exceptions
    index   per block 4 x uint32: minimum, width, first packed word, first exception
    packed  uint32 words, little-endian, ids of a block one after the other from the lowest bit
    exceptions  place in block uint32, difference uint32

Segments are rows of a table written by Spark, whose committer leaves no half-written or doubled file when a task
is lost or runs twice: part (range of doc_ids), segment, doc_ids, lengths, before (ids of the part before it), data.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reverbtable.llm.book import query, table
from reverbtable.llm.tokens import Encoder, tokenizer_path
from reverbtable.session import shared_dir

BLOCK = 128
PERCENT = 95
SEGMENT_IDS = 1 << 18  # a segment ends with the document that fills it
MAGIC = 0x50464F52


def encode(ids: np.ndarray) -> bytes:
    """One segment of unsigned 32-bit ids."""
    ids = np.ascontiguousarray(ids, np.uint32)
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint32)
    grid[:len(ids)] = ids
    if blocks:
        grid[len(ids):] = ids[-1]  # the last block is filled up with an id that it has anyway
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1, initial=np.iinfo(np.uint32).max) if blocks else np.zeros(0, np.uint32)
    rest = grid - low[:, None]
    bits = np.where(rest > 0, np.frexp(rest.astype(np.float64))[1], 0)
    width = np.sort(bits, axis=1)[:, BLOCK * PERCENT // 100] if blocks else np.zeros(0, np.int64)
    over = bits > width[:, None]
    row, place = np.nonzero(over)
    patches = np.stack([place.astype(np.uint32), rest[row, place]], axis=1)
    words = width.astype(np.int64) * BLOCK // 32
    starts = np.cumsum(words) - words
    packed = np.zeros(int(words.sum()), np.uint32)
    rest = np.where(over, 0, rest)
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            packed[(starts[which, None] + np.arange(words[which[0]])).ravel()] = _squeeze(rest[which], int(w)).ravel()
    first = np.cumsum(over.sum(axis=1)) - over.sum(axis=1)
    index = np.stack([low, width, starts, first], axis=1).astype("<u4") if blocks else np.zeros((0, 4), "<u4")
    header = np.array([MAGIC, len(ids), blocks, len(packed), len(patches)], "<u4")
    return b"".join(x.astype("<u4").tobytes() for x in (header, index, packed, patches))


def decode(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start..stop of a segment; only the blocks that hold them are unpacked."""
    magic, n, blocks, words, patches = (int(x) for x in np.frombuffer(data, "<u4", 5))
    if magic != MAGIC:
        raise ValueError("not a segment of token blocks")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    index = np.frombuffer(data, "<u4", 4 * blocks, 20).reshape(blocks, 4).astype(np.int64)
    at = 20 + 16 * blocks
    packed = np.frombuffer(data, "<u4", words, at)
    patch = np.frombuffer(data, "<u4", 2 * patches, at + 4 * words).reshape(-1, 2)
    lo, hi = start // BLOCK, -(-stop // BLOCK)
    low, width, starts, first = index[lo:hi].T
    rest = np.zeros((hi - lo, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            rest[which] = _stretch(packed[starts[which, None] + np.arange(w * BLOCK // 32)], int(w))
    ends = np.append(index[:, 3], patches)[lo:hi + 1]
    row = np.repeat(np.arange(hi - lo), np.diff(ends))
    mine = patch[ends[0]:ends[-1]]
    rest[row, mine[:, 0]] = mine[:, 1]
    return (rest + low[:, None].astype(np.uint32)).ravel()[start - lo * BLOCK:stop - lo * BLOCK]


def _squeeze(rest: np.ndarray, w: int) -> np.ndarray:
    """Rows of 128 values under 2^w to rows of 4w words; 32 values fill w words exactly."""
    part = rest.reshape(-1, 32).astype(np.uint64)
    out = np.zeros((len(part), w + 1), np.uint64)
    for k in range(32):
        word, shift = divmod(k * w, 32)
        moved = part[:, k] << np.uint64(shift)
        out[:, word] |= moved & np.uint64(0xFFFFFFFF)
        out[:, word + 1] |= moved >> np.uint64(32)
    return out[:, :w].astype(np.uint32).reshape(len(rest), -1)


def _stretch(words: np.ndarray, w: int) -> np.ndarray:
    part = np.concatenate([words.reshape(-1, w), np.zeros((words.size // w, 1), np.uint32)], axis=1).astype(np.uint64)
    out = np.zeros((len(part), 32), np.uint32)
    for k in range(32):
        word, shift = divmod(k * w, 32)
        both = part[:, word] | part[:, word + 1] << np.uint64(32)
        out[:, k] = (both >> np.uint64(shift)) & np.uint64((1 << w) - 1)
    return out.reshape(len(words), -1)


SEGMENTS = "part int, segment int, doc_ids array<long>, lengths array<long>, before long, data binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text",
          parts: int | None = None) -> None:
    """Write the ids of whole texts, each with end_id at its end, as segments in ascending doc_id order.

    A null text is an empty one and has only the end id; null ids come first; rows with equal ids stand in order of
    their texts; other columns are not read. An empty table writes an empty table of segments.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder, part = Encoder(tokenizer), TaskContext.get().partitionId()
        docs_, sizes, held, before, segment, now = [], [], [], 0, 0, 0
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            for lo in range(0, len(batch), 256):
                cut = batch.slice(lo, 256)
                for doc, ids in zip(cut.column(0).to_pylist(), encoder.encode(cut.column(1).to_pylist())):
                    docs_.append(doc)
                    sizes.append(len(ids) // 4 + 1)
                    held.append(ids + end)
                    now += sizes[-1]
                    if now >= SEGMENT_IDS:
                        yield _row(part, segment, docs_, sizes, before, held)
                        before, segment, now = before + now, segment + 1, 0
                        docs_, sizes, held = [], [], []
        if docs_:
            yield _row(part, segment, docs_, sizes, before, held)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranged = rows.repartitionByRange(parts, "doc_id") if parts else rows.repartitionByRange("doc_id")
    ranged.sortWithinPartitions("doc_id", "text").mapInArrow(run, SEGMENTS).write.parquet(path)


def _row(part: int, segment: int, docs: list, sizes: list, before: int, held: list) -> pa.RecordBatch:
    data = encode(np.frombuffer(b"".join(held), "<u4"))
    return pa.RecordBatch.from_arrays([
        pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([docs], pa.list_(pa.int64())),
        pa.array([sizes], pa.list_(pa.int64())), pa.array([before], pa.int64()), pa.array([data], pa.binary())],
        ["part", "segment", "doc_ids", "lengths", "before", "data"])


def read(spark, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    per_part = files.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # one row per part: as many as the writer had partitions
    base = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                docs, sizes, start, data = (batch.column(n)[k].as_py() for n in ("doc_ids", "lengths", "start", "data"))
                ids = decode(data)
                ends = np.cumsum([0, *sizes])
                parts = [ids[a:b] for a, b in zip(ends, ends[1:])]
                columns = [pa.array(docs, pa.int64()), pa.array(start + ends[:-1]), pa.array(sizes, pa.int64()),
                           pa.array([Encoder.crc(p.astype("<u4").tobytes()) for p in parts], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return files.join(F.broadcast(base), "part").select(
        "doc_ids", "lengths", (F.col("base") + F.col("before")).alias("start"), "data").mapInArrow(run, schema)


@query("op4_token_blocks")
def op4(spark, sf_dir):
    path = f"{shared_dir(spark).rstrip('/')}/token-blocks-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return read(spark, path, with_ids=False)
