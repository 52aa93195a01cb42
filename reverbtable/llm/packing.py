"""Best-fit packing by minimum bin slack.

A bin is filled by a bitset subset-sum over the lengths still available, longest first: the fullest feasible
combination holds the longest piece. Only the number of pieces per length matters, so a combination is taken as many
times as the counts allow. Each step leaves less than half of some length's pieces and fewer than fit in one bin, so
there are at most sum(1 + log2(capacity / length)) < 2.5 * capacity steps however many pieces there are. Pieces are
then numbered within their length and read their bin and place off the list of combinations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reverbtable.llm.book import query, table
from reverbtable.llm.tokens import Encoder, tokenizer_path
from reverbtable.session import written

CAPACITY = 4096
SALTS = 256  # slices of a length that are numbered apart


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Lengths of the fullest bin that holds the longest piece; among equally full ones longer pieces go first."""
    lengths = sorted(counts, reverse=True)
    room = capacity - lengths[0]
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    steps, reach = [], 1
    for k, length in enumerate(lengths):
        if length > room or reach & goal:
            continue
        left, part = min(counts[length] - (k == 0), room // length), 1
        while left > 0:  # so many copies by doubling
            part = min(part, left)
            new = (reach | reach << part * length) & mask
            if new != reach:
                steps.append((reach, part, length))
                reach = new
            left -= part
            part *= 2
    at, used = reach.bit_length() - 1, {lengths[0]: 1}
    for before, part, length in reversed(steps):
        if not before >> at & 1:
            at -= part * length
            used[length] = used.get(length, 0) + part
    return used


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces per bin}) until no piece is left."""
    left, out = {k: n for k, n in counts.items() if n > 0}, []
    while left:
        used = fullest(left, capacity)
        times = min(left[k] // n for k, n in used.items())
        out.append((times, used))
        for k, n in used.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return out


def pack(pieces: DataFrame, keys: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id long (from 0) and offset long; every sequence is filled gapless from offset 0.

    keys order pieces of equal length (ties are broken by nothing else: rows that agree in keys are alike). A length
    under 1, over the capacity or null is refused. pieces should be a written table, as it is read more than once;
    its columns stay, those named sequence_id or offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    ok = F.col(length).between(1, capacity)
    salted = pieces.withColumn("_length", F.coalesce(F.when(ok, F.col(length).cast("int")), F.raise_error(
        F.lit(f"piece lengths must lie in 1..{capacity}")).cast("int"))).withColumn(
        "_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    # at most capacity * SALTS counts
    counts = salted.groupBy("_length", "_salt").agg(F.count("*").alias("_n"))
    per_length = {r["_length"]: r["n"] for r in counts.groupBy("_length").agg(F.sum("_n").alias("n")).collect()}
    found = combinations(per_length, capacity)
    plan = pieces.sparkSession.sparkContext.broadcast(_lookup(found, capacity))
    start = F.sum("_n").over(Window.partitionBy("_length").orderBy("_salt")) - F.col("_n")
    number = F.row_number().over(Window.partitionBy("_length", "_salt").orderBy(*keys))
    ranked = salted.join(counts.withColumn("_start", start).drop("_n"), ["_length", "_salt"]).withColumn(
        "_rank", (F.col("_start") + number - 1).cast("long"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, rows = plan.value
        for batch in batches:
            size, rank = batch.column("_length").to_numpy().astype(np.int64), batch.column("_rank").to_numpy()
            length_of, start_of, per_bin, bin_of, offset_of = rows[:, _find(firsts, rows, size, rank)]
            which = rank - start_of
            columns = {n: batch.column(n) for n in batch.schema.names if n not in ("_length", "_rank")}
            columns["sequence_id"] = pa.array(bin_of + which // per_bin)
            columns["offset"] = pa.array(offset_of + which % per_bin * size)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kept = ranked.select(*pieces.columns, "_length", "_rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return kept.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def _lookup(found: list, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Per length and combination: (length, first number, pieces per bin, first bin, offset in the bin), sorted.

    A bin holds at most sqrt(2 * capacity) distinct lengths and there are under 2.5 * capacity combinations, so this
    is under 37 MB for 4096 whatever the input; a few hundred kB is usual.
    """
    rows, seen, first_bin = [], {}, 0
    for times, used in found:
        offset = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.append((length, seen.get(length, 0), n, first_bin, offset))
            seen[length] = seen.get(length, 0) + n * times
            offset += n * length
        first_bin += times
    rows.sort()
    out = np.array(rows, np.int64).reshape(-1, 5).T
    return np.searchsorted(out[0], np.arange(capacity + 2)), out


def _find(firsts: np.ndarray, rows: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Index of the entry of that length with the largest first number not over the rank, by bisection of all at once."""
    low, high = firsts[size], firsts[size + 1]
    while np.any(high - low > 1):
        mid = (low + high) // 2
        up = (rows[1][np.minimum(mid, rows.shape[1] - 1)] <= rank) & (high - low > 1)
        low, high = np.where(up, mid, low), np.where(up, high, np.where(high - low > 1, mid, high))
    return low


def pieces_of(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, doc_id: str = "doc_id",
              text: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts and cut those over the capacity: doc_id, piece, start, length, ids_crc32 (and ids).

    Every text gets end_id at its end, so a null or empty text is one piece of one id. Null doc_ids stay null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                out: tuple = ([], [], [], [], [], [])
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    raw = ids + int(end_id).to_bytes(4, "little")
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        cut = raw[at:at + 4 * capacity]
                        for column, value in zip(out, (doc, k, at // 4, len(cut) // 4, encoder.crc(cut), cut)):
                            column.append(value)
                arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if with_ids:
                    data = np.frombuffer(b"".join(out[5]), "<u4").astype(np.int32)
                    ends = np.cumsum([0, *out[3]]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(data)))
                yield pa.RecordBatch.from_arrays(arrays, names[:len(arrays)])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences of placed pieces that carry ids; at most `capacity` ids each."""
    held = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(held.alias("held")).select(
        "sequence_id", F.flatten("held.ids").alias("ids"), F.col("held.doc_id").alias("doc_ids"))


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    pieces = written(pieces_of(docs, tokenizer_path(tokenizer), 1, capacity), "pieces")
    return pack(pieces, ["doc_id", "piece", "ids_crc32"], capacity=capacity)


@query("op1_best_fit_packing")
def op1(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
