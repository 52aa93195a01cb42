"""Resampling towards a target distribution: hashed run features, array-scored weights, exact draw without sorting all.

Every feature (a run of words) falls into one of a fixed number of buckets. Counts of the buckets over all documents
and over the target texts give one whole-number gain per bucket; the gains are an array that tasks look features up in.
A document's weight is the sum of its features' gains; with a seeded Gumbel draw added, the highest scores are an
importance resample without replacement.

The cutoff is found by weighted median-of-medians selection: every task reduces its remaining keys to the median of
medians of fixed runs of rows, the driver takes the median of these weighted by remaining rows, one count tells the
side, and the other side goes. At least an eighth of the remaining rows goes each round (about half in practice), and
remaining rows are written anew when they have shrunk, so all rounds together read a few times the first one's rows.
Only the winners are sorted.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reverbtable.llm import flatwords as fw
from reverbtable.llm.book import query, table
from reverbtable.session import written

BUCKETS = 10_000
RUN = 1 << 16       # rows whose median is taken at once
REST = 4_096        # so many remaining keys are sorted on the driver
LONG = 64           # features of more bytes are hashed one by one
STRIDE = 1 << 20    # bytes of a long text that are cut at a time

_crc = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _crc = np.where(_crc & 1, np.uint32(0xEDB88320) ^ (_crc >> np.uint32(1)), _crc >> np.uint32(1))


def crc32s(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of data[begin:end] for each pair, byte by byte over all of them at once."""
    size = end - begin
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    out = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-size, -LONG, side="left"))  # these come first
    for k in range(long):
        out[k] = zlib.crc32(data[begin[k]:begin[k] + size[k]]) ^ 0xFFFFFFFF
    for k in range(int(size[long]) if long < len(size) else 0):
        hi = int(np.searchsorted(-size, -k, side="left"))
        now = out[long:hi]
        out[long:hi] = _crc[(now ^ data[begin[long:hi] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out ^ np.uint32(0xFFFFFFFF)
    return back


def features(texts: pa.Array, longest: int = 1, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of every run of 1 to `longest` consecutive words, joined by one space; null is an empty text.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ once A-Z are lower-cased. A text of more than STRIDE bytes is cut between
    words, and the last words of a cut are handed to the next one, so runs across cuts count once.
    """
    is_word = fw.alphanumeric()
    ends = fw._offsets(texts)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) and ends[-1] > ends[0] else np.empty(0, np.uint8)
    for lo, hi in fw.slices(texts, STRIDE):
        if hi - lo > 1 or ends[hi] - ends[lo] <= STRIDE:
            yield from _runs(raw[ends[lo]:ends[hi]], ends[lo:hi + 1] - ends[lo], lo, 0, longest, buckets, is_word)
            continue
        at, held = int(ends[lo]), np.empty(0, np.uint8)
        while at < ends[hi]:
            to = min(at + STRIDE, int(ends[hi]))
            while to < ends[hi] and is_word[raw[to]]:
                to += 1
            part = np.concatenate([held, raw[at:to]])
            old = _words(held, np.array([0, len(held)]), is_word)[0]
            yield from _runs(part, np.array([0, len(part)]), lo, len(old), longest, buckets, is_word)
            begin = _words(part, np.array([0, len(part)]), is_word)[0]
            keep = min(longest - 1, len(begin))
            held = np.append(part[begin[-keep]:], np.uint8(32)) if keep else held[:0]
            at = to


def _words(raw: np.ndarray, starts: np.ndarray, is_word: np.ndarray):
    """First and past-the-end byte of every word."""
    inside = is_word[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True
    left, right = inside.copy(), inside.copy()
    left[1:] &= ~inside[:-1] | edge[1:-1]
    right[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(left), np.flatnonzero(right) + 1


def _runs(raw, starts, row, old, longest, buckets, is_word):
    begin, end = _words(raw, starts, is_word)
    if not len(begin):
        return
    doc = np.searchsorted(starts, begin, side="right") - 1
    low = raw.copy()
    low[(low >= 65) & (low <= 90)] += 32
    if longest > 1:  # words joined by one space
        size = end - begin
        fresh = np.cumsum(size + 1) - size - 1
        joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
        joined[np.repeat(fresh - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = low[
            np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        low, begin, end = joined, fresh, fresh + size
    for n in range(1, longest + 1):
        first = np.arange(max(len(begin) - n + 1, 0))
        last = first + n - 1
        ok = (doc[first] == doc[last]) & (last >= old)
        first, last = first[ok], last[ok]
        yield (crc32s(low, begin[first], end[last]) % np.uint32(buckets)).astype(np.int64), doc[first] + row


def counts(texts: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts, repeats counted; at most `buckets` numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, _ in features(batch.column(0), longest, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p_target / p_source)) per bucket, one added to each count."""
    n, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(all_s + n) / (float(s + 1) * float(all_t + n))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor of 1000 times a Gumbel draw by the digest of seed and id; a null id is written as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_features long, n_words long, weight long, score long, tie long"


def scores(docs: DataFrame, gain: np.ndarray, seed: int = 2024, text: str = "text", doc_id: str = "doc_id",
           longest: int = 1) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, tie (a number per row, fixed once the table is written).

    gain is broadcast: one long per bucket, whatever the tables hold. One row out per row in; a null or empty text
    has no features and weight 0; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        gain, tie = held.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            n = len(batch)
            size, words, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for k, (bucket, row) in enumerate(features(batch.column(1), longest, len(gain))):
                lo, hi = int(row[0]) if len(row) else 0, int(row[-1]) + 1 if len(row) else 0
                found = np.bincount(row - lo, minlength=hi - lo)
                size[lo:hi] += found
                ends = np.cumsum(np.append(0, gain[bucket]))
                at = np.cumsum(np.append(0, found))
                weight[lo:hi] += ends[at[1:]] - ends[at[:-1]]
                if k % longest == 0:
                    words[lo:hi] += found
            score = weight + np.array([noise(d, seed) for d in batch.column(0).to_pylist()], np.int64).reshape(n)
            ties = np.arange(tie, tie + n)
            tie += n
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (size, words, weight, score, ties))],
                                             ["doc_id", "n_features", "n_words", "weight", "score", "tie"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCORED)


def cutoff(rows: DataFrame, keys: list[str], k: int) -> tuple | None:
    """The k-th smallest key of rows, keys being non-null longs that together are unique; None if there are fewer.

    rows should be a written table: each round reads what remains of it. The driver holds one median a task, and
    sorts the keys when at most REST remain.
    """
    left, low, high = rows.select(*keys), None, None
    n = held = left.count()
    if not 0 < k <= n:
        return None
    while True:
        inside = _between(left, keys, low, high)
        if n <= REST:
            return sorted(tuple(r) for r in inside.collect())[k - 1]
        pivot = _pivot(sorted((tuple(r[:-1]), r["n"]) for r in _medians(inside, keys).collect()))
        below = inside.where(_struct(keys) <= _literal(keys, pivot)).count()
        if below == k:
            return pivot
        if below > k:
            high, n = pivot, below
        else:
            low, k, n = pivot, k - below, n - below
        if 8 * n <= held:
            left, held = written(_between(left, keys, low, high), "remaining"), n


def _struct(keys):
    return F.struct(*[F.col(c) for c in keys])


def _literal(keys, values):
    return F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(keys, values)])


def _between(rows: DataFrame, keys: list[str], low: tuple | None, high: tuple | None) -> DataFrame:
    """Rows over low and not over high; the bounds of the first key reach the scan."""
    if low is not None:
        rows = rows.where((F.col(keys[0]) >= low[0]) & (_struct(keys) > _literal(keys, low)))
    if high is not None:
        rows = rows.where((F.col(keys[0]) <= high[0]) & (_struct(keys) <= _literal(keys, high)))
    return rows


def _pivot(medians: list[tuple[tuple, int]]) -> tuple:
    """Lower weighted median of sorted (key, weight)."""
    half, seen = sum(w for _, w in medians) / 2, 0
    for key, w in medians:
        seen += w
        if seen >= half:
            return key
    raise ValueError("nothing to choose from")


def _medians(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a task: the weighted median of the medians of its runs of rows, and its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, n = [], [], 0

        def close():
            columns = [np.concatenate([b[i] for b in held]) for i in range(len(keys))]
            order = np.lexsort(columns[::-1])
            at = order[(len(order) - 1) // 2]
            found.append((tuple(int(c[at]) for c in columns), len(order)))

        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in range(len(keys))])
            n += len(batch)
            if n >= RUN:
                close()
                held, n = [], 0
        if n:
            close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*_pivot(sorted(found)), sum(w for _, w in found))],
                                             [*keys, "n"])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in keys) + ", n long")


def ranked(rows: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """rows with their place (from 1) in the order of keys, by sorted ranges; no range holds all."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = len(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part)), pa.array(np.arange(at, at + n))],
                                             [*batch.schema.names, "_part", "_at"])
            at += n

    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
        number, f"{schema}, _part long, _at long"), "ranked")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as ranges
    base = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return placed.join(F.broadcast(base), "_part").select(*rows.columns, (F.col("_base") + F.col("_at") + 1).alias(name))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024,
             longest: int = 1, buckets: int = BUCKETS, text: str = "text", doc_id: str = "doc_id",
             target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank: every row of docs, the drawn ones numbered from the highest score.

    Drawn are floor(percent * N / 100) of the N rows with at least least_words words; equal scores go to the smaller
    doc_id (a null one first), and rows alike in both are taken in the order of the scored table. Null and empty
    texts have no features and weight 0. Rows may repeat and count each time. An empty target leaves all gains to
    the counts of docs; an empty table gives no rows; other columns are not read.
    """
    gain = gains(counts(docs, text, longest, buckets), counts(target, target_text, longest, buckets))
    rows = written(scores(docs, gain, seed, text, doc_id, longest), "scored").withColumns({
        "_down": -F.col("score"), "_id": F.coalesce("doc_id", F.lit(-(1 << 63)))})
    may = F.col("n_words") >= least_words
    keys = ["_down", "_id", "tie"]
    last = cutoff(rows.where(may), keys, percent * rows.where(may).count() // 100)
    won = may & (_struct(keys) <= _literal(keys, last)) if last else F.lit(False)
    out = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked(rows.where(won).select(*out, *keys), keys).select(*out, "rank")
    return drawn.union(rows.where(~won).select(*out, F.lit(None).cast("long").alias("rank")))


SQL = """
WITH crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k:
       CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
marks AS (SELECT regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
of_docs AS (SELECT rid, unnest(words) AS word FROM docs),
of_marks AS (SELECT unnest(words) AS word FROM marks),
spelt AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM of_docs UNION SELECT DISTINCT word FROM of_marks)),
buckets AS (SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2),
              lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
              lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM spelt, crc_table),
source AS (SELECT bucket, count(*) AS s FROM of_docs JOIN buckets USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM of_marks JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM of_docs) AS all_s, (SELECT count(*) FROM of_marks) AS all_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE /
           ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS g FROM source LEFT JOIN target USING (bucket), totals),
summed AS (SELECT rid, count(*) AS n, sum(g)::BIGINT AS w FROM of_docs JOIN buckets USING (word) JOIN gain USING (bucket) GROUP BY rid),
scored AS (SELECT rid, doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
             coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
               / 4294967296::DOUBLE)))::BIGINT AS score FROM docs LEFT JOIN summed USING (rid)),
drawn AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, rid) AS r, 10 * count(*) OVER () // 100 AS k
          FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= k THEN r END AS rank FROM scored LEFT JOIN drawn USING (rid)
"""


@query("op13_importance_resampling", SQL)
def op13(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
