"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut in passages of 32 words, one every 16. Their TF-IDF matrix (document counts over the whole
corpus) gets a randomised SVD: each round multiplies the distributed passages with a thin matrix and sums the result
by word, so a round moves one short vector per word and partition. Every passage of every document is projected on
the leading directions; where its cosine with an item's passage reaches SIMILAR and its part along that passage
WEIGHT of its length, the text around is a candidate.
No rank holds every item of a large benchmark, so an exact filter adds what that search misses: a text that meets the
rule below lacks few of an item's words, so of some of the rarest it holds at least `hits` in one window; every such
window is a candidate.
Candidates are checked by the longest common subsequence of words with the item: nearly all of the item is a leak;
half of it is one when the item's rarest words, its answer, stand there too, which finds paraphrases.
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

PASSAGE, STRIDE = 32, 16
RANK = 192
ROUNDS = 2
SIMILAR = 0.6            # cosine with an item's passage
WEIGHT = 0.5             # and length against that passage: less cannot hold half of it
VERBATIM = 0.8            # share of the item's words in order
PARAPHRASE, ANSWER = 0.5, 0.8  # share in order, and share of the answer's words
HITS = 4                  # words of the exact filter that must stand in one window, fewer for short items
MAX_BROADCAST = 4 << 20   # bytes of item texts per pass; a larger benchmark takes several passes
SLICE_BYTES = 256 << 10


class Item(NamedTuple):
    item_id: int | None
    words: np.ndarray   # hashes in order
    answer: frozenset   # hashes of the rarest third of its distinct words
    distinct: frozenset
    repeated: int       # words beyond the distinct ones
    hits: int           # of its `rarest` words so many stand in every leak
    rarest: np.ndarray


class Index(NamedTuple):
    words: np.ndarray     # sorted hashes of all items' words
    vectors: np.ndarray   # per word: idf times its row of the basis
    passages: np.ndarray  # unit latent vectors of the items' passages
    lengths: np.ndarray   # their lengths before
    owner: np.ndarray     # item of each passage
    items: list[Item]
    holds: np.ndarray     # items that have a word among their rarest, by word
    begins: np.ndarray    # per word number: where its items begin in holds
    sizes: np.ndarray     # words of each item
    hits: np.ndarray      # and its hits


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", similar: float = SIMILAR, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """One row per document and item that it leaks: doc_id, item_id, first_word, share, answer_share.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the A-Z-lower-cased text; share is the longest common
    subsequence over the item's words, at its best place, around first_word. Null and empty texts or items match
    nothing; a null doc_id stands for the hash of its text; repeated rows or items each give their rows. Empty tables
    give no rows; other columns are not read.
    """
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text)).alias("doc_id"), F.col(text).alias("text"))
    bench = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, math.ceil(size / max_broadcast))
    out = None
    for k in range(passes):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else bench
        found = _pass(docs, part, similar)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that leak a benchmark item; all columns stay."""
    key = F.xxhash64(doc_id, text)  # an id may stand on several texts
    gone = leaks(docs.select(key.alias("doc_id"), F.col(text).alias("text")), benchmark).select(
        F.col("doc_id").alias("_gone")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_gone"))
    return keyed.join(gone, "_gone", "left_anti").select("_row.*")


def _pass(docs: DataFrame, bench: DataFrame, similar: float) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(build(docs, bench))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in fw.slices(batch.column("text"), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                found = list(_search(fw.words(part.column("text"), fw.alphanumeric()), index.value, similar))
                if found:
                    row, item, first, share, answers = zip(*found)
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id").take(pa.array(row)), pa.array([index.value.items[i].item_id for i in item], pa.int64()),
                        pa.array(first, pa.int64()), pa.array(share, pa.float64()), pa.array(answers, pa.float64())],
                        ["doc_id", "item_id", "first_word", "share", "answer_share"])

    return docs.mapInArrow(run, "doc_id long, item_id long, first_word long, share double, answer_share double")


def build(docs: DataFrame, bench: DataFrame) -> Index:
    """The latent index of a benchmark part of bounded size; document counts cover all docs."""
    rows = [(r["item_id"], fw.words(pa.array([r["text"]], pa.string()), fw.alphanumeric()).hashes)
            for r in bench.where("text is not null").collect()]  # at most MAX_BROADCAST bytes
    rows = sorted(((i, w) for i, w in rows if len(w)), key=lambda r: (r[0] is None, r[0], r[1].tolist()))
    words = np.unique(np.concatenate([w for _, w in rows])) if rows else np.empty(0, np.uint64)
    if not rows:
        return Index(words, np.zeros((0, RANK), np.float32), np.zeros((0, RANK), np.float32),
                     np.zeros(0, np.float32), np.zeros(0, np.int64), [], *[np.zeros(0, np.int64)] * 4)
    counts = document_counts(docs, words)
    idf = np.log((1 + docs.count()) / (1 + counts)) + 0.1  # words of every document count little, but count
    owner, numbers = [], []
    for k, (_, w) in enumerate(rows):
        own = lookup(words, w)[0]
        for at in range(0, max(1, len(own) - STRIDE), STRIDE):
            owner.append(k)
            numbers.append(own[at:at + PASSAGE])
    spark = docs.sparkSession
    passages = spark.createDataFrame([(n.tolist(), idf[n].tolist()) for n in numbers], "words array<int>, weights array<double>")
    basis = randomised_svd(passages, len(words), min(RANK, len(words), len(numbers)))
    vectors = (idf[:, None] * basis).astype(np.float32)
    latent = np.stack([vectors[n].sum(axis=0) for n in numbers])
    lengths = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
    latent /= lengths[:, None]
    items = []
    for i, w in rows:
        own = np.unique(w)
        rare = own[np.argsort(-idf[lookup(words, own)[0]], kind="stable")]
        hits, size = rare_hits(len(w), len(own))
        items.append(Item(i, w, frozenset(rare[:max(1, len(rare) // 3)].tolist()),
                          frozenset(own.tolist()), len(w) - len(own), hits, rare[:size]))
    number = lookup(words, np.concatenate([i.rarest for i in items]))[0]
    order = np.argsort(number, kind="stable")
    holds = np.repeat(np.arange(len(items)), [len(i.rarest) for i in items])[order]
    begins = np.searchsorted(number[order], np.arange(len(words) + 1))
    return Index(words, vectors, latent.astype(np.float32), lengths.astype(np.float32), np.array(owner), items,
                 holds, begins, np.array([len(i.words) for i in items]), np.array([i.hits for i in items]))


def rare_hits(n: int, distinct: int) -> tuple[int, int]:
    """(hits, size): whatever meets the rule for an item of n words holds `hits` of its `size` rarest distinct words."""
    answer = max(1, distinct // 3)
    lacks = n - math.ceil(VERBATIM * n - 1e-9)  # a distinct word that is not there costs a place at least
    answers = math.ceil(ANSWER * answer - 1e-9)
    hits = max(1, min(HITS, answers, distinct - lacks))
    return hits, min(distinct, max(lacks, answer - answers) + hits)


def randomised_svd(passages: DataFrame, width: int, rank: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors (width x rank) of a distributed sparse matrix of rows (words, weights)."""
    z = np.random.default_rng(seed).standard_normal((width, rank))
    for _ in range(rounds + 1):
        q, _ = np.linalg.qr(z)
        z = _gram(passages, q)
    # the small matrix q' A'A q turns q into singular directions
    value, turn = np.linalg.eigh(q.T @ z)
    return q @ turn[:, np.argsort(-value)]


def _gram(passages: DataFrame, q: np.ndarray) -> np.ndarray:
    """A'(A q), summed over partitions by word."""
    held = passages.sparkSession.sparkContext.broadcast(q)

    def rows_of(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(
                [v.tobytes() for v in total.values()], pa.binary())], ["word", "v"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for words, weights in zip(batch.column("words").to_pylist(), batch.column("weights").to_pylist()):
                row = np.asarray(weights) @ held.value[words]
                for word, weight in zip(words, weights):
                    total[word] = total.get(word, 0) + weight * row
        yield from rows_of(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for word, v in zip(batch.column("word").to_pylist(), batch.column("v").to_pylist()):
                total[word] = total.get(word, 0) + np.frombuffer(v)
        yield from rows_of(total)

    schema = "word int, v binary"
    sums = passages.mapInArrow(multiply, schema).repartition("word").mapInArrow(add, schema)
    out = np.zeros(q.shape)
    for r in sums.collect():  # one vector per word of the benchmark part
        out[r["word"]] = np.frombuffer(r["v"])
    return out


def _search(w: fw.Words, index: Index, similar: float) -> Iterator[tuple[int, int, int, float, float]]:
    """(row, item, first word, share, share of the answer) of the leaks among the texts of a slice."""
    if not len(index.items) or not len(w.hashes):
        return
    number, has = lookup(index.words, w.hashes)
    at = np.flatnonzero(has)
    if not len(at):
        return
    # sums over 16-word blocks of each text; a passage is a block and the next one of the same text
    n_blocks = -(-w.count // STRIDE)
    first_block = np.cumsum(n_blocks) - n_blocks
    doc = w.doc[at]
    block = first_block[doc] + (at - w.first[doc]) // STRIDE
    new = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    sums = np.zeros((int(n_blocks.sum()) + 1, index.vectors.shape[1]), np.float32)
    sums[block[new]] = np.add.reduceat(index.vectors[number[at]], new, axis=0)
    row_of = np.repeat(np.arange(len(w.count)), n_blocks)
    follows = np.append(row_of[1:] == row_of[:-1], False)
    sums[:-1][follows] += sums[1:][follows]  # evaluated on the right before it is added
    sums = sums[:-1]
    norm = np.linalg.norm(sums, axis=1)
    some = np.flatnonzero(norm > 0)
    along = sums[some] @ index.passages.T
    near, passage = np.nonzero((along >= similar * norm[some][:, None]) & (along >= WEIGHT * index.lengths))
    pairs = np.unique(np.concatenate([np.stack([some[near], index.owner[passage]], axis=1), _exact(
        index, number[at], doc, at - w.first[doc], n_blocks, first_block)]), axis=0)
    best: dict[tuple[int, int], tuple[float, float, int]] = {}
    for b, i in pairs.tolist():
        row, item = int(row_of[b]), index.items[i]
        start, size = int(b - first_block[row]) * STRIDE, len(item.words)
        # the item may reach out of the passage on either side
        lo, hi = max(0, start - size), min(int(w.count[row]), start + PASSAGE + size)
        here = w.hashes[w.first[row] + lo:w.first[row] + hi].tolist()
        if len(item.distinct.intersection(here)) < PARAPHRASE * len(item.distinct) - item.repeated:
            continue  # too few words for half of the item in any order
        share = common_subsequence(item.words, here) / size
        answers = len(item.answer.intersection(here)) / len(item.answer)
        if share >= VERBATIM or (share >= PARAPHRASE and answers >= ANSWER):
            best[row, i] = max(best.get((row, i), (0.0, 0.0, 0)), (share, answers, start))
    for (row, i), (share, answers, start) in sorted(best.items()):
        yield row, i, start, share, answers


def _exact(index: Index, number: np.ndarray, doc: np.ndarray, place: np.ndarray, n_blocks: np.ndarray,
           first_block: np.ndarray) -> np.ndarray:
    """(block, item) wherever the window that _search takes around a block can hold hits rarest words of the item."""
    many = index.begins[number + 1] - index.begins[number]
    some = np.flatnonzero(many)
    many = many[some]
    back = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    item = index.holds[np.repeat(index.begins[number[some]], many) + back]
    row, at = np.repeat(doc[some], many), np.repeat(place[some], many)
    order = np.lexsort((at, item, row))
    item, row, at = item[order], row[order], at[order]
    size, hits = index.sizes[item], index.hits[item]
    last = np.arange(len(item)) + hits - 1
    inside = np.minimum(last, len(item) - 1)
    good = (last < len(item)) & (item[inside] == item) & (row[inside] == row) & (at[inside] - at < 2 * size + PASSAGE)
    item, row, size, first, end = item[good], row[good], size[good], at[good], at[inside[good]]
    # blocks whose window holds both ends
    lo = np.maximum(0, (end - PASSAGE - size) // STRIDE + 1)
    hi = np.minimum(n_blocks[row] - 1, (first + size) // STRIDE)
    many = np.maximum(hi - lo + 1, 0)
    back = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return np.stack([np.repeat(first_block[row] + lo, many) + back, np.repeat(item, many)], axis=1)


def common_subsequence(a: np.ndarray, b: list[int]) -> int:
    """Length of the longest common subsequence, with the places of a as bits of one integer."""
    places: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        hit = v & places.get(x, 0)
        if hit:
            v = ((v + hit) | (v - hit)) & full
    return len(a) - v.bit_count()


@query("op8_decontamination")
def op8(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
