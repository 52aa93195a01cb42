"""N-gram Jaccard join by chosen paths.

Every text is the set of its five-word shingles. Texts with equal sets form one class; a class carries a minwise
sample of its shingles. A run starts with all classes in one bucket; each bucket splits on a few sampled shingles
(sample places drawn by the bucket's own path), so two classes stay together where they share the sampled shingle.
Buckets of at most `leaf` classes, and buckets that a split no longer shrinks because their members are alike, are
compared by brute force (every two blocks of WIDTH classes meet in one task); the others split again. A pair with similarity s survives a split into m branches with
q = 1 - (1 - s q)^m at any depth, so `runs` is the least number with 1 - (1 - q)^runs >= recall.

Comparisons on samples only choose candidates. A class with a candidate partner is checked exactly: candidates form
groups, groups are cut by set size and into blocks, and every two blocks whose sizes can reach the threshold meet in
one task that counts common shingles of all their classes. So the pairs stay inside numpy: a task returns a link
count per class and a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from reverbtable.llm import flatwords as fw
from reverbtable.llm.book import query, table
from reverbtable.llm.components import components
from reverbtable.session import written

THRESHOLD = 0.8
SHINGLE = 5
RECALL = 0.9999
BRANCHES = 2      # sampled shingles per split
SAMPLE = 64       # minwise values kept per class
LEAF = 256        # a bucket of more classes splits again
WIDTH = 2048      # samples per side when a bucket that no longer shrinks is compared in blocks
BLOCK = 512       # classes per side of an exact check
SLACK = 5.0       # standard deviations of the sample estimate below the threshold that still count as candidates

_SEEDS = fw.mix(np.arange(1, SAMPLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def runs_needed(recall: float = RECALL, threshold: float = THRESHOLD, branches: int = BRANCHES) -> int:
    q = 1.0
    for _ in range(200):
        q = 1 - (1 - threshold * q) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - q)))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                    recall: float = RECALL, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, copy_id, class_id, n_links, n_near.

    copy_id is the smallest id with the same shingle set, class_id the smallest id reachable over links, n_links the
    number of other rows at or above the threshold (equal sets included), n_near the number of other sets among them.
    Words are A-Z-lower-cased runs of [^\\x20\\x09-\\x0D]. A text without words (null, empty) is in a class of its
    own with no links; one with fewer than five words has one shingle. A null id stands for the hash of its text.
    Repeated ids count as rows of their own. Other columns of docs are not read; an empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text)).alias("doc_id"), F.col(text).alias("text"))
    sketches = written(rows.mapInArrow(
        _sketch, "doc_id long, node long, check long, n int, sample binary, brief binary"), "sketches")
    some = sketches.where("n > 0")
    # n and the samples follow from the set, so they may stand in the key; partial aggregates meet copies early
    classes = written(some.groupBy("node", "check", "n", "sample", "brief").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies")).drop("check"), "classes")
    grouped = components(_candidates(classes, threshold, recall, leaf))
    counts, links = _verified(rows, classes, grouped, threshold, block)
    joined = (classes.select("node", "rep", "copies").join(counts, "node", "left")
              .join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")))
    smallest = joined.groupBy("root").agg(F.min("rep").alias("class_id"))
    found = written(joined.join(smallest, "root").select(
        "node", F.col("rep").alias("copy_id"), "class_id",
        (F.col("copies") - 1 + F.coalesce("near_rows", F.lit(0))).alias("n_links"),
        F.coalesce("near", F.lit(0)).cast("long").alias("n_near")), "found")
    none = F.lit(0).cast("long")
    wordless = sketches.where("n = 0").select("doc_id", F.col("doc_id").alias("copy_id"),
                                              F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_near"))
    return some.select("doc_id", "node").join(found, "node").drop("node").unionByName(wordless)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without all but the smallest id of each near-duplicate class; all columns stay.

    Rows that repeat an id and its text count once; an id on several texts has each of them judged; texts without words
    stay.
    """
    ids = F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(text))
    key = F.xxhash64(ids, text)  # an id may stand on several texts, each of which has a class of its own
    brief = docs.select(ids.alias("_id"), key.alias("_key"))
    classes = near_duplicates(docs.select(key.alias("doc_id"), F.col(text).alias("text")), **how)
    kept = brief.join(classes.select(F.col("doc_id").alias("_key"), "class_id").distinct(), "_key").groupBy("class_id").agg(
        F.min(F.struct("_id", "_key")).alias("_first")).select(F.col("_first._key").alias("_key"))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), key.alias("_key"))
    again = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    return keyed.join(kept, "_key", "left_semi").withColumn("_again", again).where("_again = 1").select("_row.*")


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted by row, their rows, and the number per row."""
    hashes, row = fw.ngrams(fw.words(texts, fw.spaced()), SHINGLE)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[new], row[new]
    return hashes, row, np.bincount(row, minlength=len(texts))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in fw.slices(batch.column("text")):
            hashes, row, n = _shingles(batch.column("text").slice(lo, hi - lo))
            sample = np.zeros((hi - lo, SAMPLE), np.uint32)
            some = np.flatnonzero(n)
            at = (np.cumsum(n) - n)[some]
            f1, f2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
            if len(some):
                with np.errstate(over="ignore"):
                    f1[some] = np.add.reduceat(hashes, at)
                    f2[some] = np.add.reduceat(fw.mix(hashes), at)
                    for k, seed in enumerate(_SEEDS):
                        turned = (((hashes ^ seed) * (seed | np.uint64(1))) >> np.uint64(32)).astype(np.uint32)
                        sample[some, k] = np.minimum.reduceat(turned, at)
            brief = (fw.mix(sample.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)  # enough to compare by
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(lo, hi - lo), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                pa.array(n.astype(np.int32)), pa.array([s.tobytes() for s in sample], pa.binary()),
                pa.array([s.tobytes() for s in brief], pa.binary())],
                ["doc_id", "node", "check", "n", "sample", "brief"])


def _candidates(classes: DataFrame, threshold: float, recall: float, leaf: int) -> DataFrame:
    """Forest edges (a, b) between classes over all pairs that met in a compared bucket and look alike."""
    low = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / SAMPLE)
    starts = F.array(*[F.xxhash64(F.lit(f"run {r}")) for r in range(runs_needed(recall, threshold))])
    level = classes.select("node", "sample", F.explode(starts).alias("path"), F.lit(None).cast("long").alias("size"))
    found = None
    while True:
        # every bucket draws the sample places of its branches from its own path
        drawn = level.select("node", "sample", "size", "path", F.explode(F.sequence(
            F.lit(0), F.lit(BRANCHES - 1))).alias("branch")).withColumn(
            "place", F.pmod(F.xxhash64("path", "branch"), F.lit(SAMPLE)).cast("int")).select(
            "node", "size", F.xxhash64("path", "branch", F.substring("sample", 1 + 4 * F.col("place"), F.lit(4))).alias("path"))
        sizes = drawn.groupBy("path").agg(F.count("*").alias("new")).where("new > 1")
        # a bucket is done when it is small, or when most of its parent's members share what it was split on
        done = (F.col("new") <= leaf) | (F.col("size").isNotNull() & (F.col("new") * 2 > F.col("size")))
        split = written(drawn.join(sizes, "path").select(
            "node", "path", F.col("new").alias("size"), done.alias("done")), "paths")
        edges = _compared(split.where("done").join(classes.select("node", "n", "brief"), "node"), low, threshold)
        found = edges if found is None else found.unionByName(edges)
        level = split.where("not done").drop("done").join(classes.select("node", "sample"), "node")
        if split.where("not done").isEmpty():
            return found


def _by_unit(work):
    """Arrow function that hands the rows of each `unit` (rows come sorted by it) to work, however batches cut them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, carry = None, []
        for batch in batches:
            unit = batch.column("unit").to_numpy()
            cuts = np.flatnonzero(np.concatenate([unit[:1] == unit[:1], unit[1:] != unit[:-1]]))
            for at, to in zip(cuts, [*cuts[1:], len(unit)]):
                if carry and unit[at] != key:
                    yield from work(pa.Table.from_batches(carry))
                    carry = []
                key = unit[at]
                carry.append(batch.slice(at, to - at))
        if carry:
            yield from work(pa.Table.from_batches(carry))
    return run


def _matrix(column: pa.ChunkedArray, width: int, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _compared(rows: DataFrame, low: float, threshold: float) -> DataFrame:
    """Forest edges of each bucket's look-alikes; a large bucket is cut in blocks, every two of which meet in one unit."""
    def forest(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        brief = _matrix(table.column("brief"), SAMPLE, np.uint8)
        parent, out = np.arange(len(node)), []
        for i in range(len(node) - 1):
            # only members of other trees can add an edge
            other = i + 1 + np.flatnonzero(parent[i + 1:] != parent[i])
            other = other[(n[other] >= threshold * n[i]) & (n[i] >= threshold * n[other])]
            if len(other):
                for j in other[(brief[other] == brief[i]).sum(axis=1) >= low * SAMPLE]:
                    if parent[j] != parent[i]:
                        parent[parent == parent[j]] = parent[i]
                        out.append((node[i], node[j]))
        if out:
            a, b = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = rows.withColumn("blocks", F.ceil(F.col("size") / WIDTH).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node", "path"), "blocks").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64(
        "path", F.least(k, "mine"), F.greatest(k, "mine")))
    units = rows.select(F.explode(meets).alias("unit"), "node", "n", "brief")
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_by_unit(forest), "a long, b long")


def _verified(rows: DataFrame, classes: DataFrame, grouped: DataFrame, threshold: float,
              block: int) -> tuple[DataFrame, DataFrame]:
    """Exact links inside candidate groups: (node, near, near_rows) and forest edges (a, b)."""
    member = written(grouped.join(classes.select("node", "n", "rep", "copies"), "node"), "members")
    fill = member.groupBy("root").agg(F.count("*").alias("members"))
    # n <= m can only reach the threshold where n >= threshold * m: bands of that width, of which next ones meet
    member = member.join(fill, "root").withColumn("band", F.when(F.col("members") <= block, 0).otherwise(
        F.floor(F.log("n") / -math.log(threshold))).cast("int"))
    sizes = member.groupBy("root", "band").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    under = sizes.select("root", (F.col("band") + 1).alias("band"), F.col("blocks").alias("under"))
    over = sizes.select("root", (F.col("band") - 1).alias("band"), F.col("blocks").alias("over"))
    around = (sizes.join(under, ["root", "band"], "left").join(over, ["root", "band"], "left")
              .na.fill(0, ["under", "over"]))
    placed = member.join(around, ["root", "band"]).withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))

    def unit(cross, *parts):
        return F.struct(F.xxhash64("root", *parts).alias("unit"), cross.alias("cross"))

    def each(count, make):
        return F.slice(F.transform(F.sequence(F.lit(0), F.col(count)), make), F.lit(1), F.col(count))

    same = each("blocks", lambda k: unit(k != F.col("mine"), "band", F.least(k, "mine"), "band", F.greatest(k, "mine")))
    up = each("over", lambda k: unit(F.lit(True), "band", "mine", F.col("band") + 1, k))
    down = each("under", lambda k: unit(F.lit(True), F.col("band") - 1, k, "band", "mine"))
    placed = placed.select(F.col("rep").alias("doc_id"), "node", "copies", F.xxhash64("band", "mine").alias("side"),
                           F.concat(same, up, down).alias("units"))
    sets = rows.join(placed.hint("shuffle_hash"), "doc_id").mapInArrow(
        _sets, "node long, copies long, side long, units array<struct<unit: long, cross: boolean>>, shingles binary")
    units = sets.select(F.explode("units").alias("u"), "node", "copies", "side", "shingles").select(
        "u.unit", "u.cross", "node", "copies", "side", "shingles")
    out = written(units.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(
        _by_unit(lambda table: _links(table, threshold)), "node long, near long, near_rows long, other long"), "links")
    counts = out.where("near is not null").groupBy("node").agg(F.sum("near").alias("near"), F.sum("near_rows").alias("near_rows"))
    return counts, out.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("node", "copies", "side", "units")
    for batch in batches:
        for lo, hi in fw.slices(batch.column("text")):
            part = batch.slice(lo, hi - lo)
            hashes, row, n = _shingles(part.column("text"))
            ends = np.cumsum(n)
            node = part.column("node").to_numpy()
            packed, mine = [], []
            for i, (end, k) in enumerate(zip(ends, n)):
                own = hashes[end - k:end]
                if k and np.add.reduce(own).view(np.int64) == node[i]:  # a repeated id may have other texts
                    packed.append(own.tobytes())
                    mine.append(i)
            part = part.take(pa.array(mine, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(packed, pa.binary())],
                                             [*names, "shingles"])


def _links(table: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of one unit: common shingles of all its sets by products of slices of the incidence matrix."""
    node = table.column("node").to_numpy()
    first = np.concatenate([[True], node[1:] != node[:-1]])  # rows repeated in the input
    if first.sum() < 2:
        return
    node, copies = node[first], table.column("copies").to_numpy()[first]
    side, cross = table.column("side").to_numpy()[first], table.column("cross")[0].as_py()
    sets = [np.frombuffer(s, np.uint64) for s, f in zip(table.column("shingles").to_pylist(), first) if f]
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    token, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = times[inverse] > 1
    owner, column = owner[keep], shared[inverse[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    total = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, total, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        has = np.zeros((len(sets), min(width, total - at)), np.float32)
        has[owner[lo:hi], column[lo:hi] - at] = 1
        common += has @ has.T
    link = common * (1 + threshold) >= threshold * (n[:, None] + n[None, :]) - 1e-4
    np.fill_diagonal(link, False)
    if cross:
        link &= side[:, None] != side[None, :]
    near = link.sum(axis=1)
    some = np.flatnonzero(near)
    if not len(some):
        return
    yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(near[some].astype(np.int64)),
                                      pa.array((link[some] @ copies).astype(np.int64)),
                                      pa.nulls(len(some), pa.int64())], ["node", "near", "near_rows", "other"])
    seen, edges = np.zeros(len(node), bool), []
    for start in some:
        stack = [] if seen[start] else [start]
        seen[start] = True
        while stack:
            at = stack.pop()
            new = np.flatnonzero(link[at] & ~seen)
            seen[new] = True
            edges += [(node[at], node[j]) for j in new]
            stack += new.tolist()
    a, b = np.array(edges, np.int64).T
    empty = pa.nulls(len(a), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(a), empty, empty, pa.array(b)], ["node", "near", "near_rows", "other"])


@query("op2_ngram_jaccard_join")
def op2(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
