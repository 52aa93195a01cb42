"""Sharding: minimax contiguous partition of ordered atomic groups.

Equal texts share a digest, and the first 16 bits of the digest name one of 65,536 ordered atomic groups, so copies
never part and the driver's work is bounded whatever the table's size: it gets one size per group. A binary search
finds the smallest shard capacity that a greedy pass can keep; cuts are then placed nearest to even shares within
that capacity. Numbers inside a shard come from prefix counts over groups and over 256 slices of each group, so a
group that holds a third of all rows is numbered by many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from reverbtable.llm.book import query, table
from reverbtable.session import written

GROUPS = 1 << 16
SLICES = 256
ROW_BYTES = 16


def capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity for which a greedy pass over the ordered sizes needs at most so many shards."""
    ends = list(accumulate(sizes, initial=0))
    low, high = max([*sizes, -(-ends[-1] // shards)]), ends[-1]
    while low < high:
        mid = (low + high) // 2
        if _greedy(ends, mid) <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def _greedy(ends: list[int], cap: int) -> int:
    used = at = 0
    while at < len(ends) - 1:
        at = bisect_right(ends, ends[at] + cap) - 1
        used += 1
    return used


def cuts(sizes: list[int], shards: int) -> list[int]:
    """First group of shards 1, 2, ...: nearest to even shares of what is left, at the smallest capacity."""
    ends = list(accumulate(sizes, initial=0))
    cap, total, n = capacity(sizes, shards), ends[-1], len(sizes)
    # earliest[k]: from here the rest fits in k shards
    earliest, at = [n], n
    for _ in range(shards):
        at = bisect_left(ends, ends[at] - cap)
        earliest.append(at)
    out, at = [], 0
    for left in range(shards - 1, 0, -1):
        goal = ends[at] + (total - ends[at]) / (left + 1)
        to = bisect_left(ends, goal)
        if to and to > at and goal - ends[to - 1] <= ends[min(to, n)] - goal:
            to -= 1
        last = bisect_right(ends, ends[at] + cap) - 1
        at = min(max(to, earliest[left], at), last)
        out.append(at)
    return out


def assign(docs: DataFrame, shards: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard (from 0), slot (gapless from 0 in a shard).

    size is the UTF-8 bytes of the text plus 16; a null text counts as empty. Rows with equal texts share a shard,
    whatever their ids; repeated rows have slots of their own; null ids are allowed. An empty table gives no rows,
    other columns are not read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(
        F.col(doc_id).alias("doc_id"), _size(t).alias("size"), F.crc32(t).alias("text_crc32"), _group(t).alias("group"),
        F.pmod(F.xxhash64(doc_id), F.lit(SLICES)).cast("int").alias("slice")), "rows")
    shard = _shard(rows, shards)
    parts = rows.groupBy("group", "slice").agg(F.count("*").alias("n")).withColumn("shard", shard)
    inside = Window.partitionBy("shard", "group").orderBy("slice")
    groups = parts.groupBy("shard", "group").agg(F.sum("n").alias("n_group"))
    before = groups.withColumn("base", F.sum("n_group").over(
        Window.partitionBy("shard").orderBy("group")) - F.col("n_group")).drop("n_group")
    starts = parts.withColumn("in_group", F.sum("n").over(inside) - F.col("n")).join(before, ["shard", "group"]).select(
        "group", "slice", "shard", (F.col("base") + F.col("in_group")).alias("base"))
    number = F.row_number().over(Window.partitionBy("group", "slice").orderBy("doc_id", "text_crc32", "size"))
    return rows.join(starts, ["group", "slice"]).select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        (F.col("base") + number - 1).cast("long").alias("slot"))


def write_shards(docs: DataFrame, shards: int, path: str, text: str = "text") -> None:
    """Write docs in one folder per shard; each task writes the rows it has read, so no shard meets in one task."""
    t = F.coalesce(F.col(text), F.lit(""))
    shard = _shard(docs.select(_size(t).alias("size"), _group(t).alias("group")), shards)
    docs.withColumn("group", _group(t)).withColumn("shard", shard).drop("group").write.partitionBy("shard").parquet(path)


def _size(t: Column) -> Column:
    return F.octet_length(t).cast("long") + ROW_BYTES


def _group(t: Column) -> Column:
    return F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int")


def _shard(rows: DataFrame, shards: int) -> Column:
    """Shard of a row by its group, cut after the sizes of rows(group, size)."""
    sums = {r["group"]: r["size"] for r in rows.groupBy("group").agg(F.sum("size").alias("size")).collect()}
    sizes = [sums.get(g, 0) for g in range(GROUPS)]  # at most GROUPS numbers, whatever the table holds
    firsts = F.array(*[F.lit(c) for c in cuts(sizes, shards)])
    return F.size(F.filter(firsts, lambda c: c <= F.col("group")))


@query("op6_sharding")
def op6(spark, sf_dir):
    return assign(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
