"""Ordered prefix operators that survive a hot key.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Here a key is cut
into blocks along its order: windows run per (key, block), one summary row per block
is scanned per key, and the summary is joined back as a carry. The blocks are a
function of the data, so a lost executor recomputes the same split.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

BLOCK_US = 600_000_000  # ten minutes of timeline per block
BLOCK_ROWS = 1 << 16  # rows of a dense series per block: one summary row for so many
CUTS = 256  # blocks that one sketch cuts a key into at most
SLICE_ROWS = 100_000  # rows of a seeded order that are sorted together


@dataclass(frozen=True)
class Agg:
    """One running value. kind: sum | count | max | min | last (last non-null)."""

    kind: str
    expr: Column | None = None
    exclusive: bool = False
    reverse: bool = False  # along descending order


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Repartition to the session's shuffle width. A stated width keeps AQE from merging
    partitions by their compact size ahead of heavy per-row work."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(width, *keys)


def attach(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join one lookup row per key to many rows of that key.

    Adaptive execution splits a hot key only where both join inputs are plain exchanges. An
    aggregated lookup is already partitioned by its keys and would be joined in place, so it is
    moved once more first: it is narrow, and the rows of a hot key then spread over tasks (or
    the join turns to a broadcast if the lookup proves small).
    """
    return rows.join(lookup.repartition(F.xxhash64(*keys)), keys, how)


def time_block(col: str, width: float | Column = BLOCK_US) -> Column:
    return F.floor(F.col(col) / (width if isinstance(width, Column) else F.lit(width))).cast("long")


def with_row_blocks(df: DataFrame, keys: list[str], order: str, rows: int = BLOCK_ROWS, name: str = "_cut", levels: int = 1) -> DataFrame:
    """Add the number of a row's block along ``order`` (a whole number), for blocks of about ``rows`` rows.

    Only keys with more than ``rows`` rows are cut, at quantiles of a mergeable sketch; a row finds its block by
    bisection of its key's cuts. A burst is cut as finely as its rows, a quiet stretch is one block. Rows of equal
    ``order`` share a block. One level makes up to CUTS blocks per key; each further one cuts blocks that are over
    twice ``rows`` again. Rows without a value come first.
    """
    out = _cut(df, keys, order, rows, name)
    for level in range(1, levels):
        finer = _cut(out, [*keys, name], order, 2 * rows, f"{name}{level}")
        out = finer.withColumn(name, F.col(name) * CUTS + F.col(f"{name}{level}")).drop(f"{name}{level}")
    return out


def _cut(df: DataFrame, keys: list[str], order: str, rows: int, name: str) -> DataFrame:
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
    ranks = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    sketch = F.kll_sketch_agg_bigint(F.col(order).cast("long"), F.lit(4096))  # ranks within a thousandth
    found = df.select(*keys, order).join(large, keys).groupBy(*keys).agg(sketch.alias("_sk"), F.max("_n").alias("_n"))
    many = F.least(F.ceil(F.col("_n") / rows), F.lit(CUTS)).cast("int")
    quantiles = found.select(*keys, many.alias("_m"), F.kll_sketch_get_quantile_bigint("_sk", ranks).alias("_q"))
    cuts = quantiles.select(*keys, F.transform(F.sequence(F.lit(1), F.col("_m") - 1), lambda i: F.get(
        "_q", F.floor(i * CUTS / F.col("_m")).cast("int") - 1)).alias("_cuts"))

    def step(at, size):
        return F.when((at + size <= F.size("_cuts")) & (F.get("_cuts", at + size - 1) < F.col(order)), at + size).otherwise(at)

    steps = F.array(*[F.lit(CUTS >> k) for k in range(1, CUTS.bit_length())])
    before = F.when(F.col("_cuts").isNull() | F.col(order).isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), step))
    return attach(df, cuts, keys, "left").select(*df.columns, before.cast("long").alias(name))


def slices(df: DataFrame, rows: int = SLICE_ROWS) -> Column:
    """How many slices of about so many rows the table takes, as a scalar of the plan: it grows with the table."""
    return df.select((F.floor(F.count(F.lit(1)) / rows) + 1).cast("long")).scalar()


def digest_block(digest: str, count: Column) -> Column:
    """Slice of a hex digest among ``count``; slices follow the digest's order."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) * count).cast("long")


def scan(df: DataFrame, keys: list[str], order: list[str], block: Column,
         aggs: dict[str, Agg], fan: int | None = None) -> DataFrame:
    """Add running columns along ``order``, each ascending or (``reverse``) descending.

    ``block`` must be monotone in ``order`` and ``order`` total within a key. With ``fan``
    (numeric blocks only) the block summaries are themselves scanned in runs of ``fan``
    blocks, for keys with so many blocks that their summaries are too many for one task.
    Both directions share one exchange and one summary: ask for them in one call.
    """
    rows = df.withColumn("_blk", block)
    part = [*keys, "_blk"]
    by_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))

    def ordered(window, cols, a):
        return window.orderBy(*[F.col(c).desc() if a.reverse else F.col(c).asc() for c in cols])

    summary, carry, local = [], [], {}
    for name, a in aggs.items():
        inner, outer = ordered(W.partitionBy(*part), order, a), ordered(by_key, ["_blk"], a)
        frame = inner.rowsBetween(W.unboundedPreceding, -1 if a.exclusive else 0)
        before = outer.rowsBetween(W.unboundedPreceding, -1)
        s, c = f"_s_{name}", f"_c_{name}"
        if a.kind == "count":
            summary.append(F.count(F.lit(1)).alias(s))
            carry.append(F.sum(s).over(before).alias(c))
            local[name] = F.count(F.lit(1)).over(frame)
        elif a.kind == "last":
            newest = F.min if a.reverse else F.max
            summary.append(newest(F.when(a.expr.isNotNull(), F.struct(*order, a.expr.alias("_v"))))
                           .getField("_v").alias(s))
            carry.append(F.last(s, ignorenulls=True).over(before).alias(c))
            local[name] = F.last(a.expr, ignorenulls=True).over(frame)
        else:
            fn = {"sum": F.sum, "max": F.max, "min": F.min}[a.kind]
            summary.append(fn(a.expr).alias(s))
            carry.append(fn(s).over(before).alias(c))
            local[name] = fn(a.expr).over(frame)

    blocks = rows.groupBy(*part).agg(*summary)
    if fan is None:
        carried = blocks.select(*part, *carry)
    else:
        upper = {f"_c_{name}": Agg("sum" if a.kind == "count" else a.kind, F.col(f"_s_{name}"), True, a.reverse)
                 for name, a in aggs.items()}
        carried = (scan(blocks.withColumnRenamed("_blk", "_b"), keys, ["_b"], F.floor(F.col("_b") / fan).cast("long"), upper)
                   .select(*keys, F.col("_b").alias("_blk"), *upper))
    out = rows.withColumns(local).join(carried, part, "left")
    merged = []
    for name, a in aggs.items():
        here, past = F.col(name), F.col(f"_c_{name}")
        if a.kind in ("sum", "count"):
            both = F.coalesce(here, F.lit(0)) + F.coalesce(past, F.lit(0))
        elif a.kind == "last":
            both = F.coalesce(here, past)
        else:
            both = (F.greatest if a.kind == "max" else F.least)(here, past)
        merged.append(both.alias(name))
    return out.select(*df.columns, *merged)


def row_index(df: DataFrame, keys: list[str], order: list[str], block: Column,
              name: str = "n", base: int = 0) -> DataFrame:
    """Dense position within a key, counted without sorting the key in one task."""
    out = scan(df, keys, order, block, {name: Agg("count", exclusive=True)})
    return out.withColumn(name, F.col(name) + F.lit(base).cast("long"))


def _timeline(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str],
              left_rank: int) -> DataFrame:
    """Both tables on one ordered line; ``left_rank`` 0 puts left rows before right ones at equal times."""
    payload = F.struct(F.col(time).alias(time), *values)
    lrows = left.select(*keys, F.col(time), F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"))
    rrows = right.select(*keys, F.col(time), F.lit(None).alias("_l"), payload.alias("_r"))
    return (lrows.withColumn("_k", F.lit(left_rank)).unionByName(rrows.withColumn("_k", F.lit(1 - left_rank)))
            .withColumn("_tie", F.xxhash64("_l", "_r")))


def _scan_timeline(both: DataFrame, keys: list[str], time: str, width: float | Column | None, aggs: dict[str, Agg]) -> DataFrame:
    """In blocks of so much time, or (None) of so many rows."""
    if width is not None:
        return scan(both, keys, [time, "_k", "_tie"], time_block(time, width), aggs)
    return scan(with_row_blocks(both, keys, time), keys, [time, "_k", "_tie"], F.col("_cut"), aggs)


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str],
         block_width: float | Column | None = None, strict: bool = True, forward: bool = False,
         out: str = "hit") -> DataFrame:
    """Attach the nearest earlier (or later) right row to every left row, as struct ``out``.

    Union plus a blocked last-non-null scan: linear in rows, no pair is ever formed.
    """
    both = _timeline(left, right, keys, time, values, 0 if strict != forward else 1)
    found = _scan_timeline(both, keys, time, block_width, {out: Agg("last", F.col("_r"), reverse=forward)})
    return found.filter(F.col("_l").isNotNull()).select("_l.*", out)


def asof_both(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str],
              block_width: float | None = None, before: str = "before", after: str = "after") -> DataFrame:
    """The last right row at or before every left row and the first one strictly after it."""
    both = _timeline(left, right, keys, time, values, 1)
    found = _scan_timeline(both, keys, time, block_width, {
        before: Agg("last", F.col("_r")), after: Agg("last", F.col("_r"), reverse=True)})
    return found.filter(F.col("_l").isNotNull()).select("_l.*", before, after)


def ewma(df: DataFrame, keys: list[str], n: str, x: str, alpha: float, out: str,
         first_counts_full: bool = True, cap: int = 1 << 20) -> DataFrame:
    """s_n = alpha*s_{n-1} + (1-alpha)*x_n over dense n = 0, 1, ... for alpha in [0, 1].

    With ``first_counts_full`` s_0 = x_0, otherwise the recursion starts from zero.
    """
    if not 0.0 <= alpha <= 1.0:
        raise ValueError(f"alpha must lie in [0, 1], not {alpha}")
    if alpha == 0.0:
        return df.select(*df.columns, F.col(x).cast("double").alias(out))
    if alpha == 1.0:  # the first value for ever, or zero
        if not first_counts_full:
            return df.select(*df.columns, F.lit(0.0).alias(out))
        first = df.filter(F.col(n) == 0).select(*keys, F.col(x).cast("double").alias("_x0"))
        whole = attach(df, first, keys, "left") if keys else df.withColumn("_x0", first.select("_x0").scalar())
        return whole.select(*df.columns, F.coalesce("_x0", F.lit(0.0)).alias(out))
    gain = F.lit(1.0 - alpha)
    if first_counts_full:
        gain = F.when(F.col(n) == 0, 1.0).otherwise(gain)
    return decayed_sum(df.withColumn("_g", F.col(x) * gain), keys, n, "_g", alpha, out, cap).drop("_g")


def decayed_sum(df: DataFrame, keys: list[str], n: str, x: str, alpha: float, out: str, cap: int = 1 << 20) -> DataFrame:
    """s_n = alpha*s_{n-1} + x_n over dense n = 0, 1, ..., for alpha in (0, 1).

    Inside a block of L rows the recursion is a running sum of x*alpha^-i times alpha^i. L is chosen so that
    alpha^L is about 1e-30, or is ``cap``. Up to 1e-10 three earlier blocks carry every digit a double can hold;
    above it the block ends follow the same recursion with alpha^L, on a table ``cap`` times smaller.
    """
    length = max(1, min(cap, int(69.0 / -math.log(alpha))))
    i = F.col(n) % length
    rows = df.withColumns({"_blk": F.floor(F.col(n) / length).cast("long"), "_i": i,
                           "_q": F.col(x) * F.pow(F.lit(alpha), -i.cast("double"))})
    part = [*keys, "_blk"]
    local = F.sum("_q").over(W.partitionBy(*part).orderBy(n).rowsBetween(W.unboundedPreceding, 0))
    ends = rows.groupBy(*part).agg((F.sum("_q") * F.pow(F.lit(alpha), F.lit(length - 1.0))).alias("_end"))
    step = alpha ** length
    if step > 1e-10:
        carry = decayed_sum(ends.withColumnRenamed("_blk", "_b"), keys, "_b", "_end", step, "_carry", cap).select(
            *keys, (F.col("_b") + 1).alias("_blk"), "_carry")
    else:
        # a block hands its end to the next three: an equi-join and a sum, no ordering of blocks
        carry = (ends.select(*keys, "_blk", "_end", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("_k"))
                 .groupBy(*keys, (F.col("_blk") + F.col("_k")).alias("_blk"))
                 .agg(F.sum(F.col("_end") * F.pow(F.lit(step), (F.col("_k") - 1).cast("double"))).alias("_carry")))
    decayed = F.pow(F.lit(alpha), F.col("_i").cast("double"))
    return (rows.withColumn("_local", local).join(carry, part, "left")
            .select(*df.columns, (decayed * (F.col("_local") + F.lit(alpha) * F.coalesce("_carry", F.lit(0.0)))).alias(out)))
