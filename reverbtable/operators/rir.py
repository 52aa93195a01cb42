"""Labels of room impulse responses. Input rows: key columns plus ``h ARRAY<DOUBLE>``.

Per-record labels are pure column expressions (no shuffle). Only the decay curve needs
ordered sums: the compact arrays are hash-partitioned first and exploded afterwards, so
no exploded sample ever crosses the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reverbtable.functions import arrays as A, kernels as K
from reverbtable.functions.acoustics import DP_HALF_MS
from reverbtable.functions.scan import Agg, attach, scan

# fixed values: regression levels in dB, start-major
T60_GRID = [(start, start + span) for start in range(-5, -20, -2) for span in range(-10, -29, -2)]
LEVELS = sorted({level for pair in T60_GRID for level in pair}, reverse=True)


# ---- validity and direct path -------------------------------------------------------

def is_valid(h: Column) -> Column:
    """No NaN, no infinity, not all zero."""
    odd = F.exists(h, lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf"))) | v.isNull())
    return ~odd & F.exists(h, lambda v: v != 0.0)


def dp_index(h: Column) -> Column:
    return A.argmax(h)


def dp_mask(h: Column, fs: int, half_ms: float = DP_HALF_MS) -> Column:
    """Keep the samples around the global maximum, zero elsewhere."""
    half = int(fs * half_ms / 1000)
    return A.let(A.argmax(h), lambda nd: F.transform(
        h, lambda v, i: F.when(F.abs(i - nd) <= half, v).otherwise(0.0)))


def local_peaks(h: Column) -> Column:
    """ARRAY<STRUCT<height, n>> of local maxima; a plateau counts once, at its middle."""
    def runs_of(h):
        changes = F.filter(F.sequence(F.lit(0), F.size(h) - 1),
                           lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1)))
        return A.let(changes, lambda starts: F.transform(starts, lambda s, j: F.struct(
            F.get(h, s).alias("height"),
            F.floor((s + F.coalesce(F.get(starts, j + 1), F.size(h)) - 1) / 2).cast("int").alias("n"),
            F.get(h, s - 1).alias("before"),
            F.get(h, F.get(starts, j + 1)).alias("after"))))

    runs = A.let(h, runs_of)
    tops = F.filter(runs, lambda p: (p["before"] < p["height"]) & (p["after"] < p["height"]))
    return F.transform(tops, lambda p: F.struct(p["height"].alias("height"), p["n"].alias("n")))


def dp_from_peaks(h: Column, ratio: float = 0.5, largest: int = 5) -> Column:
    """Earliest of the largest peaks that reach ``ratio`` of the maximum; null if none."""
    ranked = F.array_sort(F.transform(local_peaks(h), lambda p: F.struct(
        (-p["height"]).alias("neg"), p["n"].alias("n"))))
    top = A.let(F.array_max(h), lambda mx: F.filter(
        F.slice(ranked, 1, largest), lambda p: -p["neg"] >= ratio * mx))
    return F.array_min(F.transform(top, lambda p: p["n"]))


def dp_in_head(h: Column, fs: int, search_s: float = 1 / 160, ratio: float = 0.5, largest: int = 5) -> Column:
    """Direct path by peaks among the first int(fs * search_s) samples only; null if they hold no peak."""
    return dp_from_peaks(A.cut(h, 0, int(fs * search_s)), ratio, largest)


def prefix_by_t60(h: Column, t60: Column, fs: int) -> Column:
    """Keep the first int(2*T60*fs) samples."""
    return A.cut(h, 0, F.floor(2.0 * t60 * fs).cast("int"))


# ---- energy ratios --------------------------------------------------------------------

def drr(h: Column, nd: Column, fs: int, half_ms: float = DP_HALF_MS, eps: float = 1e-8) -> Column:
    """Energy around the direct path against the rest, in dB."""
    half = int(fs * half_ms / 1000)

    def ratio(nd):
        lo = F.greatest(nd - half, F.lit(0))
        direct = A.energy(A.cut(h, lo, nd + half - lo + 1))
        rest = A.energy(A.cut(h, 0, lo)) + A.energy(A.cut(h, nd + half + 1, F.size(h)))
        return A.db(direct / (rest + eps) + eps)

    return A.let(nd, ratio)


def clarity(h: Column, nd: Column, fs: int, early_ms: float, eps: float = 1e-8) -> Column:
    """C50 / C80: everything up to the direct path plus early_ms against the rest."""
    return A.let(nd + int(fs * early_ms / 1000) + 1, lambda split: A.db(
        A.energy(A.cut(h, 0, split)) / (A.energy(A.cut(h, split, F.size(h))) + eps) + eps))


def energy_labels(df: DataFrame, fs: int, h_dp: str = "h_dp") -> DataFrame:
    """Direct-path index, DRR, C50 and C80 of every response; the index is found once per row."""
    h = F.col("h")
    labels = A.let(A.argmax(F.col(h_dp)), lambda nd: F.struct(
        nd.alias("nd"), drr(h, nd, fs).alias("drr"), clarity(h, nd, fs, 50).alias("c50"),
        clarity(h, nd, fs, 80).alias("c80")))
    return df.withColumn("_labels", labels).select("*", "_labels.*").drop("_labels")


# ---- decay curve and reverberation time -------------------------------------------------

def _curves(df: DataFrame, keys: list[str]) -> DataFrame:
    """Decay curve of every response as an array: the response stays in its row and nothing is shuffled."""
    tail = A.energy(A.cut(F.col("h"), A.argmax(F.col("h")), F.size("h")))
    squares = df.select(*keys, tail.alias("_tail"), A.pinned(F.transform("h", lambda v: v * v)).alias("_q"))
    sums = squares.select(*keys, "_tail", K.suffix_sums(F.col("_q")).alias("_s"))
    level = F.transform("_s", lambda s: A.db(s / (F.col("_tail") + 1e-10) + 1e-10))
    return sums.select(*keys, A.pinned(level).alias("edc"))


def edc(df: DataFrame, keys: list[str]) -> DataFrame:
    """Schroeder decay curve in dB, one row per sample."""
    return _curves(df, keys).select(*keys, F.posexplode("edc").alias("n", "edc"))


def t60(df: DataFrame, keys: list[str], fs: int) -> DataFrame:
    """T60 per record by regression over the 80 level pairs, inside the row.

    Suffix sums of y, n*y and y*y give any regression window as a difference of two samples, so the grid costs one
    search per distinct level instead of 80 passes.
    """
    at = _curves(df, keys).select(*keys, K.level_sums(tuple(LEVELS))(F.col("edc")).alias("_hits"))
    grid = F.expr("array(" + ", ".join(
        f"struct({LEVELS.index(a)} AS a, {LEVELS.index(b)} AS b)" for a, b in T60_GRID) + ")")

    def fit(hit, g, i):
        a, b = F.get(hit, g["a"]), F.get(hit, g["b"])
        m = (b["n"] - a["n"]).cast("double")
        my = (a["sy"] - b["sy"]) / m
        mx = (m - 1) / 2
        sxx = (m * m - 1) / 12
        sxy = ((a["sny"] - b["sny"]) - a["n"] * (a["sy"] - b["sy"])) / m - mx * my
        svv = (a["syy"] - b["syy"]) / m - my * my
        corr = sxy / F.sqrt(sxx * svv)
        return F.when((m > 1) & (svv > 0), F.struct(
            F.round(F.abs(corr), 9).alias("score"), (-i).alias("first"), corr.alias("corr"),
            (F.lit(-60.0) / (sxy / sxx * fs + 1e-10)).alias("t60")))

    hits = F.transform("_hits", lambda x: F.struct(*[F.get(x, F.lit(i)).alias(c) for i, c in enumerate(("n", "sy", "sny", "syy"))]))
    best = A.let(hits, lambda hit: F.array_max(F.transform(grid, lambda g, i: fit(hit, g, i))))
    return (at.select(*keys, best.alias("best"))
            .select(*keys, F.col("best.t60").alias("t60"), F.coalesce("best.corr", F.lit(0.0)).alias("corr")))


def decay_matches(fits: DataFrame, keys: list[str], spec: Column) -> DataFrame:
    """Accept a response when its channel-mean T60 and correlation agree with the wanted T60."""
    return (fits.groupBy(*keys).agg(F.avg("t60").alias("t60"), F.avg("corr").alias("corr"),
                                    F.max(spec).alias("t60_spec"))
            .withColumn("accepted", (F.abs(F.col("t60") - F.col("t60_spec")) < 0.05)
                        & (F.abs("corr") > 0.5)))


def exact_median(df: DataFrame, key: str, value: str, blocks: int = 64) -> DataFrame:
    """Median per key by rank over (value, count) rows, in blocks cut at the key's approximate quantiles.

    Equal values fold before they are ordered, so neither a hot key nor a third of all rows
    sharing one value meets in one task; the cuts only balance the blocks, ranks are exact.
    """
    folded = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    size = folded.groupBy(key).agg(F.sum("_c").alias("_size"), F.percentile_approx(
        value, [k / blocks for k in range(1, blocks)], 10_000).alias("_cuts"))
    placed = attach(folded, size, [key])
    block = F.size(F.filter("_cuts", lambda c: c < F.col(value))).cast("long")
    mid = scan(placed.withColumn("_block", block).drop("_cuts"), [key], [value], F.col("_block"), {"_n": Agg("sum", F.col("_c"))})
    covers = lambda rank: (F.col("_n") >= rank) & (F.col("_n") - F.col("_c") < rank)
    lower, upper = F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1
    return mid.groupBy(key).agg(((F.max(F.when(covers(lower), F.col(value))) + F.max(F.when(covers(upper), F.col(value)))) / 2).alias("median"))
