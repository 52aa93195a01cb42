"""Ordered series: speech gaps, interpolation, as-of lookup, segments, activity.

Times are integer microseconds. Every operator works in blocks of the timeline, so a
session or sensor that holds a third of all rows is still many tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from reverbtable.functions import arrays as A, kernels as K
from reverbtable.functions.scan import BLOCK_ROWS, Agg, asof, asof_both, attach, scan, with_row_blocks


def speech_gaps(utts: DataFrame, min_us: int, audio_us: Column, closed_end: bool = False,
                key: str = "session", tie: str = "utt_id") -> DataFrame:
    """Overlap-free stretches: from the latest end of all earlier sentences to the next start.

    Kept when at least ``min_us`` long and the next start lies inside the audio; the last
    sentence of a session gives none.
    """
    run = scan(with_row_blocks(utts, [key], "st"), [key], ["st", tie], F.col("_cut"), {
        "e0": Agg("max", F.col("en"), exclusive=True),
        "s1": Agg("last", F.col("st"), exclusive=True, reverse=True)})
    gap = run.withColumn("e0", F.greatest(F.coalesce("e0", F.lit(0)), F.lit(0)))
    inside = (F.col("s1") <= audio_us) if closed_end else (F.col("s1") < audio_us)
    return (gap.filter(F.col("s1").isNotNull() & (F.col("s1") - F.col("e0") >= min_us) & inside)
            .select(key, tie, F.col("e0").alias("st"), F.col("s1").alias("en"), (F.col("s1") - F.col("e0")).alias("len")))


def interpolate(probes: DataFrame, knots: DataFrame, keys: list[str], time: str = "t", value: str = "v",
                block_us: int | None = None) -> DataFrame:
    """Linear interpolation of ``value`` at probe times, clamped to the first and last knot; a probe whose key has no
    knot, or knots without a value, keeps its row with null."""
    both = asof_both(probes, knots, keys, time, [value], block_us, "_p", "_q")
    p, q, t = F.col("_p"), F.col("_q"), F.col(time)
    inner = p[value] + (q[value] - p[value]) * (t - p[time]) / (q[time] - p[time])
    out = F.when(p.isNull(), q[value]).when(q.isNull(), p[value]).otherwise(inner)
    return both.select(*probes.columns, out.alias(value))


def last_before(probes: DataFrame, states: DataFrame, keys: list[str], value: str, time: str = "t") -> DataFrame:
    """State strictly before each probe; null before the first one."""
    hit = asof(probes, states, keys, time, [value], strict=True, out="_p")
    return hit.select(*probes.columns, F.col("_p")[value].alias(value))


def relative_time(df: DataFrame, key: str, time: str = "t") -> DataFrame:
    """Time since the first row of a record, in seconds."""
    start = df.groupBy(key).agg(F.min(time).alias("_t0"))
    return attach(df, start, [key]).withColumn("t_rel", (F.col(time) - F.col("_t0")) / 1e6).drop("_t0")


def windows_of(n: Column, size: int, step: int) -> Column:
    """Ids of the windows [w*step, w*step+size) that hold sample n."""
    first = F.greatest(F.floor((n - size) / step) + 1, F.lit(0).cast("long"))
    return F.sequence(first, F.floor(n / step))


def segment_means(df: DataFrame, keys: list[str], n: str, values: list[str], size: int, step: int) -> DataFrame:
    """Mean of label columns per complete window, by partial aggregation on (key, window)."""
    rows = df.withColumn("w", F.explode(windows_of(F.col(n), size, step)))
    return (rows.groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("_c"), *[F.avg(v).alias(v) for v in values])
            .filter(F.col("_c") == size).drop("_c"))


def segment_azimuth(df: DataFrame, key: str, n: str, azi: str, size: int, step: int,
                    block: int = BLOCK_ROWS) -> DataFrame:
    """Mean azimuth per window. Where neighbours in the window jump by more than pi,
    negative angles get a full turn before averaging; the mean is wrapped back."""
    prev = scan(df.select(key, n, azi), [key], [n], F.floor(F.col(n) / block).cast("long"),
                {"_prev": Agg("last", F.col(azi), exclusive=True)})
    rows = prev.withColumn("w", F.explode(windows_of(F.col(n), size, step)))
    jump = F.when(F.col(n) > F.col("w") * step, F.abs(F.col(azi) - F.col("_prev")))
    agg = rows.groupBy(key, "w").agg(
        F.count(F.lit(1)).alias("_c"), F.sum(azi).alias("_s"), F.max(jump).alias("_j"),
        F.count_if(F.col(azi) < 0).alias("_neg"))
    mean = (F.col("_s") + F.when(F.col("_j") > math.pi, F.lit(2 * math.pi) * F.col("_neg")).otherwise(0.0)) / size
    return agg.filter(F.col("_c") == size).select(
        key, "w", F.when(mean > math.pi, mean - 2 * math.pi).otherwise(mean).alias(azi))


def frames(df: DataFrame, keys: list[str], x: str, size: int, step: int) -> DataFrame:
    """Complete overlapping frames of a sample array: keys, frame, x."""
    count = F.floor((F.size(x) - size) / step).cast("int")
    ids = F.when(count >= 0, F.sequence(F.lit(0), F.greatest(count, F.lit(0))))
    return (df.select(*keys, x, F.explode(ids).alias("frame"))
            .select(*keys, "frame", A.cut(F.col(x), F.col("frame") * step, size).alias(x)))


def block_activity(dp: Column, mix: Column, win: int, eps: float = 1e-8) -> Column:
    """Energy of the direct path over the mixture per tumbling block, as an array of blocks."""
    blocks = F.floor(F.size(mix) / win).cast("int")
    return F.when(blocks > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0))),
        lambda b: A.energy(A.cut(dp, b * win, win)) / (A.energy(A.cut(mix, b * win, win)) + eps)))


def to_samples(blocks: Column, win: int) -> Column:
    return F.flatten(F.transform(blocks, lambda v: F.array_repeat(v, win)))


def leading_silence(x: Column, fs: int, ratio: float = 0.15, max_s: float = 4.0) -> Column:
    """Seconds before the first sample above ``ratio`` of the maximum of the first seconds."""
    head = F.slice(x, 1, int(fs * max_s))
    first = A.let(head, lambda h: A.let(F.array_max(h) * ratio, lambda th: F.array_position(
        F.transform(h, lambda v: v > th), F.lit(True))))
    return F.greatest(first - 1, F.lit(0)) / F.lit(float(fs))


def moving_energy(clips: DataFrame, key: str, xs: str, length: int) -> DataFrame:
    """Causal boxcar energy, averaged over channels, on the full convolution length: key, n, len, e.

    Differences of prefix sums inside the record; nothing is shuffled.
    """
    e = clips.select(key, K.moving_energy(length)(F.col(xs)).alias("_e"))
    return e.select(key, F.size("_e").alias("len"), F.posexplode("_e").alias("n", "e")).select(key, "n", "len", "e")


def noise_span(clips: DataFrame, key: str, xs: str, fs: int, boundary_s: float = 3.0, filt_s: float = 0.4,
               silence_s: float = 1.5) -> DataFrame:
    """Sample range of a noise clip without its leading and trailing silence: th, st, en, usable are added to clips.

    Threshold from the means and extremes of a silent head and a noisy middle; start is the
    first crossing before the boundary, end the first drop after it. A clip without head or middle has no threshold.
    """
    span = K.noise_span(int(fs * filt_s), int(fs * boundary_s), int(fs * silence_s), fs * boundary_s)
    out = clips.withColumn("_s", span(F.col(xs))).select(*clips.columns, "_s.*")
    return out.withColumn("usable", (F.col("en") > F.col("st")) & ((F.col("en") - F.col("st")) / float(fs) > 3))


def noise_clip(clips: DataFrame, key: str, xs: str, fs: int, **settings: float) -> DataFrame:
    """The usable clips cut to their noise: other columns stay, xs holds samples [st, en) of every channel."""
    kept = noise_span(clips, key, xs, fs, **settings).where("usable")
    cut = F.transform(xs, lambda x: F.slice(x, (F.col("st") + 1).cast("int"), (F.col("en") - F.col("st")).cast("int")))
    return kept.withColumn(xs, cut).select(*clips.columns)
