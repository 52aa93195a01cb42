"""Microphone pairs, array layouts, poses and direction labels."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from reverbtable.functions import acoustics as ac
from reverbtable.functions.scan import attach


def mic_pairs(mics: DataFrame, lo: float, hi: float, ordered: bool = False,
              array: str = "array_id", mic: str = "mic_id") -> DataFrame:
    """Pairs of one array with distance in [lo, hi]: array, m1, m2, d.

    Space is cut into cells. Only occupied cells are paired (27-neighbourhood of a coarse
    grid, halved by symmetry), cell pairs that cannot hold a distance in range are dropped,
    and microphones are then joined on their cell. Work follows the result, not the square
    of the array: a crowd of microphones closer than ``lo`` is never paired.
    """
    fine = max(lo * 0.999 / math.sqrt(3.0), hi / 12.0)
    per = math.ceil(hi / fine)
    axes = ("x", "y", "z")
    at = mics.select(array, mic, *axes, *[F.floor(F.col(c) / fine).cast("long").alias(f"i{c}") for c in axes])
    cells = at.select(array, "ix", "iy", "iz").distinct().select(
        "*", *[F.floor(F.col(f"i{c}") / per).cast("long").alias(f"c{c}") for c in axes])

    half = [o for o in itertools.product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]
    offsets = F.expr("array(" + ", ".join(f"struct({a} AS dx, {b} AS dy, {c} AS dz)" for a, b, c in half) + ")")
    left = cells.select(F.col(array), *[F.col(f"i{c}").alias(f"a{c}") for c in axes],
                        "cx", "cy", "cz", F.explode(offsets).alias("o"))
    left = left.select(array, "ax", "ay", "az", (F.col("cx") + F.col("o.dx")).alias("cx"),
                       (F.col("cy") + F.col("o.dy")).alias("cy"), (F.col("cz") + F.col("o.dz")).alias("cz"),
                       ((F.col("o.dx") == 0) & (F.col("o.dy") == 0) & (F.col("o.dz") == 0)).alias("home"))
    right = cells.select(F.col(array), *[F.col(f"i{c}").alias(f"b{c}") for c in axes], "cx", "cy", "cz")
    gap = lambda c, k: (F.abs(F.col(f"a{c}") - F.col(f"b{c}")) + k) * fine
    near = sum((F.greatest(gap(c, -1), F.lit(0.0)) * F.greatest(gap(c, -1), F.lit(0.0)) for c in axes), F.lit(0.0))
    far = sum((gap(c, 1) * gap(c, 1) for c in axes), F.lit(0.0))
    first = F.struct("ax", "ay", "az") <= F.struct("bx", "by", "bz")
    cell_pairs = (left.join(right, [array, "cx", "cy", "cz"])
                  .filter((~F.col("home") | first) & (near <= hi * hi * (1 + 1e-9)) & (far >= lo * lo))
                  .select(array, "ax", "ay", "az", "bx", "by", "bz"))

    side = lambda p, m: at.select(F.col(array), F.col(mic).alias(m), *[F.col(c).alias(f"{p}_{c}") for c in axes],
                                  *[F.col(f"i{c}").alias(f"{p}{c}") for c in axes])
    same = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")) & (F.col("az") == F.col("bz"))
    d = ac.dist(tuple(F.col(f"a_{c}") for c in axes), tuple(F.col(f"b_{c}") for c in axes))
    found = (cell_pairs.join(side("a", "p"), [array, "ax", "ay", "az"])
             .join(side("b", "q"), [array, "bx", "by", "bz"])
             .filter((~same | (F.col("p") < F.col("q"))) & d.between(lo, hi))
             .select(array, F.least("p", "q").alias("m1"), F.greatest("p", "q").alias("m2"), d.alias("d")))
    return both_directions(found, array) if ordered else found


def both_directions(pairs: DataFrame, *keep: str) -> DataFrame:
    turn = F.array(F.struct(F.col("m1"), F.col("m2")),
                   F.struct(F.col("m2").alias("m1"), F.col("m1").alias("m2")))
    return pairs.select(*keep, F.explode(turn).alias("_p"), "d").select(*keep, "_p.m1", "_p.m2", "d")


def channel_pairs(records: DataFrame, nch: Column, ordered: bool = True) -> DataFrame:
    """Channel pairs of each record by its channel count: generated per row, no join."""
    idx = F.sequence(F.lit(0), nch.cast("int") - 1)
    out = records.withColumn("m1", F.explode(idx)).withColumn("m2", F.explode(idx))
    return out.filter(F.col("m1") != F.col("m2") if ordered else F.col("m1") < F.col("m2"))


def pair_count(mics: DataFrame, lo: float, hi: float, array: str = "array_id") -> DataFrame:
    """Number of unordered pairs in range per array, zero included."""
    counts = mic_pairs(mics, lo, hi, array=array).groupBy(array).agg(F.count(F.lit(1)).alias("c"))
    return (mics.select(array).distinct().join(counts, array, "left")
            .select(array, F.coalesce("c", F.lit(0).cast("long")).alias("n_pairs")))


def arrays_without_pairs(mics: DataFrame, pairs: DataFrame, array: str = "array_id") -> DataFrame:
    return mics.select(array).distinct().join(pairs.select(array).distinct(), array, "left_anti")


def tdoa(mics: DataFrame, sources: DataFrame, array: str = "array_id", c: float = ac.SOUND_SPEED) -> DataFrame:
    """Arrival-time difference of every microphone against microphone 0 of its array."""
    ref = mics.filter("mic = 0").select(array, *[F.col(a).alias(f"r{a}") for a in "xyz"])
    src = sources.select(array, "src_id", *[F.col(a).alias(f"s{a}") for a in "xyz"])
    p = lambda k: tuple(F.col(f"{k}{a}") for a in "xyz")
    diff = (ac.dist(p("s"), ac.xyz()) - ac.dist(p("s"), p("r"))) / F.lit(c)
    return attach(src, mics.join(ref, array), [array]).select(array, "src_id", "mic", diff.alias("tdoa"))


def doa(array_centres: DataFrame, sources: DataFrame, array: str = "array_id") -> DataFrame:
    """[elevation, azimuth] and distance of a source seen from the array centre."""
    src = sources.select(array, "src_id", *[F.col(a).alias(f"s{a}") for a in "xyz"])
    sph = ac.cart2sph(*[F.col(f"s{a}") - F.col(a) for a in "xyz"])
    return attach(src, array_centres, [array]).select(array, "src_id", *[v.alias(k) for k, v in sph.items()])


def circular_array(df: DataFrame, nmic: Column, radius: Column, centre: bool = False) -> DataFrame:
    """Microphones on a circle (counter-clockwise from +x), optionally one more in the centre."""
    n = nmic.cast("int")
    out = df.withColumn("mic", F.explode(F.sequence(F.lit(0), n if centre else n - 1)))
    ang = F.lit(2 * math.pi) * F.col("mic") / n
    ring = F.when(F.col("mic") < n, radius).otherwise(0.0)
    return out.withColumns({"x": ring * F.cos(ang), "y": ring * F.sin(ang), "z": F.lit(0.0)})


def linear_array(spacing: DataFrame, array: str = "array_id") -> DataFrame:
    """Positions as running sums of the gaps between neighbours, centred on zero.

    One array holds a handful of microphones by construction.
    """
    w = W.partitionBy(array)
    run = spacing.withColumn("_p", F.sum("gap").over(w.orderBy("mic")))
    return run.select(array, "mic", (F.col("_p") - (F.max("_p").over(w) + F.min("_p").over(w)) / 2).alias("x"))


def posed_mics(mics: DataFrame, pose: DataFrame, static: Column, key: str = "rec_id") -> DataFrame:
    """Absolute microphone positions per pose frame; static records keep frame 0 only."""
    frames = pose.filter(~static | (F.col("frame") == 0))
    turned = ac.rotate(F.col("rot"), *ac.xyz())
    return attach(frames, mics, [key]).select(
        key, "frame", "mic", *[(turned[a] + F.col(f"p{a}")).alias(a) for a in "xyz"])


def maybe_swap(df: DataFrame, flag: Column) -> DataFrame:
    """Exchange the two channels and negate the TDOA where ``flag`` holds."""
    return df.select(*[c for c in df.columns if c not in ("m1", "m2", "tdoa")],
                     F.when(flag, F.col("m2")).otherwise(F.col("m1")).alias("m1"),
                     F.when(flag, F.col("m1")).otherwise(F.col("m2")).alias("m2"),
                     F.when(flag, -F.col("tdoa")).otherwise(F.col("tdoa")).alias("tdoa"))
