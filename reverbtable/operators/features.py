"""Spectral features, channel pairs, patches and masks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reverbtable.functions import arrays as A, kernels as K
from reverbtable.functions.draws import digest, pick_index


# ---- spectra --------------------------------------------------------------------------

def with_spectrum(df: DataFrame, xs: str = "xs", win: int = 512, hop: int = 256) -> DataFrame:
    """Replace the samples by ``re``/``im`` [channel][frame][bin] and the normalising level."""
    rest = [c for c in df.columns if c != xs]
    fixed = df.select(*rest, A.pinned(F.col(xs)).alias("_x"))
    return fixed.select(*rest, K.stft(win, hop)(F.col("_x")).alias("_s")).select(*rest, "_s.re", "_s.im", "_s.level")


def spectra(df: DataFrame, keys: list[str], normalise: bool = False, eps: float = 1e-6,
            first_bin: int = 0, n_bins: int | None = None) -> DataFrame:
    """Spectrum rows keys, ch, frame, re[], im[]; optionally divided by the mean magnitude
    of channel 0 and cut to a bin range. The level sits in the row, so nothing is joined."""
    level = F.col("level") + eps if normalise else F.lit(1.0)
    by_ch = df.select(*keys, level.alias("_lv"), F.posexplode(F.arrays_zip("re", "im")).alias("ch", "_c"))
    by_frame = by_ch.select(*keys, "ch", "_lv", F.col("_c.re").alias("re"), F.col("_c.im").alias("im"))
    by_frame = by_frame.select(*keys, "ch", "_lv", F.posexplode(F.arrays_zip("re", "im")).alias("frame", "_f"))

    def used(x):
        x = x if n_bins is None else A.cut(x, first_bin, n_bins)
        return F.transform(x, lambda v: v / F.col("_lv")) if normalise else x

    return by_frame.select(*keys, "ch", "frame", used(F.col("_f.re")).alias("re"), used(F.col("_f.im")).alias("im"))


def bins(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per bin: keys, bin, re, im."""
    return (rows.select(*keys, F.posexplode(F.arrays_zip("re", "im")).alias("bin", "_b"))
            .select(*keys, "bin", "_b.re", "_b.im"))


def used_bins(nfft: int, ratio: float = 1.0) -> tuple[int, int]:
    """(first bin, count): without DC for the full range, the lower half otherwise."""
    if ratio == 1.0:
        return 1, nfft // 2
    if ratio == 0.5:
        return 0, nfft // 4
    raise ValueError("ratio must be 1 or 0.5")


def cmul(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """Complex product."""
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def cmul_conj(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """a times the conjugate of b."""
    return cmul(a, (b[0], -b[1]))


def mel_filters(n_mels: int, fs: int, n_bins: int) -> np.ndarray:
    """Triangular filters, equally spaced on mel = 2595*log10(1 + f/700), 0 .. fs/2."""
    freq = np.linspace(0, fs // 2, n_bins)
    top = 2595 * math.log10(1 + fs / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, n_mels + 2) / 2595) - 1)
    width = np.diff(edges)
    rise = (freq[:, None] - edges[None, :-2]) / width[:-1]
    fall = (edges[None, 2:] - freq[:, None]) / width[1:]
    return np.maximum(0, np.minimum(rise, fall)).T


def mel_project(x: Column, n_mels: int, fs: int, n_bins: int) -> Column:
    """Bands of a bin array; each filter only touches its own span of bins."""
    spans = []
    for w in mel_filters(n_mels, fs, n_bins):
        hit = np.flatnonzero(w)
        lo, hi = (hit[0], hit[-1] + 1) if len(hit) else (0, 0)
        spans.append(f"struct({lo + 1} AS lo, array({', '.join(f'{v!r}D' for v in map(float, w[lo:hi]))}) AS w)"
                     if len(hit) else "struct(1 AS lo, CAST(array() AS array<double>) AS w)")
    bands = F.expr(f"array({', '.join(spans)})")
    return F.transform(bands, lambda b: F.aggregate(
        F.zip_with(F.slice(x, b["lo"], F.size(b["w"])), b["w"], lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v))


# ---- channel pairs ------------------------------------------------------------------------

def pair_channels(df: DataFrame, keys: list[str], mode: str = "M") -> DataFrame:
    """Record rows to pair rows (pair, c0, c1, re, im of both channels).

    'M' pairs channel 0 with every other one, 'MM' pairs all, '1' passes the record through.
    Pairs come from the channel count of the row; no channel row is joined to another.
    """
    if mode == "1":
        return df
    last = F.size("re") - 1
    if mode == "M":
        pairs = F.transform(F.sequence(F.lit(1), last), lambda c: F.struct(F.lit(0).alias("c0"), c.alias("c1")))
    elif mode == "MM":
        pairs = F.flatten(F.transform(F.sequence(F.lit(0), last - 1), lambda a: F.transform(
            F.sequence(a + 1, last), lambda b: F.struct(a.alias("c0"), b.alias("c1")))))
    else:
        raise ValueError("mode must be M, MM or 1")
    rest = [c for c in df.columns if c not in ("re", "im", *keys)]
    return (df.select(*keys, *rest, "re", "im", F.posexplode(pairs).alias("pair", "_p"))
            .select(*keys, *rest, "pair", "_p.c0", "_p.c1",
                    *[F.array(F.get(x, F.col("_p.c0")), F.get(x, F.col("_p.c1"))).alias(x) for x in ("re", "im")]))


def unpair(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pair rows back to one row per record, pairs in order."""
    packed = F.array_sort(F.collect_list(F.struct("pair", value)))
    return rows.groupBy(*keys).agg(F.transform(packed, lambda p: p[value]).alias(value))


def cross_spectrum(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per (key, bin): mean product of channel 0 with the conjugate of channel 1 and both powers.

    Frames of a record sit in one row, so partial aggregation folds them before the shuffle.
    """
    both = pairs.select(*keys, *[F.get(x, F.lit(c)).alias(f"{x}{c}") for x in ("re", "im") for c in (0, 1)])
    fr = both.select(*keys, F.explode(F.arrays_zip("re0", "im0", "re1", "im1")).alias("_f"))
    fr = fr.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in ("re0", "im0", "re1", "im1")])
    b = (fr.select(*keys, F.posexplode(F.arrays_zip("re0", "im0", "re1", "im1")).alias("bin", "_b"))
         .select(*keys, "bin", "_b.*"))
    re, im = cmul_conj((F.col("re0"), F.col("im0")), (F.col("re1"), F.col("im1")))
    pw = lambda c: F.avg(F.col(f"re{c}") * F.col(f"re{c}") + F.col(f"im{c}") * F.col(f"im{c}"))
    return b.groupBy(*keys, "bin").agg(F.avg(re).alias("re"), F.avg(im).alias("im"), pw(0).alias("p0"), pw(1).alias("p1"))


def coherence(cross: DataFrame) -> DataFrame:
    """Real part of the normalised cross spectrum; null in a silent bin."""
    return cross.withColumn("coherence", F.try_divide(F.col("re"), F.sqrt(F.col("p0") * F.col("p1"))))


# ---- patches ------------------------------------------------------------------------------

def patch_split(cells: DataFrame, nf: int, nt: int, pf: int, pt: int, f_first: bool = False) -> DataFrame:
    """(bin, frame) to (patch, pos); incomplete border patches are left out."""
    f, t = F.col("bin"), F.col("frame")
    n_f, n_t = nf // pf, nt // pt
    fb, tb = F.floor(f / pf), F.floor(t / pt)
    patch = tb * n_f + fb if f_first else fb * n_t + tb
    pos = (t % pt) * pf + f % pf if f_first else (f % pf) * pt + t % pt
    return (cells.filter((f < n_f * pf) & (t < n_t * pt))
            .withColumns({"patch": patch.cast("int"), "pos": pos.cast("int")}).drop("bin", "frame"))


def patch_recover(cells: DataFrame, nf: int, nt: int, pf: int, pt: int, f_first: bool = False) -> DataFrame:
    """(patch, pos) back to (bin, frame)."""
    n_f, n_t = nf // pf, nt // pt
    p, q = F.col("patch"), F.col("pos")
    if f_first:
        f, t = (p % n_f) * pf + q % pf, F.floor(p / n_f) * pt + F.floor(q / pf)
    else:
        f, t = F.floor(p / n_t) * pf + F.floor(q / pt), (p % n_t) * pt + q % pt
    return cells.withColumns({"bin": f.cast("int"), "frame": t.cast("int")}).drop("patch", "pos")


# ---- masks --------------------------------------------------------------------------------

def _shuffled(ids: Column, seed: str, key: str) -> Column:
    ranked = F.array_sort(F.transform(ids, lambda p: F.struct(digest(seed, F.col(key), p).alias("h"), p.alias("p"))))
    return F.transform(ranked, lambda s: s["p"])


def masked_patches(key: str, mode: str, n_masked: int, shape: tuple[int, int], seed: str = "mask",
                   cluster: int = 5) -> Column:
    """Sorted ids of the masked patches of a record; a pure function of its key.

    Drawing cluster starts with replacement and ignoring repeats equals walking a shuffled
    list of all starts, so the walk always ends and needs no retry limit.
    """
    total = shape[0] * shape[1]
    ids = F.sequence(F.lit(0), F.lit(total - 1))
    none = F.expr("CAST(array() AS array<int>)")

    def grown(span):
        walk = F.aggregate(_shuffled(ids, seed, key), none, lambda acc, s: F.when(F.size(acc) > n_masked, acc).otherwise(
            F.array_union(acc, F.filter(span(s), lambda p: p < total))))
        return F.slice(F.array_sort(walk), 1, n_masked)

    run = lambda s: F.sequence(s, s + cluster - 1)
    if mode == "T":
        return F.array_sort(F.slice(_shuffled(ids, seed, key), 1, n_masked))
    if mode == "T_cluster":
        return grown(run)
    if mode == "T_cluster_inverse":
        return F.array_except(ids, grown(run))
    if mode == "TF":
        square = F.expr("array(" + ", ".join(str(shape[1] * i + j) for i in range(3) for j in range(3)) + ")")
        return grown(lambda s: F.transform(square, lambda o: s + o))
    if mode == "T_cluster2":
        starts = _shuffled(F.sequence(F.lit(0), F.lit(total - 1), F.lit(5)), seed, key)
        taken = F.slice(starts, 1, math.ceil(n_masked / 5) + 1)
        flat = F.flatten(F.transform(taken, lambda s: F.sequence(s, s + 4)))
        return F.slice(F.array_sort(F.filter(flat, lambda p: p < total)), 1, n_masked)
    if mode == "T_1s":
        return F.sequence(F.lit(192), F.lit(255))
    raise ValueError("unknown mask mode")


def masked_channel(key: str, channels: int, seed: str = "mask:ch") -> Column:
    return pick_index(F.lit(channels), seed, key).cast("int")


def visible_patches(masked: Column, total: int) -> Column:
    """All patches that are not masked."""
    return F.array_except(F.sequence(F.lit(0), F.lit(total - 1)), masked)


def masked_views(rows: DataFrame, value: str, masked: Column, ch_masked: Column) -> DataFrame:
    """Model inputs of one-channel masking: the masked signal, the spectral view, the spatial
    view and the target, as columns next to ``value``."""
    hid, own, v = F.array_contains(masked, F.col("patch")), F.col("ch") == ch_masked, F.col(value)
    return rows.withColumns({"hidden": hid & own}).withColumns({
        "masked": F.when(F.col("hidden"), 0.0).otherwise(v),
        "spectral": F.when(hid != own, v).otherwise(0.0),
        "spatial": F.when(hid, 0.0).otherwise(v),
        "target": F.when(own, v).otherwise(0.0)})


def masked_mse(rows: DataFrame, by: list[str], channels: int, pred: str = "pred", gt: str = "gt",
               hidden: str = "hidden") -> DataFrame:
    """Error on hidden cells (null where none is hidden), the same per channel-summed cell, and over everything."""
    d = (F.col(pred) - F.col(gt)) * (F.col(pred) - F.col(gt))
    hit = F.sum(F.when(F.col(hidden), d).otherwise(0.0))
    return rows.groupBy(*by).agg(
        F.try_divide(hit, F.sum(F.col(hidden).cast("int"))).alias("mse_masked"),
        (hit * channels / F.count(F.lit(1))).alias("mse_masked_channel"), F.avg(d).alias("mse"))


def detect_masked_channel(rows: DataFrame, key: str, hidden: str = "hidden") -> DataFrame:
    """Channel with the fewest visible cells; the later one on ties."""
    per = rows.groupBy(key, "ch").agg(F.sum((~F.col(hidden)).cast("long")).alias("_v"))
    return per.groupBy(key).agg(F.min(F.struct("_v", (-F.col("ch")).alias("_c")))["_c"].alias("_m")).select(
        key, (-F.col("_m")).alias("ch"))
