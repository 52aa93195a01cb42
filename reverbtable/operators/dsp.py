"""Signals of whole records: ``xs ARRAY<ARRAY<DOUBLE>>`` is [channel][sample].

A record stays in one row, so levels, mixing and scaling need no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reverbtable.functions import arrays as A, kernels as K
from reverbtable.functions.acoustics import diffuse_coherence
from reverbtable.functions.draws import normal, pick_index, uniform
from reverbtable.functions.scan import Agg, scan
from reverbtable.operators.sampling import shuffled_index


def to_records(df: DataFrame, key: str, ch: str = "ch", x: str = "x") -> DataFrame:
    """Channel rows to record rows; a record has as many rows as its device has channels."""
    packed = F.array_sort(F.collect_list(F.struct(ch, x)))
    return df.groupBy(key).agg(F.transform(packed, lambda p: p[x]).alias("xs"))


def per_channel(xs: Column, fn) -> Column:
    return F.transform(xs, fn)


def mean_power(xs: Column) -> Column:
    """Mean over channels of the mean square."""
    return A.mean(F.transform(xs, A.power))


def peak(xs: Column) -> Column:
    return F.array_max(F.transform(xs, A.peak))


def peak_normalise(xs: Column, dp: Column | None = None, gain: float = 0.9, eps: float = 0.0) -> Column:
    """Scale by the common peak of the signal and (if given) its direct-path version; a silent clip stays as it is."""
    return peak_scaled([xs] if dp is None else [xs, dp], gain, eps)[0]


def peak_scaled(signals: list[Column], gain: float = 0.9, eps: float = 0.0) -> list[Column]:
    """A signal, its direct path and its sources by one common factor: gain over the largest of the peaks of the first
    two. All silent: unchanged."""
    def scaled(*xs):
        top = F.greatest(*[peak(x) for x in xs[:2]]) if len(xs) > 1 else peak(xs[0])
        factor = F.coalesce(F.try_divide(F.lit(gain), top + eps), F.lit(1.0))
        return A.let(factor, lambda g: F.struct(*[
            F.transform(x, lambda c: A.scaled(c, g)).alias(f"s{k}") for k, x in enumerate(xs)]))

    both = A.let_all(signals, scaled)
    return [both.getField(f"s{k}") for k in range(len(signals))]


def snr_gain(xs: Column, noise: Column, snr: Column, dp: Column | None = None, eps: float = 1e-10) -> Column:
    """Noise gain for a wanted SNR; the reference power is the direct path where it exists."""
    ref = mean_power(xs) if dp is None else mean_power(F.coalesce(dp, xs))
    return F.sqrt(ref / F.pow(F.lit(10.0), snr / 10.0)) / (F.sqrt(mean_power(noise)) + eps)


def snr_mix(xs: Column, noise: Column, snr: Column, dp: Column | None = None) -> Column:
    """Signal plus noise at the wanted SNR; one gain for all channels. Shorter noise ends in zeros, longer is cut."""
    def mix(xs, noise, dp=None):
        return A.let(snr_gain(xs, noise, snr, dp), lambda g: F.zip_with(
            xs, noise, lambda x, v: F.zip_with(x, F.slice(v, F.lit(1), F.size(x)), lambda a, b: a + g * F.coalesce(b, F.lit(0.0)))))

    return A.let_all([xs, noise] if dp is None else [xs, noise, dp], mix)


def mean_free(x: Column) -> Column:
    return A.let(A.mean(x), lambda m: F.transform(x, lambda v: v - m))


def pad_crop(x: Column, want: int, u: Column) -> Column:
    """Repeat by doubling until long enough, then cut at a uniform start (ends included)."""
    def padded(x):
        copies = F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.lit(float(want)) / F.size(x))), F.lit(0))).cast("int")
        n = F.size(x) * copies
        long = F.flatten(F.array_repeat(x, copies))
        return A.cut(long, F.floor(u * (n - want + 1)).cast("int"), want)
    return F.when(F.size(x) > 0, A.let(x, padded))


def active_power(x: Column, win: int = 512, hop: int = 256, share: float = 0.01) -> Column:
    """Mean power of the windows above a share of the loudest window."""
    last = F.floor((F.size(x) - win) / hop).cast("int")
    powers = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda f: A.energy(A.cut(x, f * hop, win)) / win)
    return F.when(last >= 0, A.let(powers, lambda p: A.let(F.array_max(p) * share, lambda th: A.mean(
        F.filter(p, lambda v: v > th)))))


def select_range(x: Column, st: int, ed: int) -> Column:
    """Samples [st, ed); an error if the record is shorter."""
    return F.when(F.size(x) >= ed, A.cut(x, st, ed - st)).otherwise(
        F.raise_error(F.lit(f"range [{st}, {ed}) exceeds the record")).cast("array<double>"))


def select_range_all(df: DataFrame, aligned: list[str], st: int, ed: int) -> DataFrame:
    """The same range on every sample-aligned array of a record."""
    return df.withColumns({c: select_range(F.col(c), st, ed) for c in aligned})


def convolve(x: Column, hs: Column) -> Column:
    """One source through the responses of all channels."""
    return K.convolve_channels()(x, hs)


def add_sources(xss: Column) -> Column:
    """Sum over sources: [source][channel][sample] -> [channel][sample]."""
    return F.aggregate(F.slice(xss, 2, F.greatest(F.size(xss) - 1, F.lit(0))), F.get(xss, F.lit(0)),
                       lambda acc, xs: F.zip_with(acc, xs, lambda a, b: F.zip_with(a, b, lambda p, q: p + q)))


def convolve_table(src: DataFrame, taps: DataFrame, key: str) -> DataFrame:
    """Convolution as a join: src(key, n, x) with taps(key, ch, k, h), cut to source length.

    For short responses and for checking the kernel; the work is samples times taps.
    """
    size = src.groupBy(key).agg((F.max("n") + 1).alias("_len"))
    prod = src.join(taps, key).join(size, key).filter(F.col("n") + F.col("k") < F.col("_len"))
    return prod.groupBy(key, "ch", (F.col("n") + F.col("k")).alias("n")).agg(F.sum(F.col("x") * F.col("h")).alias("y"))


# ---- chunked long sessions --------------------------------------------------------------

def chunked_text_pcm(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Whole text as a chunked sample table, still encoded: key, chunk_no, t0, n, raw.

    One code point is one sample; one regular-expression pass cuts the text, and only the
    pieces leave the row.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit("(?s).{1,%d}" % size), F.lit(0))
    return (df.select(key, F.posexplode_outer(pieces).alias("chunk_no", "raw"))
            .filter(F.col("raw").isNotNull())
            .select(key, "chunk_no", (F.col("chunk_no") * size).alias("t0"), F.length("raw").alias("n"), "raw"))


def decode_pcm(raw: Column) -> Column:
    """Samples of an encoded piece."""
    # the empty string that split leaves at the end is not a sample
    return F.transform(F.filter(F.split(raw, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("double"))


def ranged_read(chunks: DataFrame, ranges: DataFrame, key: str, size: int) -> DataFrame:
    """Samples of [st, ed) per record, as pieces with absolute ``t0``.

    The chunk numbers of a range are part of the join key, so untouched chunks never match,
    and pieces are decoded only after they are cut.
    """
    wanted = ranges.select(key, "st", "ed", F.explode(F.sequence(
        F.floor(F.col("st") / size).cast("int"), F.floor((F.col("ed") - 1) / size).cast("int"))).alias("chunk_no"))
    lo = F.greatest(F.col("st") - F.col("t0"), F.lit(0))
    hi = F.least(F.col("ed") - F.col("t0"), F.col("n"))
    return (chunks.join(wanted, [key, "chunk_no"])
            .select(key, "chunk_no", (F.col("t0") + lo).alias("t0"),
                    decode_pcm(F.col("raw").substr((lo + 1).cast("int"), (hi - lo).cast("int"))).alias("samples")))


def ranged_read_in_row(df: DataFrame, key: str, text: str, st: Column, ed: Column, size: int) -> DataFrame:
    """``ranged_read`` where a record's range stands in its own row: only the chunks it touches are cut, nothing is
    joined."""
    parts = df.select(key, text, st.alias("_st"), ed.alias("_ed")).where("_ed > _st").select("*", F.explode(F.sequence(
        F.floor(F.col("_st") / size).cast("int"), F.floor((F.col("_ed") - 1) / size).cast("int"))).alias("chunk_no"))
    lo = F.greatest(F.col("_st"), F.col("chunk_no").cast("long") * size)
    hi = F.least(F.col("_ed"), (F.col("chunk_no").cast("long") + 1) * size)
    return parts.select(key, "chunk_no", lo.alias("t0"), decode_pcm(
        F.col(text).substr((lo + 1).cast("int"), (hi - lo).cast("int"))).alias("samples"))


def chunk_lengths(df: DataFrame, text: str, size: int) -> DataFrame:
    """The chunks of encoded clips by arithmetic, without their samples: other columns of df, chunk_no, t0, n."""
    rest = [c for c in df.columns if c != text]
    sized = df.select(*rest, F.length(text).alias("_len")).where("_len > 0")
    rows = sized.select(*rest, "_len", F.explode(F.sequence(F.lit(0), F.floor((F.col("_len") - 1) / size).cast("int"))).alias("chunk_no"))
    return rows.select(*rest, "chunk_no", (F.col("chunk_no") * size).alias("t0"), F.least(
        F.lit(size), F.col("_len") - F.col("chunk_no") * size).alias("n"))


def concat_in_time(chunks: DataFrame, key: str, order: list[str], block: Column) -> DataFrame:
    """Clips of one device joined along time: every clip keeps its row and gets its offset."""
    return scan(chunks.drop("t0"), [key], order, block, {"t0": Agg("sum", F.col("n").cast("long"), exclusive=True)})


# ---- noise -------------------------------------------------------------------------------

def response_noise(matched: DataFrame, xs: str, noise_fs: str, rates: list[int], fs: int, seconds: float, channels: int,
                   seed: str, key: str) -> DataFrame:
    """Noise of a response as samples: a drawn crop of ``seconds`` of its matched clip, brought to ``fs``.

    matched has one row per response with the clip xs [channel][sample] at noise_fs, one of ``rates``, or null where
    no clip matched: such a response gets zeros. A clip that is shorter than asked for is an error. Added: noise.
    """
    have, want = F.size(F.get(xs, F.lit(0))), F.floor(F.col(noise_fs) * F.lit(seconds) + 1e-9).cast("int")
    at = F.floor(uniform(seed, key) * (have - want + 1)).cast("int")
    crop = F.when(F.col(xs).isNull(), F.lit(None).cast("array<array<double>>")).when(have < want, F.raise_error(
        F.lit("a noise clip is shorter than asked for")).cast("array<array<double>>")).otherwise(
        F.transform(xs, lambda x: F.slice(x, at + 1, want)))
    cut = matched.withColumn("_crop", A.pinned(crop))
    made = F.lit(None).cast("array<array<double>>")
    for rate in rates:
        channel = [K.resample(rate, fs)(F.when(F.col(noise_fs) == rate, F.get("_crop", F.lit(c)))) for c in range(channels)]
        cut = cut.withColumn(f"_at{rate}", F.array(*channel))
        made = F.when(F.col(noise_fs) == rate, F.col(f"_at{rate}")).otherwise(made)
    silent = zero_noise(F.lit(int(fs * seconds + 1e-9)), channels)
    return cut.withColumn("noise", F.when(F.col(xs).isNull(), silent).otherwise(made)).select(*matched.columns, "noise")


def white_noise(n: Column, channels: int, seed: str, key: str) -> Column:
    """Independent standard normal samples per channel, a pure function of (seed, key, ch, n)."""
    idx = F.sequence(F.lit(0), n.cast("int") - 1)
    return F.array(*[F.transform(idx, _gauss(seed, key, ch)) for ch in range(channels)])


def _gauss(seed: str, key: str, ch: int):
    return lambda i: normal(f"{seed}:{ch}", F.col(key), i)


def zero_noise(n: Column, channels: int) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(0.0), n.cast("int")), channels)


def split_parts(x: Column, parts: int, length: int) -> Column:
    """One clip cut into independent channels."""
    return F.array(*[A.cut(x, m * length, length) for m in range(parts)])


def mix_to_coherence(re: Column, im: Column, gamma: Column) -> Column:
    """Two independent spectra [channel][frame][bin] mixed so that they have coherence gamma.

    The Cholesky factor of [[1, g], [g, 1]] is [[1, g], [0, sqrt(1 - g^2)]]; the DC bin is zeroed. Another number
    of channels is an error, as one coherence says nothing about a third.
    """
    re = F.when(F.size(re) == 2, re).otherwise(F.raise_error(F.lit("coherence is given for two channels")))
    def mixed(part, gm):
        keep = F.transform(F.get(part, F.lit(0)), lambda fr: F.zip_with(fr, gm, lambda v, g: F.when(g["on"], v).otherwise(0.0)))
        other = F.zip_with(F.get(part, F.lit(0)), F.get(part, F.lit(1)), lambda p, q: F.zip_with(
            F.arrays_zip(p.alias("p"), q.alias("q")), gm, lambda v, g: F.when(
                g["on"], g["g"] * v["p"] + F.sqrt(1.0 - g["g"] * g["g"]) * v["q"]).otherwise(0.0)))
        return F.array(keep, other)

    return A.let(gamma, lambda gm: F.struct(mixed(re, gm).alias("re"), mixed(im, gm).alias("im")))


def diffuse_noise(df: DataFrame, xs: str, d: Column, fs: int, nfft: int = 256, eps: float = 1e-10) -> DataFrame:
    """Two independent noise channels to diffuse noise at distance ``d``, scaled by its maximum."""
    hop = nfft // 4
    rest = [c for c in df.columns if c != xs]
    gamma = F.transform(F.sequence(F.lit(0), F.lit(nfft // 2)),
                        lambda k: F.struct(diffuse_coherence(k * (fs / nfft), F.col("_d")).alias("g"), (k > 0).alias("on")))

    def scaled(y):
        top = F.array_max(F.transform(y, lambda x: F.array_max(x)))
        return A.let(F.lit(1.0) / (top + eps), lambda g: F.transform(y, lambda x: A.scaled(x, g)))

    spec = df.select(*rest, d.alias("_d"), A.pinned(F.col(xs)).alias("_x")).select(
        *rest, "_d", K.stft(nfft, hop)(F.col("_x")).alias("_s"))
    mix = spec.select(*rest, A.pinned(mix_to_coherence(F.col("_s.re"), F.col("_s.im"), gamma)).alias("_m"))
    flat = mix.select(*rest, F.col("_m.re").alias("_re"), F.col("_m.im").alias("_im"))
    back = flat.select(*rest, K.istft(nfft, hop)(F.col("_re"), F.col("_im")).alias("_y"))
    return back.select(*rest, A.let(F.col("_y"), scaled).alias(xs))


def babble(records: DataFrame, key: str, utts: DataFrame, utt: str, want: int, mics: int = 2,
           voices: int = 10, seed: str = "babble") -> DataFrame:
    """Per record and microphone the sum of ``voices`` random, cropped, mean-free utterances.

    Utterances are fetched by drawn row number; a group holds exactly ``voices`` rows.
    """
    n = utts.select(F.count(F.lit(1))).scalar()
    draws = (records.select(key).withColumn("ch", F.explode(F.sequence(F.lit(0), F.lit(mics - 1))))
             .withColumn("voice", F.explode(F.sequence(F.lit(0), F.lit(voices - 1))))
             .withColumn("pos", pick_index(n, seed, key, "ch", "voice")))
    listed = shuffled_index(utts.select(utt), [], seed + ":list", utt, "pos")
    from reverbtable.functions.draws import uniform
    got = draws.join(listed, "pos").join(utts.select(utt, "x"), utt)
    part = mean_free(pad_crop(F.col("x"), want, uniform(seed + ":crop", key, "ch", "voice")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("voice", F.col("_p").alias("p")))), lambda s: s["p"])
    summed = A.let(parts, lambda ps: F.aggregate(F.slice(ps, 2, voices), F.get(ps, F.lit(0)),
                                                 lambda acc, p: F.zip_with(acc, p, lambda a, b: a + b)))
    return got.select(key, "ch", "voice", part.alias("_p")).groupBy(key, "ch").agg(summed.alias("x"))
