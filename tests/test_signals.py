"""Kernels and signal operators against numpy on small fixtures."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reverbtable.functions import acoustics as ac, kernels as K
from reverbtable.operators import dsp as S, features as X

RNG = np.random.default_rng(7)


def one(spark, expr, **arrays):
    def kind(v):
        return "array<array<double>>" if np.ndim(v[0]) else "array<double>"
    row = tuple([list(map(float, c)) for c in v] if np.ndim(v[0]) else list(map(float, v)) for v in arrays.values())
    df = spark.createDataFrame([row], ", ".join(f"{k} {kind(v)}" for k, v in arrays.items()))
    return df.select(expr.alias("v")).first().v


def test_convolution_full_length(spark):
    x, hs = RNG.normal(size=500), RNG.normal(size=(3, 90))
    got = one(spark, S.convolve(F.col("x"), F.col("hs")), x=x, hs=hs)
    for ch in range(3):
        assert np.allclose(got[ch], np.convolve(x, hs[ch])[:500])


@pytest.mark.parametrize("rates", [(48000, 16000), (44100, 16000), (16000, 24000), (16000, 16000)])
def test_resample_matches_zero_stuffing(spark, rates):
    x = RNG.normal(size=640)
    got = np.array(one(spark, K.resample(*rates)(F.col("x")), x=x))
    g = math.gcd(*rates)
    up, down = rates[1] // g, rates[0] // g
    if up == down:
        assert np.allclose(got, x)
        return
    taps = K.resample_taps(up, down)
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    want = np.convolve(stuffed, taps)[(len(taps) - 1) // 2:][:len(stuffed)][::down]
    assert len(got) == -(-640 * up // down) and np.allclose(got, want)


def test_resample_keeps_a_slow_sine(spark):
    t = np.arange(4800) / 48000
    got = np.array(one(spark, K.resample(48000, 16000)(F.col("x")), x=np.sin(2 * np.pi * 440 * t)))
    assert np.allclose(got[50:-50], np.sin(2 * np.pi * 440 * np.arange(1600) / 16000)[50:-50], atol=5e-3)


def test_stft_peak_and_round_trip(spark):
    x = np.cos(2 * np.pi * 1000 * np.arange(4096) / 16000)
    spec = one(spark, K.stft(512, 256)(F.col("xs")), xs=[x, 0.5 * x])
    mag = np.abs(np.array(spec.re[0]) + 1j * np.array(spec.im[0]))
    assert mag.shape == (15, 257) and set(mag.argmax(axis=1)) == {32}
    assert spec.level == pytest.approx(mag.mean())
    y = RNG.normal(size=(2, 2048))
    s = K.stft(512, 256)(F.col("xs"))
    df = spark.createDataFrame([([list(map(float, c)) for c in y],)], "xs array<array<double>>").select(s.alias("s"))
    back = np.array(df.select(K.istft(512, 256)(F.col("s.re"), F.col("s.im")).alias("v")).first().v)
    assert np.allclose(back[:, 1:], y[:, 1:])


def test_snr_is_reached(spark):
    x, v = RNG.normal(size=(2, 4000)), RNG.normal(size=(2, 4000)) * 3
    got = np.array(one(spark, S.snr_mix(F.col("xs"), F.col("noise"), F.lit(20.0)), xs=x, noise=v))
    noise = got - x
    assert 10 * np.log10((x ** 2).mean() / (noise ** 2).mean()) == pytest.approx(20, abs=1e-6)


def test_range_error(spark):
    with pytest.raises(Exception, match="exceeds"):
        one(spark, S.select_range(F.col("x"), 2, 9), x=[1.0, 2.0, 3.0])


def test_pad_crop_doubles(spark):
    got = one(spark, S.pad_crop(F.col("x"), 11, F.lit(0.999)), x=[1.0, 2.0, 3.0])
    long = [1.0, 2.0, 3.0] * 4
    assert got == long[1:12]


def test_white_noise_moments_and_independence(spark):
    xs = np.array(spark.range(1).select(S.white_noise(F.lit(20000), 2, "s", "id").alias("v")).first().v)
    assert abs(xs.mean()) < 0.03 and abs(xs.std() - 1) < 0.03 and abs(np.corrcoef(xs)[0, 1]) < 0.03


def test_diffuse_noise_has_target_coherence(spark):
    df = spark.range(24).withColumn("xs", S.white_noise(F.lit(4096), 2, "s", "id"))
    out = S.diffuse_noise(df, "xs", F.lit(0.05), 16000, 256)
    spec = X.with_spectrum(out, "xs", 256, 64)
    cross = X.coherence(X.cross_spectrum(X.pair_channels(spec.withColumn("g", F.lit(1)), ["g"], "M").drop("id", "level"), ["g"]))
    got = {r.bin: r.coherence for r in cross.collect()}
    for k in range(2, 127, 8):
        x = 2 * math.pi * k * 62.5 * 0.05 / ac.SOUND_SPEED
        assert got[k] == pytest.approx(math.sin(x) / x, abs=0.12)


@pytest.mark.parametrize("mode,n", [("T", 20), ("T_cluster", 20), ("TF", 20), ("T_cluster2", 20), ("T_cluster_inverse", 44)])
def test_masks_have_their_size(spark, mode, n):
    rows = spark.range(50).select(X.masked_patches("id", mode, 20, (8, 8)).alias("m")).collect()
    assert all(len(r.m) == n == len(set(r.m)) and 0 <= min(r.m) and max(r.m) < 64 for r in rows)
    assert len({tuple(r.m) for r in rows}) > 40


@pytest.mark.parametrize("f_first", [True, False])
def test_patches_go_back(spark, f_first):
    cells = spark.range(8 * 6).select((F.col("id") % 8).alias("bin"), F.floor(F.col("id") / 8).alias("frame"), F.col("id").alias("v"))
    cut = X.patch_split(cells, 8, 6, 4, 2, f_first)
    assert cut.groupBy("patch").count().filter("count = 8").count() == 6
    back = {(r.bin, r.frame): r.v for r in X.patch_recover(cut, 8, 6, 4, 2, f_first).collect()}
    assert back == {(i % 8, i // 8): i for i in range(48)}


def test_convolution_holds_input_and_output_only():
    rng = np.random.default_rng(8)
    x = [rng.normal(size=n) for n in ([64] * 1500 + [0, 7])]
    hs = [[rng.normal(size=m) for m in (64, 20, 0, 64)] for _ in x]
    args = pa.array([v.tolist() for v in x], pa.list_(pa.float64())), pa.array([[h.tolist() for h in row] for row in hs], pa.list_(pa.list_(pa.float64())))
    kernel = K.convolve_channels().func
    kernel(*[a.slice(1495) for a in args])
    tracemalloc.start()
    got = kernel(*args)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * 8 * 4 * sum(map(len, x))
    for row, v, r in zip(got.to_pylist(), x, hs):
        assert all(np.allclose(y, np.convolve(v, h)[:len(v)] if len(v) and len(h) else np.zeros(len(v))) for y, h in zip(row, r))
