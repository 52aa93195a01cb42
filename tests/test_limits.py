"""Edges that once were cut off: long memories, long headers, other formats, silence, missing knots."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from reverbtable.functions import acoustics as ac
from reverbtable.functions.scan import ewma
from reverbtable.operators import dsp, features, sampling, timeline
from reverbtable.sources import files


@pytest.mark.parametrize("alpha", [0.0, 1e-12, 0.3, 0.99, 1.0])
@pytest.mark.parametrize("full", [True, False])
def test_smoothing_over_many_blocks(spark, alpha, full):
    x = np.random.default_rng(3).normal(size=300) + 5
    df = spark.createDataFrame([(k, i, float(v)) for k in "ab" for i, v in enumerate(x)], "k string, n long, x double")
    got = [r.s for r in ewma(df, ["k"], "n", "x", alpha, "s", full, cap=16).filter("k = 'b'").orderBy("n").collect()]
    want, s = [], 0.0
    for i, v in enumerate(x):
        s = v if full and i == 0 else alpha * s + (1 - alpha) * v
        want.append(s)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12)


def test_smoothing_refuses_other_factors(spark):
    with pytest.raises(ValueError):
        ewma(spark.range(1).selectExpr("id as n", "1.0 as x"), [], "n", "x", 1.5, "s")


def wav(tag, bits, body, channels=1, extra=0, extensible=False):
    fmt = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, channels, 8000, 8000 * channels * bits // 8, channels * bits // 8, bits)
    if extensible:
        fmt += struct.pack("<HHIH14s", 22, bits, 3, tag, b"\0" * 14)
    chunks = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"LIST" + struct.pack("<I", extra) + b"\0" * extra
    chunks += b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(chunks)) + chunks


def test_wav_formats(spark, tmp_path):
    made = {"f32": wav(3, 32, np.array([0.5, -0.25], "<f4").tobytes()), "f64": wav(3, 64, np.array([0.5, -0.25], "<f8").tobytes()),
            "i16": wav(1, 16, np.array([16384, -8192], "<i2").tobytes(), extra=70_000), "u8": wav(1, 8, bytes([192, 96])),
            "i24": wav(1, 24, b"".join(int(v * 2**23).to_bytes(3, "little", signed=True) for v in (0.5, -0.25)), extensible=True),
            "i32": wav(1, 32, np.array([2**30, -2**29], "<i4").tobytes()), "adpcm": wav(2, 4, b"1234"), "junk": b"x"}
    for name, body in made.items():
        (tmp_path / f"{name}.wav").write_bytes(body)
    rows = {r.path.rsplit("/", 1)[1][:-4]: r for r in files.read_wav(spark, str(tmp_path)).collect()}
    for name in ("f32", "f64", "i16", "u8", "i24", "i32"):
        assert rows[name].samples == [0.5, -0.25] and rows[name].error is None
    assert all(rows[name].error and rows[name].samples is None for name in ("adpcm", "junk"))
    meta = {r.path.rsplit("/", 1)[1][:-4]: r for r in files.wav_metadata(spark, str(tmp_path)).collect()}
    assert meta["i16"].n_samples == 2 and meta["i16"].fs == 8000 and meta["junk"].fs is None and meta["i24"].tag == 1


def test_silence_does_not_stop_a_job(spark):
    one = spark.range(1)
    silent = F.array(F.array(F.lit(0.0), F.lit(0.0)))
    r = one.select(dsp.peak_normalise(silent).alias("p"), *[v.alias(k) for k, v in ac.unit(F.lit(0.0), F.lit(0.0), F.lit(0.0)).items()],
                   ac.absorption_from_t60(F.lit(3.0), F.lit(3.0), F.lit(3.0), F.lit(0.0)).alias("a")).first()
    assert r.p == [[0.0, 0.0]] and r.x is None and r.a is None
    cross = spark.createDataFrame([(1.0, 0.0, 0.0, 2.0)], "re double, im double, p0 double, p1 double")
    assert features.coherence(cross).first().coherence is None
    cells = spark.createDataFrame([(1, 1.0, 2.0, False)], "k int, pred double, gt double, hidden boolean")
    assert features.masked_mse(cells, ["k"], 2).first().mse_masked is None
    nothing = spark.createDataFrame([("a", 1, 0), ("b", 2, 4)], "speaker string, utt_id long, n long")
    assert {r.speaker for r in sampling.concat_plan(nothing, 6).collect()} == {"b"}


def test_unequal_lengths_and_channels(spark):
    x, v = F.array(F.array(*[F.lit(1.0)] * 4)), F.array(F.array(F.lit(1.0), F.lit(-1.0)))
    mixed = spark.range(1).select(dsp.snr_mix(x, v, F.lit(0.0)).alias("m")).first().m[0]
    assert None not in mixed and mixed[2:] == [1.0, 1.0] and len(mixed) == 4
    three = F.array(*[F.array(F.array(F.lit(1.0)))] * 3)
    with pytest.raises(Exception, match="two channels"):
        spark.range(1).select(dsp.mix_to_coherence(three, three, F.array(F.struct(F.lit(0.5).alias("g"), F.lit(True).alias("on"))))).collect()


def test_sources_share_the_factor(spark):
    a, b, c = (F.array(F.array(*[F.lit(float(v)) for v in vs])) for vs in ((1, -2), (4, 0), (8, 8)))
    r = spark.range(1).select(*[s.alias(f"s{k}") for k, s in enumerate(dsp.peak_scaled([a, b, c], 1.0))]).first()
    assert (r.s0, r.s1, r.s2) == ([[0.25, -0.5]], [[1.0, 0.0]], [[2.0, 2.0]])


def test_probes_without_knots_stay(spark):
    probes = spark.createDataFrame([("a", 5), ("b", 5)], "k string, t long")
    knots = spark.createDataFrame([("a", 0, 1.0), ("a", 10, 3.0)], "k string, t long, v double")
    assert {r.k: r.v for r in timeline.interpolate(probes, knots, ["k"]).collect()} == {"a": 2.0, "b": None}


def test_random_crop_and_origins(spark):
    signals = spark.createDataFrame([(k, [float(10 * k + j) for j in range(4)]) for k in range(3)], "sig_id long, x array<double>")
    utts = spark.createDataFrame([("s", k, 4) for k in range(3)], "speaker string, utt_id long, n long")
    plan = sampling.concat_plan(utts, 6)
    whole = {r.start: r.x for r in sampling.concat_signals(plan, signals, 6).collect()}
    for r in sampling.concat_signals(plan, signals, 6, seed="c").collect():
        assert any(whole[r.start][i:i + 6] == r.x for i in range(len(whole[r.start]) - 5))
    both = sampling.mixed_origins(utts.limit(1), signals, (True, True))
    assert both.groupBy("origin").agg(F.sum("weight").alias("w")).filter("w = 0.5").count() == 2
    assert sampling.mixed_origins(utts, signals, (False, True)).filter("origin = 'real'").count() == 0
    with pytest.raises(ValueError):
        sampling.mixed_origins(utts, signals, (False, False))


def test_ranges_by_join_and_in_the_row(spark):
    df = spark.createDataFrame([(k, "abcdefghij" * (k + 1)) for k in range(5)], "rec long, text string")
    ranges = df.select("rec", F.col("rec").alias("st"), (F.col("rec") * 9 + 3).alias("ed"))
    joined = dsp.ranged_read(dsp.chunked_text_pcm(df, "rec", "text", 7), ranges, "rec", 7)
    alone = dsp.ranged_read_in_row(df, "rec", "text", F.col("rec"), F.col("rec") * 9 + 3, 7)
    rows = lambda d: sorted((r.rec, r.t0, tuple(r.samples)) for r in d.collect())
    assert rows(joined) == rows(alone) and len(rows(alone)) > 5
    lengths = dsp.chunk_lengths(df, "text", 7).groupBy("rec").agg(F.sum("n").alias("n"))
    assert {r.rec: r.n for r in lengths.collect()} == {k: 10 * (k + 1) for k in range(5)}
