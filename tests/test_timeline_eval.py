"""Hand-worked cases for timelines, stopping rules and baselines."""

import math

import pytest
from pyspark.sql import functions as F

from reverbtable.operators import evaluate as E, timeline as L


def gaps(spark, spans, t):
    df = spark.createDataFrame([(1, i, a * 10, b * 10) for i, (a, b) in enumerate(spans)], "session int, utt_id int, st long, en long")
    rows = L.speech_gaps(df, t * 10, F.lit(10_000)).collect()
    return sorted((r.st / 10, r.en / 10) for r in rows)


def test_gaps(spark):
    assert gaps(spark, [(0, 4), (5, 9), (8, 12), (20, 21), (30, 31)], 4) == [(0, 5), (4, 8), (9, 20), (12, 30)]
    assert gaps(spark, [(0, 10), (2, 3), (12, 13)], 1) == [(0, 2), (10, 12)]
    assert gaps(spark, [(0, 10)], 1) == []


def test_interpolation_clamps(spark):
    knots = spark.createDataFrame([(1, 0, 0.0), (1, 1, 10.0), (1, 3, 30.0)], "key int, t long, v double")
    probes = spark.createDataFrame([(1, -1), (1, 2), (1, 9)], "key int, t long")
    assert {r.t: r.v for r in L.interpolate(probes, knots, ["key"]).collect()} == {-1: 0.0, 2: 20.0, 9: 30.0}


def test_asof_is_strict(spark):
    states = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 7)], "key int, t long, s int")
    probe = spark.createDataFrame([(1, 1), (1, 0)], "key int, t long")
    assert {r.t: r.s for r in L.last_before(probe, states, ["key"], "s").collect()} == {1: 5, 0: None}


def test_azimuth_unwrap(spark):
    df = spark.createDataFrame([(1, 0, 3.1), (1, 1, -3.1)], "key int, n long, azi double")
    assert abs(L.segment_azimuth(df, "key", "n", "azi", 2, 2).first().azi) == pytest.approx(math.pi, abs=1e-9)


def test_windows_cover_each_sample_once_per_step(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(23)], "key int, n long, x double")
    got = {r.w: r.x for r in L.segment_means(df, ["key"], "n", ["x"], 8, 5).collect()}
    assert got == {w: sum(range(w * 5, w * 5 + 8)) / 8 for w in range(4)}


def stop_loop(losses, patience):
    best, cnt, stops, s1, s2, be = None, 0, 0, None, None, None
    for n, x in enumerate(losses, 1):
        if best is None or x <= best:
            best, cnt, be = x, 0, n
        else:
            cnt += 1
            if cnt >= patience:
                stops += 1
                if stops == 1:
                    s1, cnt = n, 0
                else:
                    s2 = n
                    break
    return s1, s2, be


@pytest.mark.parametrize("losses", [[5, 4, 4, 6, 6], [3, 2, 1], [1, 2, 2, 2, 2, 2, 2], [5, 6, 6, 4, 7, 7, 7, 3, 9],
                                    [9, 9.5, 9.6, 9.1, 8, 8.1, 8.2, 8.3, 7, 1]])
def test_early_stop(spark, losses):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(losses, 1)], "run int, epoch long, loss double")
    r = E.early_stop(df, "run", "epoch", "loss", 2).first()
    assert (r.stop1, r.stop2, r.best_epoch) == stop_loop(losses, 2)


def test_forgetting_mean_long_series(spark):
    xs = [math.sin(i) + 2 for i in range(200)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "k int, n long, x double")
    got = {r.n: r.mu for r in E.forgetting_mean(df, ["k"], "n", "x", 30).collect()}
    mu = 0.0
    for i, x in enumerate(xs):
        a = (i - 1) / (i + 1) if i <= 30 else 29 / 31
        mu = a * mu + (1 - a) * x
        assert got[i] == pytest.approx(mu, abs=1e-9)


def test_baseline(spark):
    df = spark.createDataFrame([("T", "train", 1.0), ("T", "train", 3.0), ("T", "test", 5.0)], "task string, split string, gt double")
    r = E.mean_baseline(df).first()
    assert (r.train_mean, r.train_mae, r.test_mae, r.test_min) == (2.0, 1.0, 3.0, 5.0)
