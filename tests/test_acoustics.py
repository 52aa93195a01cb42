"""Analytic goldens and brute-force comparisons for responses and geometry."""

import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from reverbtable.functions import acoustics as ac
from reverbtable.operators import geometry as G, rir as R, sampling as S
from reverbtable.plans import rir as rir_plans
from tests.oracle_check import compare


def value(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("v")).first().v


def test_exponential_response_has_its_t60(spark):
    fs, t60 = 16000, 0.3
    h = [math.exp(-6.907755 * n / (fs * t60)) for n in range(8000)]
    got = R.t60(spark.createDataFrame([(1, h)], "id int, h array<double>"), ["id"], fs).first()
    assert got.t60 == pytest.approx(t60, abs=2e-3) and abs(got.corr) > 0.999


def test_edc_never_rises(spark):
    rng = random.Random(1)
    h = [rng.gauss(0, 1) * math.exp(-n / 40) for n in range(300)]
    rows = R.edc(spark.createDataFrame([(1, h)], "id int, h array<double>"), ["id"]).orderBy("n").collect()
    assert all(a.edc >= b.edc - 1e-12 for a, b in zip(rows, rows[1:]))


def test_two_taps_drr_and_gain_invariance(spark):
    h = [0.0, 1.0] + [0.0] * 158 + [0.5] + [0.0] * 20
    df = spark.createDataFrame([(1, h), (2, [10 * v for v in h])], "id int, h array<double>").withColumn("h_dp", F.col("h"))
    a, b = R.energy_labels(df, 16000).orderBy("id").collect()
    assert a.drr == pytest.approx(10 * math.log10(4), abs=1e-4) and a.drr == pytest.approx(b.drr, abs=1e-4)


def test_validity(spark):
    bad = [[0.0] * 4, [1.0, float("nan")], [1.0, float("inf")], [1.0, 0.0]]
    got = spark.createDataFrame([(i, h) for i, h in enumerate(bad)], "i int, h array<double>").select("i", R.is_valid(F.col("h")).alias("v"))
    assert [r.v for r in got.orderBy("i").collect()] == [False, False, False, True]


def test_plateau_peak_is_its_middle(spark):
    h = [0.0, 1.0, 1.0, 1.0, 0.0, 2.0, 0.0, 3.0]
    got = value(spark, R.local_peaks(F.array(*[F.lit(v) for v in h])))
    assert [(p.n, p.height) for p in got] == [(2, 1.0), (5, 2.0)]


def brute_pairs(points, lo, hi):
    return {(a, b) for (a, p), (b, q) in itertools.combinations(sorted(points.items()), 2) if lo <= math.dist(p, q) <= hi}


@pytest.mark.parametrize("kind", ["spread", "crowd", "copies", "line"])
def test_pairs_match_brute_force(spark, kind):
    rng = random.Random(kind)
    if kind == "spread":
        pts = {i: tuple(rng.uniform(-0.5, 0.5) for _ in range(3)) for i in range(150)}
    elif kind == "crowd":  # most microphones closer than the lower bound, a few at the right distance
        pts = {i: tuple(rng.uniform(0, 0.005) for _ in range(3)) for i in range(150)}
        pts.update({200 + i: (0.1, 0.0, rng.uniform(0, 0.01)) for i in range(5)})
    elif kind == "copies":
        pts = {i: ((i % 3) * 0.1, 0.0, 0.0) for i in range(60)}
    else:
        pts = {0: (0.0, 0, 0), 1: (0.02, 0, 0), 2: (0.06, 0, 0), 3: (0.30, 0, 0)}
    df = spark.createDataFrame([(1, i, *map(float, p)) for i, p in pts.items()], "array_id int, mic_id int, x double, y double, z double")
    got = {(r.m1, r.m2) for r in G.mic_pairs(df, 0.03, 0.20).collect()}
    assert got == brute_pairs(pts, 0.03, 0.20)
    both = {(r.m1, r.m2) for r in G.mic_pairs(df, 0.03, 0.20, ordered=True).collect()}
    assert both == got | {(b, a) for a, b in got}


def test_crowd_is_not_paired(spark):
    """Candidates follow the result: a crowd inside the lower bound costs no row pairs."""
    pts = [(1, i, 1e-4 * (i % 7), 0.0, 0.0) for i in range(20000)]
    df = spark.createDataFrame(pts, "array_id int, mic_id int, x double, y double, z double")
    assert G.mic_pairs(df, 0.03, 0.20).count() == 0


def test_sabine_weight_is_exact(spark):
    dims = {"lx": F.lit(6.0), "ly": F.lit(5.0), "lz": F.lit(3.0)}
    _, _, alpha = ac.wall_weight_for_t60(**dims, t60=F.lit(0.6), weights=[F.lit(w) for w in (0.5, 0.9, 0.7, 0.6, 1.0, 0.8)])
    assert value(spark, ac.sabine_t60(**dims, walls=alpha)) == pytest.approx(0.6, abs=1e-12)


def test_tdoa_flips_with_channels(spark):
    mics = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 0.1, 0.0, 0.0)], "array_id int, mic int, x double, y double, z double")
    turned = mics.withColumn("mic", 1 - F.col("mic"))
    src = spark.createDataFrame([(1, 7, 1.0, 2.0, 0.5)], "array_id int, src_id int, x double, y double, z double")
    a = G.tdoa(mics, src).filter("mic = 1").first().tdoa
    b = G.tdoa(turned, src).filter("mic = 1").first().tdoa
    assert a == pytest.approx(-b, abs=1e-15)


def test_scenarios_are_feasible_and_partition_free(spark):
    def draw(parts):
        ids = spark.range(300).repartition(parts)
        return S.scenarios(ids, "id", "x", {"lx": (3.0, 10.0), "ly": (3.0, 8.0), "lz": (2.5, 6.0)}, (0.2, 1.3), (0.5, 1.0), attempts=2)
    a, b = ({r.id: r for r in draw(p).collect()} for p in (1, 7))
    assert a == b and len(a) == 300
    drawn = [r for r in a.values() if r.t60 is not None]
    assert len(drawn) > 250 and any(r.attempt is None for r in drawn)
    for r in drawn:
        assert 0.2 <= r.t60 <= 1.3 and 0 < r.x <= 1 + 1e-12
        assert r.t60 + 0.005 >= 15 * math.sqrt(r.lx ** 2 + r.ly ** 2 + r.lz ** 2) / 343


def test_draw_frequencies_follow_weights(spark):
    weights = {"a": 1.0, "b": 3.0, "c": 6.0}
    cdf = S.cdf(spark.createDataFrame(list(weights.items()), "item string, w double"), [], "w", "item")
    assert cdf.agg(F.max("cdf")).first()[0] == 1.0
    from reverbtable.functions.draws import uniform
    n = 20000
    draws = spark.range(n).select("id", uniform("z", "id").alias("u"))
    got = {r["item"]: r["c"] for r in S.draw(draws, cdf, [], "u", ["item"]).groupBy("item").agg(F.count("*").alias("c")).collect()}
    assert sum(got.values()) == n
    for k, w in weights.items():
        p = w / 10
        assert abs(got[k] - n * p) < 5 * math.sqrt(n * p * (1 - p))


def test_folds_are_disjoint(spark):
    folds = S.room_folds(spark.range(4).withColumnRenamed("id", "room"), "room", "s").collect()
    assert len(folds) == 4 and {f.test_room for f in folds} == {0, 1, 2, 3}
    assert all(f.val_room != f.test_room and f.n_train_rooms == 2 for f in folds)


def test_other_speaker_never_equal(spark):
    utts = spark.createDataFrame([("s%d" % (0 if i % 3 else i % 11), i) for i in range(400)], "speaker string, utt_id long")
    out = S.other_speaker(utts, "q").collect()
    assert len(out) == 400 and all(r.speaker != r.speaker_b for r in out)


def test_direct_path_after_the_first_samples_as_in_the_sql(spark, tmp_path):
    """Largest peak at 40 with a smaller one at 5, and one peak alone at 30: a search in 25 samples finds others."""
    rows = [(k, [100.0 if n == late else 0.1 if n == 5 and k == 0 else 0.0 for n in range(64)], 1) for k, late in enumerate((40, 30, 3))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert compare(rir_plans.drr_from_head(spark, str(tmp_path)), con, rir_plans.ORACLE["drr_from_head"]) == ""
