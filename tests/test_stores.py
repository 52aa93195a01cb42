"""Published folders, reports, catalogue, stateful smoother, blocks by rows, speaker mixes and noise."""

import datetime as dt
import hashlib
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reverbtable.functions import kernels as K
from reverbtable.functions.scan import asof, with_row_blocks
from reverbtable.operators import catalog, dsp, evaluate, rir, sampling, timeline
from reverbtable.sources import sinks, wav
from reverbtable.streaming import live

BY = ["stage", "corpus"]


def signals(spark, rows):
    return spark.createDataFrame(rows, "idx long, stage string, corpus string, x array<double>")


ROWS = [(k, "tr" if k % 3 else "dt", "ab"[k % 2], [float(k), -1.0]) for k in range(40)]


def rows_of(df):
    return sorted(map(tuple, df.select("idx", "stage", "corpus", F.to_json(F.struct("x"))).collect()))


def test_publish_replaces_folders(spark, tmp_path):
    path = str(tmp_path / "sig")
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, path)
    first = sorted(map(tuple, sinks.publish(signals(spark, ROWS), path, BY).collect()))
    assert sum(r[2] for r in first) == 40 and len(first) == 4
    assert rows_of(sinks.published(spark, path)) == rows_of(signals(spark, ROWS))
    with pytest.raises(FileExistsError):
        sinks.publish(signals(spark, ROWS[:1]), path, BY)
    again = sorted(map(tuple, sinks.publish(signals(spark, ROWS[::-1]).repartition(7), path, BY, overwrite=True).collect()))
    assert again == first  # the same rows in another order and layout: the same manifest
    new = [(100 + k, "dt", "a", []) for k in range(3)] + [(200, "et", "a", [5.0])]
    sinks.publish(signals(spark, new), path, BY, overwrite=True)
    want = [r for r in ROWS if (r[1], r[2]) != ("dt", "a")] + new
    assert rows_of(sinks.published(spark, path)) == rows_of(signals(spark, want))
    assert len(sinks.clear_unused(spark, path)) == 1  # only the first run is named by nothing
    assert rows_of(sinks.published(spark, path)) == rows_of(signals(spark, want))


def test_interrupted_runs_change_nothing(spark, tmp_path):
    path = str(tmp_path / "sig")
    sinks.publish(signals(spark, ROWS), path, BY)
    bad = signals(spark, ROWS).withColumn("x", F.when(F.col("idx") == 7, F.raise_error(F.lit("stop")).cast("array<double>")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="stop"):
        sinks.publish(bad, path, BY, overwrite=True)
    (tmp_path / "sig" / "_manifest" / "0000000005").mkdir()  # a manifest that was never completed
    assert rows_of(sinks.published(spark, path)) == rows_of(signals(spark, ROWS))
    sinks.publish(signals(spark, ROWS[:9]), path, BY, overwrite=True)
    assert sorted(p.name for p in (tmp_path / "sig" / "_manifest").iterdir())[-1] == "0000000006"
    lost = next((tmp_path / "sig" / "_runs").rglob("stage=tr/corpus=b/*.parquet"))
    kept = {str(p) for p in (tmp_path / "sig" / "_runs").rglob("*.parquet")}
    assert str(lost) in kept
    newest = spark.read.parquet(str(tmp_path / "sig" / "_manifest" / "0000000006")).first().run
    part = next((tmp_path / "sig" / "_runs" / newest).rglob("*.parquet"))
    spark.createDataFrame([(1, [2.0])], "idx long, x array<double>").coalesce(1).write.mode("overwrite").parquet(str(part.parent))
    with pytest.raises(ValueError, match="manifest"):
        sinks.published(spark, path)
    assert sinks.published(spark, path, check=False).count() > 0


def test_reports(spark, tmp_path):
    rows = [("T60", "ft", m, 400, "all", t, bs, lr, (bs + t) % 3 + lr / 100, bs / 10, lr / 10, t / 10 + bs / 100)
            for m in ("simR16", "sim2T", "real_ACE", "odd") for t in (0, 1) for bs in (8, 16) for lr in (1, 2)]
    cols = "task string, ft string, model_data string, num int, embed string, trial int, bs int, lr int, val_loss double, val_mae double, test_loss double, test_mae double"
    raw, best, averaged = evaluate.reports(spark.createDataFrame(rows, cols))
    assert raw.count() == 32 and best.count() == 8
    for r in best.collect():
        mine = [x for x in rows if x[2].startswith(r.model_data) and x[5] == r.trial]
        x = min(mine, key=lambda x: (x[8], x[7], x[6]))
        assert (r.bs, r.lr, r.val_mae, r.test_mae) == (x[6], x[7], x[9], x[11])
        assert (r.room_num, r.data_num) == ({"sim": "16"}.get(r.model_data, "invalid"), "400" if "real" in r.model_data else "invalid")
    got = {r.model_data: r.test_mae for r in averaged.collect()}
    assert set(got) == {"sim", "sim2T", "real_ACE", "odd"}
    for m, v in got.items():
        assert v == pytest.approx(np.mean([r.test_mae for r in best.collect() if r.model_data == m]))
    sinks.write_reports(raw, best, averaged, str(tmp_path / "r"))
    heads = spark.read.csv(str(tmp_path / "r" / "best"), header=True).columns
    assert heads == sinks.BEST and (tmp_path / "r" / "best_avgtri" / "_SUCCESS").exists()


def test_catalogue_follows_files(spark, tmp_path):
    root, out, ck = tmp_path / "in", str(tmp_path / "cat"), str(tmp_path / "ck")
    (root / "sub").mkdir(parents=True)
    (root / "a.wav").write_bytes(wav.wav_bytes(np.zeros((100, 2)), 8000))
    (root / "sub" / "b.wav").write_bytes(b"no sound")
    live.ingest(spark, str(root), out, ck).awaitTermination(60)
    rows = {r.path.rsplit("/", 1)[1]: r for r in live.catalogue(spark, out).collect()}
    assert rows["a.wav"].n_samples == 100 and rows["a.wav"].error is None and rows["b.wav"].error and rows["b.wav"].fs is None
    before = sorted(map(str, live.catalogue(spark, out).collect()))
    # the same micro-batch once more: the folder is replaced by the same rows
    again = spark.read.parquet(f"{out}/batch=s000000000000").select("path", "length", "mtime")
    wav.with_heads(spark.createDataFrame(again.collect(), again.schema)).write.mode("overwrite").parquet(f"{out}/batch=s000000000000")
    assert sorted(map(str, live.catalogue(spark, out).collect())) == before
    assert live.refresh(spark, str(root), out) == 0
    time.sleep(0.05)
    (root / "sub" / "b.wav").write_bytes(wav.wav_bytes(np.zeros((7, 1)), 8000))
    (root / "c.wav").write_bytes(wav.wav_bytes(np.zeros((8, 1)), 8000))
    live.ingest(spark, str(root), out, ck).awaitTermination(60)  # takes c only: the path of b is known to it
    assert live.refresh(spark, str(root), out) == 1 and live.refresh(spark, str(root), out) == 0
    rows = {r.path.rsplit("/", 1)[1]: r for r in live.catalogue(spark, out).collect()}
    assert {n: r.n_samples for n, r in rows.items()} == {"a.wav": 100, "b.wav": 7, "c.wav": 8}


def test_refresh_without_a_catalogue(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(wav.wav_bytes(np.zeros((5, 1)), 8000))
    assert live.refresh(spark, str(tmp_path / "in"), str(tmp_path / "cat")) == 1
    assert live.catalogue(spark, str(tmp_path / "cat")).first().n_samples == 5


T0 = dt.datetime(2024, 1, 1)


def stream_rows(spark, tmp_path, batches, quiet_s):
    src, out = str(tmp_path / "src"), f"s{abs(hash(str(tmp_path)))}"
    cols = "k string, ts timestamp, v double"
    for b in batches:
        spark.createDataFrame(b, cols).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.02)
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(src)
    smooth = live.running_smoother(stream, "k", "ts", "v", 0.5, late="1 minute", quiet_s=quiet_s)
    q = smooth.writeStream.format("memory").queryName(out).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    return {(r.key, r.t): r.smooth for r in spark.table(out).collect()}


def at(m):
    return T0 + dt.timedelta(minutes=m)


def test_smoother_over_batches_and_timeout(spark, tmp_path):
    rng = np.random.default_rng(0)
    batches = [[(k, at(20 * b + j), float(rng.normal())) for k in "ab" for j in rng.permutation(9).tolist()] for b in range(3)]
    batches += [[("b", at(500), 1.0)], [("b", at(510), 2.0)], [("a", at(520), 7.0), ("b", at(520), 3.0)]]
    got = stream_rows(spark, tmp_path, batches, 7200.0)
    want, state = {}, {}
    for k, t, v in sorted((r for b in batches for r in b), key=lambda r: r[1]):
        s = state.get(k)
        if s is not None and k == "a" and t == at(520):
            s = None  # silent for over two hours: forgotten
        if s is not None and t == at(500):
            pass  # the timer of b fires only once the watermark has moved, after this row
        state[k] = v if s is None else 0.5 * s + 0.5 * v
        want[k, t] = state[k]
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("alpha", [0.0, 1e-9, 0.3, 0.8, 0.999999, 1.0])
def test_fold(alpha):
    x = np.random.default_rng(1).normal(size=700) + 3
    for start in (None, 2.5):
        s, want = start, []
        for v in x:
            s = float(v) if s is None else alpha * s + (1 - alpha) * v
            want.append(s)
        assert np.allclose(live.fold(x, alpha, start), want, rtol=1e-9)


def test_blocks_follow_rows(spark):
    rng = np.random.default_rng(2)
    burst = rng.integers(10**9, 10**9 + 5000, 20000).tolist()  # all within five milliseconds
    quiet = rng.integers(0, 10**15, 2000).tolist()
    rows = [("hot", t) for t in burst + quiet] + [("small", t) for t in quiet[:90]] + [("hot", None), (None, 5)]
    df = spark.createDataFrame(rows, "k string, t long")
    for levels, size in ((1, 500), (2, 20)):
        out = with_row_blocks(df, ["k"], "t", size, levels=levels)
        assert out.count() == len(rows)
        found = [(r.k, r.t, r._cut) for r in out.collect()]
        hot = Counter(c for k, _, c in found if k == "hot")
        assert len(hot) > 20 and max(hot.values()) <= 2 * (22001 / len(hot)) + 8 and {c for k, _, c in found if k == "small"} <= ({0} if size == 500 else set(range(256 * 256)))
        line = sorted((t is not None, t or 0, c) for k, t, c in found if k == "hot")
        assert [c for _, _, c in line] == sorted(c for _, _, c in line)  # blocks are in order of time


def test_asof_in_a_burst(spark, monkeypatch):
    from reverbtable.functions import scan as module
    monkeypatch.setattr(module.with_row_blocks, "__defaults__", (50, "_cut", 1))
    rng = np.random.default_rng(3)
    knots = sorted({int(t) for t in rng.integers(0, 3000, 700)})
    probes = [int(t) for t in rng.integers(-10, 3010, 900)]
    left = spark.createDataFrame([("a", i, t) for i, t in enumerate(probes)], "k string, i int, t long")
    right = spark.createDataFrame([("a", t, float(t)) for t in knots], "k string, t long, v double")
    got = {r.i: r.hit.v if r.hit else None for r in asof(left, right, ["k"], "t", ["v"]).collect()}
    for i, t in enumerate(probes):
        before = [x for x in knots if x < t]
        assert got[i] == (before[-1] if before else None)


def test_different_speakers(spark):
    utts = spark.createDataFrame([(f"s{k % 6}", k) for k in range(3000)], "speaker string, utt_id long")
    rows = sampling.speakers_mix(utts, 4, "x").collect()
    assert len(rows) == 4 * 3000
    mixes = {}
    for r in rows:
        mixes.setdefault(r.utt_id, {})[r.slot] = (r.speaker_b, r.utt_id_b)
    taken = Counter()
    for u, m in mixes.items():
        assert sorted(m) == [0, 1, 2, 3] and len({s for s, _ in m.values()}) == 4 and m[0] == (f"s{u % 6}", u)
        assert all(s == f"s{v % 6}" for s, v in m.values())
        taken.update((u % 6, s) for s, _ in list(m.values()) if s != f"s{u % 6}")
    each = 3000 / 6 * 3 / 5  # every other speaker in three of five mixes
    assert len(taken) == 30 and all(abs(n - each) < 6 * (each * 0.4) ** 0.5 for n in taken.values())
    assert len({v for m in mixes.values() for _, v in m.values()}) == 3000
    assert sampling.speakers_mix(utts, 1, "x").count() == 3000
    with pytest.raises(Exception, match="different positions"):
        sampling.speakers_mix(utts, 8, "x").count()


def test_noise_without_silence(spark):
    rng = np.random.default_rng(4)
    fs = 100
    quiet, loud = 0.01 * rng.normal(size=(2, 200)), rng.normal(size=(2, 1200))
    clip = np.concatenate([quiet, loud, quiet[:, :100]], axis=1)
    df = spark.createDataFrame([(1, clip.tolist()), (2, clip[:, :150].tolist()), (3, [[], []])], "id long, xs array<array<double>>")
    spans = {r.id: r for r in timeline.noise_span(df, "id", "xs", fs).collect()}
    e = np.convolve((clip ** 2).mean(axis=0), np.ones(40) / 40)
    assert np.allclose(K.boxcar_energy(list(clip), 40), e)
    th = (e[40:150].mean() + e[300:int(len(e) - 300)].mean()) / 4 + (e[40:150].max() + e[300:int(len(e) - 300)].min()) / 4
    on = e > th
    assert (spans[1].st, spans[1].en) == (np.argmax(on[:300]), np.argmin(on[300:]) + 300 - 40) and spans[1].th == pytest.approx(th) and spans[1].usable
    assert spans[2].th is None and spans[3].th is None and not spans[3].usable
    cut = timeline.noise_clip(df, "id", "xs", fs).collect()
    assert [r.id for r in cut] == [1] and np.array_equal(cut[0].xs, clip[:, spans[1].st:spans[1].en])
    for plan in (timeline.moving_energy(df, "id", "xs", 40), timeline.noise_span(df, "id", "xs", fs), timeline.noise_clip(df, "id", "xs", fs)):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_noise_of_responses(spark):
    rng = np.random.default_rng(5)
    clips = {1: (16000, rng.normal(size=(2, 60))), 2: (8000, rng.normal(size=(2, 60))), 3: (None, None)}
    df = spark.createDataFrame([(k, fs, None if x is None else x.tolist()) for k, (fs, x) in clips.items()], "rir_id long, fs int, xs array<array<double>>")
    got = {r.rir_id: np.array(r.noise) for r in dsp.response_noise(df, "xs", "fs", [8000, 16000], 16000, 0.002, 2, "s", "rir_id").collect()}
    assert {k: v.shape for k, v in got.items()} == {1: (2, 32), 2: (2, 32), 3: (2, 32)} and not got[3].any()
    assert any(np.array_equal(got[1], clips[1][1][:, i:i + 32]) for i in range(29))
    bank = K.PolyphaseBank(2, 1)
    assert any(np.allclose(got[2], [bank.outputs(x[i:i + 16], 0, 0, 32) for x in clips[2][1]]) for i in range(45))
    with pytest.raises(Exception, match="shorter than asked"):
        dsp.response_noise(df, "xs", "fs", [8000, 16000], 16000, 0.02, 2, "s", "rir_id").collect()


def test_direct_path_in_the_head(spark):
    h = [0.0, 0.0, 0.2, 0.0, 0.6, 0.0, 0.0] + [0.0, 5.0, 0.0] * 3
    df = spark.createDataFrame([(h,), ([0.0] * 10,)], "h array<double>")
    got = [(r.a, r.b) for r in df.select(rir.dp_in_head(F.col("h"), 1120).alias("a"), rir.dp_from_peaks(F.col("h")).alias("b")).collect()]
    assert got == [(4, 8), (None, None)]


def test_sheets_with_one_usual_duration(spark, monkeypatch):
    from reverbtable.functions import scan as module
    monkeypatch.setattr(module.with_row_blocks, "__defaults__", (40, "_cut", 1))
    rng = np.random.default_rng(6)
    rows = [(int(k), 4.11 if k % 3 else float(rng.integers(1, 900)) / 7) for k in rng.permutation(900)]
    got = {r.rec_id: r.sheet_no for r in catalog.sheets(spark.createDataFrame(rows, "rec_id long, duration_s double"), "duration_s", "rec_id", 100).collect()}
    order = [k for k, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert got == {k: i // 100 for i, k in enumerate(order)}


def test_seeded_orders_with_small_and_large_keys(spark, monkeypatch):
    monkeypatch.setattr(sampling, "SLICE_ROWS", 50)
    rows = [("big", k) for k in range(700)] + [(f"k{k % 40}", 1000 + k) for k in range(200)]
    df = spark.createDataFrame(rows, "k string, i long").withColumn("w", F.col("i") % 7 + 1.0)
    got = sampling.shuffled_index(df, ["k"], "s", "i").collect()
    for key in {k for k, _ in rows}:
        mine = sorted((r.n, r.i) for r in got if r.k == key)
        assert [n for n, _ in mine] == list(range(len(mine)))
        assert [i for _, i in mine] == sorted((i for _, i in mine), key=lambda i: (hashlib.md5(f"s:{i}".encode()).hexdigest(), i))
    for keys in (["k"], []):
        ends = [r.cdf for r in sampling.cdf(df, keys, "w", "i").collect()]
        assert ends.count(1.0) == (41 if keys else 1) and all(0 < c <= 1 for c in ends)
