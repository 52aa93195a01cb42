"""File readers, sinks and streaming forms on files written by the test."""

import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reverbtable import schema
from reverbtable.sources import files, sinks
from reverbtable.streaming import live


def wav_bytes(data, fs=16000, extra=b""):
    pcm = np.asarray(data, "<i2")
    body = pcm.tobytes()
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, pcm.shape[1], fs, fs * pcm.shape[1] * 2, pcm.shape[1] * 2, 16)
    junk = b"LIST" + struct.pack("<I", len(extra)) + extra if extra else b""
    rest = b"WAVE" + fmt + junk + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(rest)) + rest


def test_wav_files(spark, tmp_path):
    data = (np.arange(50)[:, None] * [1, -2]).astype(int)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.wav").write_bytes(wav_bytes(data, extra=b"abcd"))
    (tmp_path / "a" / "bad.wav").write_bytes(b"nothing")
    (tmp_path / "note.txt").write_text("no")
    assert files.list_files(spark, str(tmp_path)).count() == 2
    meta = {r.path.rsplit("/", 1)[1]: r for r in files.wav_metadata(spark, str(tmp_path)).collect()}
    assert (meta["x.wav"].fs, meta["x.wav"].channels, meta["x.wav"].n_samples) == (16000, 2, 50)
    assert meta["x.wav"].duration_s == pytest.approx(50 / 16000) and meta["bad.wav"].duration_s is None
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.wav").write_bytes(wav_bytes(data))
    chunks = files.read_wav(spark, str(tmp_path / "b"), chunk=20).orderBy("ch", "chunk_no").collect()
    assert [(c.ch, c.t0, len(c.samples)) for c in chunks] == [(c, t, n) for c in (0, 1) for t, n in ((0, 20), (20, 20), (40, 10))]
    assert np.allclose(np.concatenate([c.samples for c in chunks if c.ch == 1]), data[:, 1] / 32768)


def test_text_tables(spark, tmp_path):
    cols = "year\tmonth\tday\thour\tminute\tsecond\tx\ty\tz\t" + "\t".join(f"rotation_{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3))
    (tmp_path / "pose.txt").write_text(cols + "\n2020\t1\t1\t1\t2\t3.5\t1\t2\t3" + "\t0" * 9 + "\n")
    r = files.read_tsv(spark, str(tmp_path / "pose.txt"), schema.POSE_TSV).withColumn("t", files.day_seconds()).first()
    assert r.t == 3723.5 and r.z == 3.0 and r.file.endswith("pose.txt")
    (tmp_path / "ace.csv").write_text("Mic config:, Room decode:, Room config:, Chan:, FB T60:, FB DRR:\nChromebook, Office_1, 1, 2, 0.4, 5.5\n")
    a = files.read_ace_labels(spark, str(tmp_path / "ace.csv")).first()
    assert (a.array, a.room, a.ch, a.t60, a.drr) == ("Chromebook", "Office_1", 2, 0.4, 5.5)
    (tmp_path / "m.kv").write_text("$EnvMicID 7\n$EnvDepth 3.5\nthree tokens here\n$EnvDepth 4.5\n")
    k = files.read_key_values(spark, str(tmp_path / "m.kv"), ["EnvMicID", "EnvDepth"]).first()
    assert (k.EnvMicID, k.EnvDepth) == ("7", "4.5")
    (tmp_path / "s.json").write_text('{\n "samplerate": 48000,\n "other": [1]\n}')
    assert files.read_session_json(spark, str(tmp_path / "s.json")).first().samplerate == 48000


def test_sinks(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("sig_id"), F.lit("train").alias("stage"), F.when(F.col("id") < 30, "big").otherwise("small").alias("corpus"))
    out = str(tmp_path / "sig")
    sinks.write_signals(df, out)
    assert sinks.read_back(spark, out).filter("corpus = 'small'").count() == 10
    assert 1 <= len(list((tmp_path / "sig" / "stage=train" / "corpus=big").glob("*.parquet"))) <= 8
    with pytest.raises(Exception, match="exists"):
        sinks.write_signals(df, out)
    sinks.write_signals(df.limit(5), out, overwrite=True)
    assert sinks.read_back(spark, out).count() == 5
    rirs = df.select(F.col("sig_id").alias("rir_id"), "corpus", F.lit("r1").alias("room"), F.lit("a").alias("array"))
    sinks.write_rirs(rirs, str(tmp_path / "rir"))
    assert sinks.read_back(spark, str(tmp_path / "rir")).count() == 40
    sinks.write_scenarios(df, {"seed": "1", "n": "40"}, str(tmp_path / "sc"))
    assert sinks.read_back(spark, str(tmp_path / "sc")).first().args == {"n": "40", "seed": "1"}
    sinks.write_report(df.limit(3), str(tmp_path / "rep"))
    assert spark.read.csv(str(tmp_path / "rep"), header=True).count() == 3


def drain(query):
    query.processAllAvailable()
    query.stop()


def stream_of(spark, tmp_path, rows):
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, "k string, ts timestamp, v double").coalesce(1).write.parquet(src)
    return spark.readStream.schema("k string, ts timestamp, v double").parquet(src)


def stamps(*minutes):
    import datetime as dt
    return [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m) for m in minutes]


def test_streams_equal_batch(spark, tmp_path):
    rows = [("a", t, float(i)) for i, t in enumerate(stamps(0, 5, 12, 900, 905))] + [("b", t, 2.0) for t in stamps(3, 400)]
    stream = stream_of(spark, tmp_path, rows)
    batch = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    for i, fn in enumerate((lambda d: live.block_energy(d, "k", "ts", "v"), lambda d: live.activity_sessions(d, "k", "ts", "2 hours"))):
        drain(fn(stream).writeStream.format("memory").queryName(f"out{i}").outputMode("complete").start())
        assert sorted(spark.table(f"out{i}").collect()) == sorted(fn(batch).collect())


def test_stream_smoother(spark, tmp_path):
    rows = [("a", t, float(v)) for t, v in zip(stamps(0, 1, 2, 3), (1, 2, 3, 4))]
    out = live.running_smoother(stream_of(spark, tmp_path, rows), "k", "ts", "v", 0.5)
    drain(out.writeStream.format("memory").queryName("smooth").outputMode("append").start())
    assert [r.smooth for r in spark.table("smooth").orderBy("t").collect()] == [1.0, 1.5, 2.25, 3.125]


def test_ingest_takes_new_files_once(spark, tmp_path):
    root, out, ck = tmp_path / "in", str(tmp_path / "cat"), str(tmp_path / "ck")
    root.mkdir()
    for n in (1, 2):
        (root / f"{n}.wav").write_bytes(b"x" * n)
        q = live.ingest(spark, str(root), out, ck)
        q.awaitTermination(60)
        assert spark.read.parquet(out).count() == n
        time.sleep(0.1)
