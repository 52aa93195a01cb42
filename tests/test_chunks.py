"""Long records as chunk rows against the same in one row, and WAV files by byte range."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from reverbtable.functions import kernels as K
from reverbtable.operators import chunks as C
from reverbtable.sources import files, wav

RNG = np.random.default_rng(11)


def chunked(spark, records, size):
    df = spark.createDataFrame([(k, list(map(float, x))) for k, x in records.items()], "k long, x array<double>")
    return C.cut(df, ["k"], "x", size)


def joined(rows, key="k", at=lambda r: r.chunk_no):
    out = {}
    for r in sorted(rows, key=at):
        out.setdefault(r[key] if isinstance(key, str) else tuple(r[c] for c in key), []).extend(r.samples)
    return out


RECORDS = {1: RNG.normal(size=203), 2: RNG.normal(size=1), 3: RNG.normal(size=64), 4: RNG.normal(size=15), 5: RNG.normal(size=500)}


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_halo(spark, size):
    for left, right in ((0, 0), (3, 0), (0, 9), (20, 70)):
        for r in C.with_halo(chunked(spark, RECORDS, size), ["k"], size, left, right).collect():
            x, at = RECORDS[r.k], r.chunk_no * size
            lo, hi = max(0, at - left), min(len(x), at + size + right)
            assert (r.t0, r.n) == (lo, min(size, len(x) - at)) and np.array_equal(r.samples, x[lo:hi])


@pytest.mark.parametrize("size", [3, 20, 1000])
def test_convolution_by_chunks(spark, size):
    taps = {(1, 0): RNG.normal(size=50), (1, 1): RNG.normal(size=7), (2, 0): RNG.normal(size=9), (3, 0): RNG.normal(size=200), (5, 0): np.ones(1)}
    hs = spark.createDataFrame([(k, c, list(map(float, h))) for (k, c), h in taps.items()], "k long, ch int, h array<double>")
    got = joined(C.convolve(chunked(spark, RECORDS, size), hs, ["k"], ["k"], size).collect(), ("k", "ch"))
    assert got.keys() == taps.keys()
    for (k, c), y in got.items():
        assert np.allclose(y, np.convolve(RECORDS[k], taps[k, c])[:len(RECORDS[k])])


@pytest.mark.parametrize("size", [1, 5, 16, 33, 1000])
def test_transforms_by_chunks(spark, size):
    win, hop = 16, 6
    rows = C.stft(chunked(spark, RECORDS, size), ["k"], size, win, hop)
    found = {}
    for r in rows.collect():
        for f, (a, b) in enumerate(zip(r.re, r.im)):
            assert (r.k, r.frame + f) not in found
            found[r.k, r.frame + f] = np.array(a) + 1j * np.array(b)
    want = {(k, f): s for k, x in RECORDS.items() for f, s in enumerate(K._stft(x, win, hop, K.hann(win)))}
    assert found.keys() == want.keys() and all(np.allclose(found[k], want[k]) for k in want)
    back = joined(C.istft(rows, ["k"], size, win, hop).collect())
    for k in (1, 3, 5):
        n = len(back[k])
        assert n == (len(RECORDS[k]) - win) // hop * hop + win and np.allclose(back[k][1:], RECORDS[k][1:n])


@pytest.mark.parametrize("rates", [(48000, 16000), (44100, 16000), (16000, 24000), (16000, 44100), (8000, 8000)])
@pytest.mark.parametrize("size", [5, 40, 1000])
def test_resampling_by_chunks(spark, rates, size):
    rows = C.resample(chunked(spark, RECORDS, size), ["k"], size, *rates).collect()
    got = joined(rows)
    for k, x in RECORDS.items():
        df = spark.createDataFrame([(list(map(float, x)),)], "x array<double>")
        whole = df.select(K.resample(*rates)(F.col("x")).alias("y")).first().y
        assert np.allclose(got[k], whole)
        assert [r.t0 for r in sorted(rows, key=lambda r: r.chunk_no) if r.k == k][0] == 0


def test_filter_bank_stays_small():
    import tracemalloc
    x = RNG.normal(size=4 * 44100)
    bank = K.PolyphaseBank(160, 441)
    tracemalloc.start()
    y = bank.outputs(x, 0, 0, 64000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(y) == 64000 and peak < 12 * 8 * (len(x) + len(y))


def sparse_wav(path, seconds, fs=48000, channels=4, rf64=False):
    """A file of zeros of which the disk holds next to nothing, with a ramp in its last second."""
    frames = fs * seconds
    size = frames * channels * 2
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, fs, fs * channels * 2, channels * 2, 16)
    if rf64:
        head = b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + struct.pack("<4sIQQQI", b"ds64", 28, size + 100, size, frames, 0)
        head += fmt + struct.pack("<4sI", b"data", 0xFFFFFFFF)
    else:
        head = b"RIFF" + struct.pack("<I", size + 36) + b"WAVE" + fmt + struct.pack("<4sI", b"data", size)
    ramp = np.arange(fs, dtype="<i2")[:, None] * np.array([0, 1, 0, -1], "<i2")
    with open(path, "wb") as f:
        f.write(head)
        f.seek(len(head) + size - ramp.nbytes)
        f.write(ramp.astype("<i2").tobytes())
    return frames


@pytest.mark.parametrize("rf64,seconds", [(False, 7000), (True, 12000)])
def test_files_beyond_two_and_four_gigabytes(spark, tmp_path, rf64, seconds):
    path = tmp_path / "long.wav"
    frames = sparse_wav(path, seconds, rf64=rf64)
    assert path.stat().st_size > (4 << 30 if rf64 else 2 << 30)
    file = wav.Ranged(str(path))
    assert wav.read_head(file).frames == frames and file.count < 200
    meta = files.wav_metadata(spark, str(tmp_path)).first()
    assert (meta.n_samples, meta.duration_s, meta.channels, meta.error) == (frames, seconds, 4, None)
    ask = spark.createDataFrame([(str(path), frames - 48000 + 10, frames - 48000 + 260), (str(path), frames - 5, frames + 5)], "path string, st long, ed long")
    rows = sorted(wav.read_ranges(ask, channels=[3, 1, 9], piece=100).collect(), key=lambda r: (r.st, r.t0))
    assert [len(r.xs[0]) for r in rows] == [100, 100, 50, 5] and all(r.xs[2] is None for r in rows)
    assert np.allclose(rows[0].xs[1], np.arange(10, 110) / 32768) and np.allclose(rows[0].xs[0], -np.arange(10, 110) / 32768)
    assert sum(r.read_bytes for r in rows) == 8 * 255  # no other bytes of samples are read


def test_chunk_source(spark, tmp_path):
    data = {"a/x": RNG.normal(size=(2, 50)), "b/y": RNG.normal(size=(1, 7)), "none": np.zeros((1, 0))}
    df = spark.createDataFrame([(n, [list(map(float, c)) for c in v]) for n, v in data.items()], "n string, xs array<array<double>>")
    assert wav.write_wav(df, str(tmp_path), F.col("n"), F.col("xs"), F.lit(8000)) == 3
    assert wav.write_wav(df, str(tmp_path), F.col("n"), F.col("xs"), F.lit(8000)) == 3  # again: the same files
    (tmp_path / "bad.wav").write_bytes(b"RIFFshort")
    assert len(list(tmp_path.rglob("*.*"))) == 4
    for split in (10, 64, 1 << 20):
        rows = wav.read_chunks(spark, str(tmp_path), 20, split).collect()
        assert [r.error for r in rows if r.error] == ["no format and data chunk"]
        for n, v in data.items():
            mine = [r for r in rows if r.path.endswith(f"{n}.wav")]
            assert sorted((r.ch, r.t0, r.chunk_no) for r in mine) == sorted((c, t, t // 20) for c in range(len(v)) for t in range(0, v.shape[1], 20))
            for r in mine:
                assert np.allclose(r.samples, v[r.ch, r.t0:r.t0 + 20].astype(np.float32))
    some = wav.read_chunks(spark, str(tmp_path), 20, 64).where("ch = 1 AND t0 >= 20 AND path LIKE '%x.wav'")
    assert sorted((r.ch, r.t0) for r in some.collect()) == [(1, 20), (1, 40)]


def test_pushed_filters_leave_bytes_unread(tmp_path, monkeypatch):
    sparse_wav(tmp_path / "one.wav", 4)
    (tmp_path / "other.wav").write_bytes(b"")
    reader = wav.PushedReader({"path": str(tmp_path), "chunk": "48000", "split": "300000"})
    asked = []
    monkeypatch.setattr(wav, "frames_of", lambda file, head, st, ed, real=wav.frames_of: asked.append((st, ed)) or real(file, head, st, ed))
    left = list(reader.pushFilters([wav.EqualTo(("ch",), 1), wav.GreaterThanOrEqual(("t0",), 96000), wav.LessThan(("t0",), 144000),
                                    wav.EqualTo(("path",), str(tmp_path / "one.wav"))]))
    parts = reader.partitions()
    rows = [b for p in parts for b in reader.read(p)]
    assert len(left) == 4 and len(parts) == 6 and asked == [(96000, 144000)] and [b.num_rows for b in rows] == [1]


def test_sessions_of_channel_files(spark, tmp_path):
    lengths = {("s1", 0): 50, ("s1", 1): 35, ("s1", 2): 50, ("s2", 0): 10, ("s2", 2): 45}
    x = {k: RNG.normal(size=n).astype(np.float32) for k, n in lengths.items()}
    df = spark.createDataFrame([(f"{s}.CH{c}", [list(map(float, v))]) for (s, c), v in x.items()], "n string, xs array<array<double>>")
    wav.write_wav(df, str(tmp_path), F.col("n"), F.col("xs"), F.lit(8000))
    rows = {(r.session, r.t0): r.xs for r in wav.by_session(wav.read_chunks(spark, str(tmp_path), 20), r"([^/]+)\.CH(\d+)\.wav$", [0, 1, 2]).collect()}
    assert set(rows) == {(s, t) for s, n in (("s1", 50), ("s2", 45)) for t in range(0, n, 20)}
    for (s, t), xs in rows.items():
        for c in range(3):
            want = x.get((s, c), np.zeros(0))[t:t + 20]
            assert (xs[c] is None and not len(want)) or np.array_equal(np.array(xs[c], np.float32), want)
    ask = spark.createDataFrame([(1, str(tmp_path / "s1.CH0.wav"), 5, 48), (2, str(tmp_path / "s2.CH0.wav"), 5, 48), (3, str(tmp_path / "gone.CH0.wav"), 0, 9)],
                                "id long, path string, st long, ed long")
    got = {(r.id, r.t0): r.xs for r in wav.read_channel_files(ask, ["id"], [0, 2, 1], piece=20).collect()}
    assert set(got) == {(1, 5), (1, 25), (1, 45), (2, 5), (2, 25)}
    assert [len(v) if v else None for v in got[1, 25]] == [20, 20, 10] and [len(v) if v else None for v in got[2, 5]] == [5, 20, None]


def test_wav_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert wav.read_chunks(spark, str(tmp_path / "in")).count() == 0 and files.wav_metadata(spark, str(tmp_path / "in")).count() == 0
    ask = spark.createDataFrame([(None, 0, 5), (str(tmp_path / "no.wav"), 0, 5)], "path string, st long, ed long")
    assert all(r.error and r.xs is None for r in wav.read_ranges(ask).collect())


def counting(path, real):
    """_opened that leaves a byte in a file each time."""
    def opened(p):
        with open(path, "ab") as f:
            f.write(b".")
        return real(p)
    return opened


def test_files_open_once_for_ranges_in_any_order(spark, tmp_path, monkeypatch):
    x = {k: RNG.normal(size=(2, 90)).astype(np.float32) for k in range(3)}
    df = spark.createDataFrame([(k, [list(map(float, c)) for c in v]) for k, v in x.items()], "n long, xs array<array<double>>")
    wav.write_wav(df, str(tmp_path), F.col("n"), F.col("xs"), F.lit(8000))
    monkeypatch.setattr(wav, "_opened", counting(tmp_path / "opened", wav._opened))
    monkeypatch.setattr(wav, "HELD", 500, raising=False)  # several batches
    ask = spark.range(300, numPartitions=1).select(
        "id", F.concat(F.lit(f"{tmp_path}/"), F.col("id") % 4, F.lit(".wav")).alias("path"), (F.col("id") % 89).alias("st"), (F.col("id") % 89 + 25).alias("ed"))
    rows = wav.read_ranges(ask, channels=[1, 7, 0], piece=20).collect()
    assert (tmp_path / "opened").stat().st_size == 4  # three files and one that is missing
    assert sorted((r.id, r.t0) for r in rows) == sorted((k, k % 89 + d) for k in range(300) for d in (0, 20))
    for r in rows:
        if r.id % 4 == 3:
            assert r.error and r.xs is None and r.fs is None and r.read_bytes == 0
            continue
        want = x[r.id % 4][:, r.t0:min(r.t0 + 20, r.ed)]
        assert r.error is None and r.fs == 8000 and r.read_bytes == want.nbytes and r.xs[1] is None
        assert np.array_equal(np.array([r.xs[2], r.xs[0]], np.float32), want)


def test_channel_files_meet_without_a_shuffle(spark, tmp_path):
    x = {(s, c): RNG.normal(size=n).astype(np.float32) for s, c, n in ((0, 0, 60), (0, 1, 30), (1, 0, 25), (2, 1, 50))}
    df = spark.createDataFrame([(f"s{s}.CH{c}", [list(map(float, v))]) for (s, c), v in x.items()], "n string, xs array<array<double>>")
    wav.write_wav(df, str(tmp_path), F.col("n"), F.col("xs"), F.lit(8000))
    ask = spark.range(120).select("id", F.concat(F.lit(f"{tmp_path}/s"), F.col("id") % 3, F.lit(".CH0.wav")).alias("path"),
                                  (F.col("id") % 40).alias("st"), (F.col("id") % 40 + 30).alias("ed"))
    got = wav.read_channel_files(ask, ["id"], [0, 1], piece=20)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {}
    for k in range(120):
        for t in (k % 40, k % 40 + 20):
            xs = [x.get((k % 3, c), np.zeros(0, np.float32))[t:min(t + 20, k % 40 + 30)] for c in (0, 1)]
            if any(len(v) for v in xs):
                want[k, t] = ([v.tolist() if len(v) else None for v in xs], 8000, 4 * sum(map(len, xs)))
    assert {(r.id, r.t0): (r.xs, r.fs, r.read_bytes) for r in got.collect()} == want


def test_many_small_ranges_share_partitions(spark, tmp_path):
    data = RNG.normal(size=(60, 2, 50))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(data)], "n long, xs array<array<double>>")
    wav.write_wav(df, str(tmp_path), F.col("n"), F.col("xs"), F.lit(8000))
    (tmp_path / "bad.wav").write_bytes(b"RIFFshort")
    rows = wav.read_chunks(spark, str(tmp_path), 20, 64)  # seven ranges to a file
    assert rows.rdd.getNumPartitions() <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.collect()
    assert [r.error for r in rows if r.error] == ["no format and data chunk"]
    got = sorted((int(r.path.rsplit("/", 1)[1][:-4]), r.ch, r.t0, tuple(r.samples)) for r in rows if not r.error)
    assert got == sorted((k, c, t, tuple(v[c, t:t + 20].astype(np.float32).tolist())) for k, v in enumerate(data) for c in (0, 1) for t in (0, 20, 40))
