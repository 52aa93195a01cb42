"""Queries over long records as chunk rows and over WAV files read by byte range.

The chunk queries cut the clips of the tables smaller than a clip, so that every operator works across borders. The
file queries write the clips of ``embeddings`` as WAV files in the shared folder and read them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reverbtable.functions.arrays import rnd, total
from reverbtable.functions.draws import pick_index
from reverbtable.functions.scan import spread
from reverbtable.operators import chunks as C
from reverbtable.plans.book import Book
from reverbtable.plans.features import HOP, STFT, WIN
from reverbtable.plans.signals import CONV, TAPS
from reverbtable.session import shared_dir
from reverbtable.sources import tables as T, wav
from reverbtable.sources.tables import load, r, u, with_views

query = Book()
QUERIES, ORACLE = query.queries, query.oracle

SIZE = 10  # samples per chunk: shorter than a frame and than a response
PER_FILE = 64  # clips joined in one file


def samples(df, keys, size=SIZE, at=None):
    at = F.col("chunk_no") * size if at is None else at
    rows = df.select(*keys, at.alias("_at"), F.posexplode("samples").alias("_i", "_v"))
    return rows.select(*keys, (F.col("_at") + F.col("_i")).cast("int").alias("n"), rnd(F.col("_v")).alias("x"))


@query("convolve_chunked", with_views("rir mono", CONV + f"""
    SELECT sig_id, ch, (n + k)::INTEGER AS n, {r('sum(x*h)')} AS x FROM sx JOIN hp USING (pair_id) WHERE n + k < 64 GROUP BY ALL"""))
def convolve_chunked(spark, sf):
    """Every clip, cut in chunks, through the response of its pair, cut in blocks, by overlap-add."""
    keys = ["sig_id", "pair_id"]
    src = T.mono(spark, sf).withColumn("pair_id", F.floor(F.col("sig_id") / 2).cast("long"))
    out = C.convolve(C.cut(src, keys, "x", SIZE), T.rirs(spark, sf).select("pair_id", "ch", "h"), keys, ["pair_id"], SIZE)
    return samples(out, ["sig_id", "ch"])


def spectra(spark, sf):
    return C.stft(C.cut(T.signals(spark, sf), ["sig_id", "ch"], "x", SIZE), ["sig_id", "ch"], SIZE, WIN, HOP)


@query("stft_chunked", with_views("signal", STFT + f" SELECT sig_id, ch, frame, bin, {r('re')} AS re, {r('im')} AS im FROM st"))
def stft_chunked(spark, sf):
    """Spectra of clips in chunks; most frames span two or three of them."""
    rows = spectra(spark, sf).select("sig_id", "ch", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("_f", "_s"))
    bins = rows.select("sig_id", "ch", (F.col("frame") + F.col("_f")).cast("int").alias("frame"),
                       F.posexplode(F.arrays_zip("_s.re", "_s.im")).alias("bin", "_c"))
    return bins.select("sig_id", "ch", "frame", "bin", rnd(F.col("_c.re")).alias("re"), rnd(F.col("_c.im")).alias("im"))


@query("istft_chunked", with_views("signal", f"SELECT sig_id, ch, n, {r('x')} AS x FROM signal WHERE n >= 1 AND n < 32"))
def istft_chunked(spark, sf):
    """Forward and inverse transform by chunks return the signal (the first sample has window weight zero)."""
    back = C.istft(spectra(spark, sf), ["sig_id", "ch"], SIZE, WIN, HOP)
    return samples(back, ["sig_id", "ch"]).filter("n >= 1")


@query("resample_chunked", with_views("mono", f"""
    taps AS (SELECT i - 1 AS j, t[i] AS h FROM (SELECT {TAPS}::DOUBLE[] AS t), range(1, {len(TAPS) + 1}) q(i))
    SELECT sig_id, (k//2)::INTEGER AS n, {r('sum(x*h)')} AS x FROM (
      SELECT sig_id, n*3 + j - 30 AS k, x, h FROM mono, taps) WHERE k >= 0 AND k % 2 = 0 AND k < 192 GROUP BY ALL"""))
def resample_chunked(spark, sf):
    """Rate change by 3/2 of clips in chunks shorter than the filter."""
    out = C.resample(C.cut(T.mono(spark, sf), ["sig_id"], "x", SIZE), ["sig_id"], SIZE, 16000, 24000)
    return samples(out, ["sig_id"], at=F.col("t0"))


# ---- files ----------------------------------------------------------------------------------

def tracks(spark, sf):
    """Two-channel recordings of 64 clips each, end to end: file_id, n (frames), xs."""
    e = load(spark, sf, "embeddings")
    joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda s: s["embedding"]))
    rows = e.groupBy(F.floor(F.col("vec_id") / PER_FILE).cast("long").alias("file_id")).agg(joined.alias("v"))
    index = F.sequence(F.lit(0), (F.size("v") / 2).cast("int") - 1)

    def channel(c):
        return F.transform(index, lambda i: F.get("v", i * 2 + c).cast("double"))

    return rows.select("file_id", F.size(index).cast("long").alias("n"), F.array(channel(0), channel(1)).alias("xs"))


def folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/wav-{uuid.uuid4().hex}"


TRACK = f"""trk AS (SELECT vec_id // {PER_FILE} AS file_id, (dense_rank() OVER (PARTITION BY vec_id // {PER_FILE} ORDER BY vec_id) - 1) * 32 + (i - 1) // 2 AS n,
      (i - 1) % 2 AS ch, embedding[i]::DOUBLE AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)),
    len AS (SELECT file_id, max(n) + 1 AS n FROM trk GROUP BY 1)"""
WANTED = f"""wt AS (SELECT c_custkey AS idx, f.file_id, floor({u('wav:st', 'c_custkey')} * f.n)::BIGINT AS st FROM customer
      JOIN len f ON f.file_id = floor({u('wav:file', 'c_custkey')} * (SELECT count(*) FROM len))::BIGINT)"""


def wanted(spark, sf, files):
    """A file and a start drawn for every customer."""
    n = files.select(F.count(F.lit(1))).scalar()
    draws = load(spark, sf, "customer").select(F.col("c_custkey").alias("idx")).withColumn("file_id", pick_index(n, "wav:file", "idx"))
    rows = draws.join(files, "file_id").withColumn("st", pick_index(F.col("n"), "wav:st", "idx"))
    # draws are narrow and reading them is the work; those of a file lie in four parts
    rows = spread(rows, "file_id", F.col("idx") % 4)
    return rows.withColumn("ed", F.col("st") + 100)


@query("wav_ranges", f"""WITH {TRACK}, {WANTED}
    SELECT idx, t.ch::INTEGER AS ch, min(t.n) AS st, count(*) AS n, {r('sum(x)')} AS total, {r('sum(x * (t.n - st))', 4)} AS moment
    FROM wt JOIN trk t ON t.file_id = wt.file_id AND t.n >= st AND t.n < st + 100 GROUP BY idx, t.ch""")
def wav_ranges(spark, sf):
    """Ranges of 100 frames drawn from files, each read from its own bytes, 30 frames to a row; some end with the file."""
    root, rec = folder(spark), tracks(spark, sf)
    wav.write_wav(rec, root, F.col("file_id"), F.col("xs"), F.lit(16000))
    ask = wanted(spark, sf, rec.select("file_id", "n")).withColumn("path", F.format_string(f"{root}/%d.wav", "file_id"))
    rows = wav.read_ranges(ask.select("idx", "path", "st", "ed"), channels=[0, 1], piece=30)
    # sums of a piece stay in its row; only they meet
    parts = rows.select("idx", "t0", (F.col("t0") - F.col("st")).alias("_at"), F.posexplode("xs").alias("ch", "x")).where(F.size("x") > 0).select(
        "idx", "ch", "t0", "_at", F.size("x").alias("_n"), F.col("x").cast("array<double>").alias("x"))
    sums = parts.select("idx", "ch", "t0", "_n", total(F.col("x")).alias("_s"),
                        total(F.transform("x", lambda v, i: v * (F.col("_at") + i))).alias("_m"))
    return sums.groupBy("idx", "ch").agg(F.min("t0").alias("st"), F.sum("_n").alias("n"), rnd(F.sum("_s")).alias("total"),
                                         rnd(F.sum("_m"), 4).alias("moment"))


@query("wav_channel_files", f"""WITH {TRACK}, {WANTED},
    ses AS (SELECT file_id, trk.n, ch, x FROM trk JOIN len l USING (file_id) WHERE ch = 1 OR trk.n < l.n // 2)
    SELECT idx, st + 30 * ((t.n - st) // 30) AS t0, count(*) FILTER (ch = 0) AS n0, count(*) FILTER (ch = 1) AS n1,
      {r('coalesce(sum(x) FILTER (ch = 0), 0)')} AS total0, {r('coalesce(sum(x) FILTER (ch = 1), 0)')} AS total1
    FROM wt JOIN ses t ON t.file_id = wt.file_id AND t.n >= st AND t.n < st + 100 GROUP BY ALL""")
def wav_channel_files(spark, sf):
    """The same ranges from sessions of one file per channel, of which channel 0 ends half-way and channel 2 is missing."""
    root, rec = folder(spark), tracks(spark, sf)
    half = F.slice(F.col("xs")[0], F.lit(1), F.floor(F.col("n") / 2).cast("int"))
    files = rec.select("file_id", F.explode(F.array(F.struct(F.lit(0).alias("c"), half.alias("x")),
                                                    F.struct(F.lit(1).alias("c"), F.col("xs")[1].alias("x")))).alias("f"))
    wav.write_wav(files, root, F.format_string("s%d.CH%d", "file_id", "f.c"), F.array("f.x"), F.lit(16000))
    ask = wanted(spark, sf, rec.select("file_id", "n")).withColumn("path", F.format_string(f"{root}/s%d.CH0.wav", "file_id"))
    rows = wav.read_channel_files(ask, ["idx"], [0, 1, 2], piece=30)
    part = lambda c: F.coalesce(F.get("xs", F.lit(c)).cast("array<double>"), F.array().cast("array<double>"))
    return rows.where(F.get("xs", F.lit(2)).isNull()).select(
        "idx", "t0", *[F.size(part(c)).cast("long").alias(f"n{c}") for c in (0, 1)], *[rnd(total(part(c))).alias(f"total{c}") for c in (0, 1)])


@query("wav_chunks", f"""WITH {TRACK} SELECT file_id, (n // 500)::INTEGER AS chunk_no, ch::INTEGER AS ch, count(*) AS n, {r('sum(x)')} AS total
    FROM trk WHERE ch = 1 AND n >= 500 GROUP BY ALL""")
def wav_chunks(spark, sf):
    """Whole files as chunk rows from partitions of 2 kB, by the data source, one channel from the second chunk on."""
    root = folder(spark)
    wav.write_wav(tracks(spark, sf), root, F.col("file_id"), F.col("xs"), F.lit(16000))
    rows = wav.read_chunks(spark, root, 500, 2048).where("ch = 1 AND t0 >= 500 AND error IS NULL")
    return rows.select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("file_id"), "chunk_no", "ch",
                       F.size("samples").cast("long").alias("n"), rnd(total(F.col("samples").cast("array<double>"))).alias("total"))


@query("wav_catalogue", f"""WITH {TRACK} SELECT file_id, 2::BIGINT AS channels, 16000::BIGINT AS fs, n AS n_samples, {r('n / 16000.0::DOUBLE')} AS duration_s FROM len""")
def wav_catalogue(spark, sf):
    """Listing of written files with rate, channels and duration from their heads."""
    from reverbtable.sources import files
    root = folder(spark)
    wav.write_wav(tracks(spark, sf), root, F.concat(F.col("file_id") % 7, F.lit("/"), F.col("file_id")), F.col("xs"), F.lit(16000))
    m = files.wav_metadata(spark, root)
    return m.select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("file_id"), "channels", "fs", "n_samples", rnd(F.col("duration_s")).alias("duration_s"))
