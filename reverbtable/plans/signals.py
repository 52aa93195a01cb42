"""Signal-building queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reverbtable.functions import arrays as A, kernels as K
from reverbtable.functions.arrays import rnd
from reverbtable.functions.draws import pick_index, uniform
from reverbtable.operators import dsp as S, rir as R
from reverbtable.operators.sampling import shuffled_index
from reverbtable.plans.book import Book
from reverbtable.plans.timeline import clips
from reverbtable.sources import tables as T
from reverbtable.sources.tables import FS_RIR, load, r, u, with_views

query = Book()
QUERIES, ORACLE = query.queries, query.oracle


def long_rows(df, key, xs="xs", digits=6, name="x"):
    by_ch = df.select(key, F.posexplode(xs).alias("ch", "_x"))
    return by_ch.select(key, "ch", F.posexplode("_x").alias("n", "_v")).select(key, "ch", "n", rnd(F.col("_v"), digits).alias(name))


@query("power", with_views("signal", f"""SELECT sig_id, {r('avg(p)', 9)} AS power, {r('max(m)', 9)} AS peak FROM (
    SELECT sig_id, ch, sum(x*x)/count(*) AS p, max(abs(x)) AS m FROM signal GROUP BY ALL) GROUP BY 1"""))
def power(spark, sf):
    return clips(spark, sf).select("sig_id", rnd(S.mean_power(F.col("xs")), 9).alias("power"), rnd(S.peak(F.col("xs")), 9).alias("peak"))


@query("peak_norm", with_views("signal", f"""SELECT sig_id, ch, n, {r('x / max(abs(x)) OVER (PARTITION BY sig_id) * 0.9')} AS x FROM signal"""))
def peak_norm(spark, sf):
    return long_rows(clips(spark, sf).withColumn("xs", S.peak_normalise(F.col("xs"))), "sig_id")


@query("snr_mix", with_views("signal", f"""
    nz AS (SELECT sig_id, ch, n, -x*x + 0.01 AS v FROM signal),
    pw AS (SELECT sig_id, avg(x*x) AS ps FROM signal GROUP BY 1), pn AS (SELECT sig_id, avg(v*v) AS pn FROM nz GROUP BY 1)
    SELECT sig_id, ch, n, {r("x + v*sqrt(ps/pow(10, snr/10))/(sqrt(pn) + 1e-10)")} AS x
    FROM signal JOIN nz USING (sig_id, ch, n) JOIN pw USING (sig_id) JOIN pn USING (sig_id)
    JOIN (SELECT vec_id AS sig_id, 15 + 15*{u('snr', 'vec_id')} AS snr FROM embeddings) USING (sig_id)"""))
def snr_mix(spark, sf):
    noise = F.transform("xs", lambda x: F.transform(x, lambda v: -v * v + 0.01))
    df = clips(spark, sf).withColumn("noise", noise)
    snr = 15 + 15 * uniform("snr", "sig_id")
    return long_rows(df.select("sig_id", S.snr_mix(F.col("xs"), F.col("noise"), snr).alias("xs")), "sig_id")


CONV = """hp AS (SELECT pair_id, ch, n AS k, h FROM rir), sx AS (SELECT sig_id // 2 AS pair_id, sig_id, n, x FROM mono)"""


@query("convolve", with_views("rir mono", CONV + f"""
    SELECT sig_id, ch, (n + k)::INTEGER AS n, {r('sum(x*h)')} AS x FROM sx JOIN hp USING (pair_id) WHERE n + k < 64 GROUP BY ALL"""))
def convolve(spark, sf):
    """Every clip through the two-channel response of its pair, by FFT."""
    hs = S.to_records(T.rirs(spark, sf).withColumnRenamed("h", "x"), "pair_id")
    src = T.mono(spark, sf).select("sig_id", F.floor(F.col("sig_id") / 2).cast("long").alias("pair_id"), "x")
    out = src.join(hs, "pair_id").select("sig_id", S.convolve(F.col("x"), F.col("xs")).alias("xs"))
    return long_rows(out, "sig_id")


@query("convolve_table", with_views("rir mono", f"""
    SELECT m.sig_id, rir.ch, (m.n + rir.n)::INTEGER AS n, {r('sum(x*h)')} AS x FROM mono m JOIN rir ON rir.rir_id = m.sig_id
    WHERE m.n + rir.n < 64 GROUP BY ALL"""))
def convolve_table(spark, sf):
    """Convolution by join and sum: every clip with the response of the same number."""
    src = T.mono(spark, sf).select("sig_id", F.posexplode("x").alias("n", "x"))
    taps = T.rirs(spark, sf).select(F.col("rir_id").alias("sig_id"), "ch", F.posexplode("h").alias("k", "h"))
    return S.convolve_table(src, taps, "sig_id").select("sig_id", "ch", "n", rnd(F.col("y")).alias("x"))


@query("add_sources", with_views("signal", f"""SELECT a.sig_id, a.ch, a.n, {r('a.x + b.x*b.x', 9)} AS x FROM signal a JOIN signal b USING (sig_id, ch, n)"""))
def add_sources(spark, sf):
    squares = F.transform("xs", lambda x: F.transform(x, lambda v: v * v))
    out = clips(spark, sf).withColumn("two", F.array(F.col("xs"), squares)).select("sig_id", S.add_sources(F.col("two")).alias("xs"))
    return long_rows(out, "sig_id", digits=9)


@query("mean_free", with_views("mono", f"""SELECT sig_id, n, {r('x - avg(x) OVER (PARTITION BY sig_id)', 9)} AS x FROM mono"""))
def mean_free(spark, sf):
    return (T.mono(spark, sf).select("sig_id", F.posexplode(S.mean_free(F.col("x"))).alias("n", "v"))
            .select("sig_id", "n", rnd(F.col("v"), 9).alias("x")))


@query("pad_crop", with_views("mono", f"""
    c AS (SELECT vec_id AS sig_id, floor({u('pad', 'vec_id')} * (256 - 150 + 1))::BIGINT AS st FROM embeddings)
    SELECT sig_id, n::INTEGER AS n, {r('x', 9)} AS x FROM (SELECT sig_id, st, unnest(range(0,150)) AS n FROM c) q
    JOIN (SELECT sig_id AS s, n AS m, x FROM mono) ON s = sig_id AND m = (st + n) % 64"""))
def pad_crop(spark, sf):
    return (T.mono(spark, sf).select("sig_id", F.posexplode(S.pad_crop(F.col("x"), 150, uniform("pad", "sig_id"))).alias("n", "v"))
            .select("sig_id", "n", rnd(F.col("v"), 9).alias("x")))


@query("active_power", with_views("mono", f"""
    p AS (SELECT sig_id, f, sum(x*x)/16 AS p FROM mono, range(0,7) t(f) WHERE n >= f*8 AND n < f*8+16 GROUP BY ALL)
    SELECT sig_id, {r('avg(p)', 9)} AS power FROM (SELECT *, max(p) OVER (PARTITION BY sig_id) AS mx FROM p) WHERE p > 0.5*mx GROUP BY 1"""))
def active_power(spark, sf):
    return T.mono(spark, sf).select("sig_id", rnd(S.active_power(F.col("x"), 16, 8, 0.5), 9).alias("power"))


TAPS = [float(v) for v in K.resample_taps(3, 2)]


@query("resample", with_views("mono", f"""
    taps AS (SELECT i - 1 AS j, t[i] AS h FROM (SELECT {TAPS}::DOUBLE[] AS t), range(1, {len(TAPS) + 1}) q(i))
    SELECT sig_id, (k//2)::INTEGER AS n, {r('sum(x*h)')} AS x FROM (
      SELECT sig_id, n*3 + j - 30 AS k, x, h FROM mono, taps) WHERE k >= 0 AND k % 2 = 0 AND k < 192 GROUP BY ALL"""))
def resample(spark, sf):
    """Rate change by 3/2."""
    out = T.mono(spark, sf).select("sig_id", K.resample(16000, 24000)(F.col("x")).alias("x"))
    return out.select("sig_id", F.posexplode("x").alias("n", "v")).select("sig_id", "n", rnd(F.col("v")).alias("x"))


@query("envelope", with_views("mono", f"""
    k AS (SELECT sig_id, f, sum(x*cos(2*pi()*f*n/64)) AS a, -sum(x*sin(2*pi()*f*n/64)) AS b FROM mono, range(0,33) t(f) GROUP BY ALL),
    g AS (SELECT sig_id, m, sum(g*(a*cos(2*pi()*f*m/64) - b*sin(2*pi()*f*m/64)))/64 AS re, sum(g*(a*sin(2*pi()*f*m/64) + b*cos(2*pi()*f*m/64)))/64 AS im
      FROM (SELECT *, CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END AS g FROM k), range(0,64) q(m) GROUP BY ALL)
    SELECT sig_id, m::INTEGER AS n, {r('sqrt(re*re + im*im)')} AS x FROM g"""))
def envelope(spark, sf):
    out = T.mono(spark, sf).select("sig_id", F.posexplode(K.envelope()(F.col("x"))).alias("n", "v"))
    return out.select("sig_id", "n", rnd(F.col("v")).alias("x"))


@query("select_range", with_views("signal", f"""SELECT sig_id, ch, {r('sum(x)', 9)} AS total, count(*) AS n FROM signal WHERE n >= 4 AND n < 20 GROUP BY ALL"""))
def select_range(spark, sf):
    df = S.select_range_all(T.signals(spark, sf), ["x"], 4, 20)
    return df.select("sig_id", "ch", rnd(A.total(F.col("x")), 9).alias("total"), F.size("x").cast("long").alias("n"))


@query("ranged_read", f"""WITH rg AS (SELECT doc_id, text, n, CASE WHEN n > 400 THEN floor({u('3:crop', 'doc_id')} * (n - 400 + 1))::BIGINT ELSE 0 END AS st
      FROM (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0))
    SELECT doc_id AS rec_id, count(*) AS n, sum(unicode(c))::DOUBLE AS total FROM (
      SELECT doc_id, unnest(string_split(substring(text, st + 1, least(400, n)), '')) AS c FROM rg) WHERE c <> '' GROUP BY 1""")
def ranged_read(spark, sf):
    """A drawn range of 400 samples from the chunked sample table of every document."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("rec_id"), "text")
    n = F.length("text")
    st = F.when(n > 400, F.floor(uniform("3:crop", "rec_id") * (n - 400 + 1))).otherwise(0).cast("long")
    got = S.ranged_read_in_row(d.filter(n > 0), "rec_id", "text", st, st + F.least(F.lit(400), n), 1024)
    return got.groupBy("rec_id").agg(F.sum(F.size("samples")).cast("long").alias("n"), F.sum(A.total(F.col("samples"))).alias("total"))


@query("concat_in_time", """SELECT source AS device, doc_id AS clip, chunk_no::INTEGER AS chunk_no,
      (coalesce(sum(len) OVER (PARTITION BY source ORDER BY doc_id, chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS t0
    FROM (SELECT *, least(1024, n - chunk_no*1024) AS len FROM (
      SELECT source, doc_id, length(text) AS n, unnest(range(0, (length(text) + 1023) // 1024)) AS chunk_no FROM documents))""")
def concat_in_time(spark, sf):
    """Clips of a device laid end to end: chunks keep their rows and get an offset."""
    ch = S.chunk_lengths(load(spark, sf, "documents").select("doc_id", F.col("source").alias("device"), "text"), "text", 1024)
    out = S.concat_in_time(ch, "device", ["doc_id", "chunk_no"], F.floor(F.col("doc_id") / 4096).cast("long"))
    return out.select("device", F.col("doc_id").alias("clip"), "chunk_no", "t0")


@query("noise_parts", with_views("mono", f"""SELECT sig_id, (n // 16)::INTEGER AS ch, {r('sum(x*x)', 9)} AS energy FROM mono GROUP BY ALL"""))
def noise_parts(spark, sf):
    """One clip cut into four independent channels."""
    out = T.mono(spark, sf).select("sig_id", F.posexplode(S.split_parts(F.col("x"), 4, 16)).alias("ch", "x"))
    return out.select("sig_id", "ch", rnd(A.energy(F.col("x")), 9).alias("energy"))


NOISE = f"""ns AS (SELECT vec_id AS noise_id, label AS array_id FROM embeddings WHERE vec_id % 5 > 0 AND label % 4 > 0),
    ls AS (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY md5('n:list:' || noise_id), noise_id) - 1 AS pos, count(*) OVER (PARTITION BY array_id) AS c FROM ns),
    ht AS (SELECT vec_id AS rir_id, noise_id, CASE WHEN noise_id % 2 = 0 THEN 16000 ELSE 24000 END AS fs,
             CASE WHEN noise_id % 2 = 0 THEN 20 ELSE 30 END AS want FROM embeddings LEFT JOIN ls ON ls.array_id = label AND pos = floor({u('n', 'vec_id')}*c)::BIGINT),
    cr AS (SELECT rir_id, fs, ch, n - st AS n, x FROM (SELECT *, floor({u('n:crop', 'rir_id')} * (32 - want + 1))::BIGINT AS st FROM ht) q
           JOIN signal ON sig_id = noise_id WHERE n >= st AND n < st + want),
    taps AS (SELECT i - 1 AS j, t[i] AS h FROM (SELECT {TAPS}::DOUBLE[] AS t), range(1, {len(TAPS) + 1}) q(i))"""


@query("response_noise", with_views("signal", NOISE + f"""
    SELECT rir_id, ch::INTEGER AS ch, n::INTEGER AS n, {r('x')} AS x FROM (
      SELECT rir_id, ch, n, x FROM cr WHERE fs = 24000 UNION ALL
      SELECT rir_id, ch, k // 2, sum(x*h) FROM (SELECT rir_id, ch, n*3 + j - 30 AS k, x, h FROM cr, taps WHERE fs = 16000) WHERE k >= 0 AND k % 2 = 0 AND k < 60 GROUP BY ALL UNION ALL
      SELECT rir_id, ch, n, 0.0 FROM ht, range(0,2) a(ch), range(0,30) b(n) WHERE noise_id IS NULL)"""))
def response_noise(spark, sf):
    """A drawn crop of a clip of the response's array, at 24 kHz whatever the clip's rate; zeros for arrays without."""
    from reverbtable.operators.sampling import match_one
    e = load(spark, sf, "embeddings")
    rirs = e.select(F.col("vec_id").alias("rir_id"), F.col("label").alias("array_id"))
    noise = rirs.where("rir_id % 5 > 0 AND array_id % 4 > 0").withColumnRenamed("rir_id", "noise_id")
    hit = match_one(rirs, noise, ["array_id"], "rir_id", "noise_id", "n").join(
        clips(spark, sf).withColumnRenamed("sig_id", "noise_id"), "noise_id", "left")
    hit = hit.withColumn("noise_fs", F.when(F.col("noise_id") % 2 == 0, 16000).otherwise(24000))
    out = S.response_noise(hit, "xs", "noise_fs", [16000, 24000], 24000, 30 / 24000, 2, "n:crop", "rir_id")
    return long_rows(out.select("rir_id", "noise"), "rir_id", "noise")


BABBLE = f"""ls AS (SELECT vec_id AS utt, row_number() OVER (ORDER BY md5('babble:list:' || vec_id), vec_id) - 1 AS pos, count(*) OVER () AS c FROM embeddings),
  dr AS (SELECT vec_id AS sig_id, ch, voice, {u('babble', 'vec_id', 'ch', 'voice')} AS u, floor({u('babble:crop', 'vec_id', 'ch', 'voice')} * (64 - 40 + 1))::BIGINT AS st
         FROM embeddings, range(0,2) a(ch), range(0,10) b(voice)),
  cr AS (SELECT d.sig_id, d.ch, d.voice, m.n - st AS n, m.x FROM dr d JOIN ls ON ls.pos = floor(u*c)::BIGINT JOIN mono m ON m.sig_id = ls.utt AND m.n >= st AND m.n < st + 40)"""


@query("babble", with_views("mono", BABBLE + f""" SELECT sig_id, ch::INTEGER AS ch, n::INTEGER AS n, {r('sum(x)')} AS x FROM (
    SELECT sig_id, ch, n, x - avg(x) OVER (PARTITION BY sig_id, ch, voice) AS x FROM cr) GROUP BY ALL"""))
def babble(spark, sf):
    m = T.mono(spark, sf)
    out = S.babble(m, "sig_id", m.select(F.col("sig_id").alias("utt"), "x"), "utt", 40)
    return out.select("sig_id", "ch", F.posexplode("x").alias("n", "v")).select("sig_id", "ch", "n", rnd(F.col("v")).alias("x"))


HALF = int(FS_RIR * R.DP_HALF_MS / 1000)
DRAWS = f"""ix AS (SELECT vec_id, row_number() OVER (ORDER BY md5('t:src:' || vec_id), vec_id) - 1 AS ks,
      row_number() OVER (ORDER BY md5('t:noise:' || vec_id), vec_id) - 1 AS kn, count(*) OVER () AS c FROM embeddings),
  px AS (SELECT pair_id, row_number() OVER (ORDER BY md5('t:rir:' || pair_id), pair_id) - 1 AS kr, count(*) OVER () AS c FROM (SELECT DISTINCT vec_id // 2 AS pair_id FROM embeddings)),
  dr AS (SELECT c_custkey AS idx, 15 + 15*{u('t:snr', 'c_custkey')} AS snr, a.vec_id AS src, b.vec_id AS noise, p.pair_id FROM customer
      JOIN ix a ON a.ks = floor({u('t:ksrc', 'c_custkey')}*a.c)::BIGINT JOIN ix b ON b.kn = floor({u('t:knoise', 'c_custkey')}*b.c)::BIGINT
      JOIN px p ON p.kr = floor({u('t:krir', 'c_custkey')}*p.c)::BIGINT),
  wet AS (SELECT idx, rir.ch, m.n + rir.n AS n, sum(m.x*h) AS x, sum(CASE WHEN abs(rir.n - nd) <= {HALF} THEN m.x*h ELSE 0 END) AS dp
      FROM dr JOIN mono m ON m.sig_id = src JOIN rir USING (pair_id) JOIN rir_peak USING (rir_id) WHERE m.n + rir.n < 64 GROUP BY ALL),
  nz AS (SELECT idx, ch, n + 32*q AS n, x AS v FROM dr JOIN signal ON sig_id = noise, range(0,2) t(q)),
  mx AS (SELECT w.idx, w.ch, w.n, w.x + v*sqrt(avg(dp*dp) OVER s / pow(10, snr/10))/(sqrt(avg(v*v) OVER s) + 1e-10) AS x, dp
      FROM wet w JOIN nz USING (idx, ch, n) JOIN dr ON dr.idx = w.idx WINDOW s AS (PARTITION BY w.idx))"""


@query("training_signals", with_views("mono rir rir_peak signal", DRAWS + f"""
    SELECT idx, ch, n::INTEGER AS n, {r('x * g', 5)} AS x, {r('dp * g', 5)} AS dp FROM (SELECT *, 0.9 / greatest(
      max(abs(x)) OVER (PARTITION BY idx), max(abs(dp)) OVER (PARTITION BY idx)) AS g FROM mx)"""))
def training_signals(spark, sf):
    """Drawn source through a drawn response plus drawn noise at a drawn SNR, and its direct path, scaled alike.

    Only keys meet in the draw joins; arrays join last and every signal step stays in the row.
    """
    m, c = T.mono(spark, sf), clips(spark, sf)
    hs = S.to_records(T.rirs(spark, sf).select("pair_id", "ch", F.col("h").alias("x")), "pair_id")
    # responses and their direct-path parts share one pass over the source; masked once per response
    hs = hs.select("pair_id", F.size("xs").alias("nch"),
                   F.concat("xs", F.transform("xs", lambda h: R.dp_mask(h, FS_RIR))).alias("hs"))
    ids, pairs = m.select("sig_id"), T.rirs(spark, sf).select("pair_id").distinct()
    draws = load(spark, sf, "customer").select(F.col("c_custkey").alias("idx"))
    for name, table, key in (("src", ids, "sig_id"), ("noise", ids, "sig_id"), ("rir", pairs, "pair_id")):
        n = table.select(F.count(F.lit(1))).scalar()
        listed = shuffled_index(table, [], f"t:{name}", key, "_k").withColumnRenamed(key, f"{name}_id")
        draws = draws.withColumn("_k", pick_index(n, f"t:k{name}", "idx")).join(listed, "_k").drop("_k")
    full = (draws.join(m.select(F.col("sig_id").alias("src_id"), "x"), "src_id")
            .join(hs.withColumnRenamed("pair_id", "rir_id"), "rir_id")
            .join(c.select(F.col("sig_id").alias("noise_id"), F.col("xs").alias("noise")), "noise_id"))
    noise = F.transform("noise", lambda v: S.pad_crop(v, 64, F.lit(0.0)))
    wet = full.select("idx", "nch", noise.alias("noise"), S.convolve(F.col("x"), F.col("hs")).alias("both"))
    wet = wet.select("idx", "noise", F.slice("both", F.lit(1), F.col("nch")).alias("wet"),
                     F.slice("both", F.col("nch") + 1, F.col("nch")).alias("dp"))
    snr = 15 + 15 * uniform("t:snr", "idx")
    mixed = wet.select("idx", "dp", S.snr_mix(F.col("wet"), F.col("noise"), snr, F.col("dp")).alias("xs"))
    x, dp = S.peak_scaled([F.col("xs"), F.col("dp")])
    channels = mixed.select("idx", F.arrays_zip(x.alias("x"), dp.alias("dp")).alias("c")).select("idx", F.posexplode("c").alias("ch", "c"))
    rows = channels.select("idx", "ch", F.posexplode(F.arrays_zip(F.col("c.x").alias("x"), F.col("c.dp").alias("dp"))).alias("n", "s"))
    return rows.select("idx", "ch", "n", rnd(F.col("s.x"), 5).alias("x"), rnd(F.col("s.dp"), 5).alias("dp"))
