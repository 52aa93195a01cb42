"""Feature queries: short frames of 16 samples, hop 8, nine bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from reverbtable.functions import kernels as K
from reverbtable.functions.arrays import rnd
from reverbtable.operators import features as X
from reverbtable.plans.book import Book
from reverbtable.plans.signals import long_rows
from reverbtable.plans.timeline import clips
from reverbtable.sources import tables as T
from reverbtable.sources.tables import load, r, u, with_views

query = Book()
QUERIES, ORACLE = query.queries, query.oracle

WIN, HOP, NF, NT = 16, 8, 9, 3
STFT = """fr AS (SELECT sig_id, ch, t, n - t*8 AS n, x * (0.5 - 0.5*cos(2*pi()*(n - t*8)/16)) AS x
      FROM signal, range(0,3) q(t) WHERE n >= t*8 AND n < t*8 + 16),
  st AS (SELECT sig_id, ch, t::INTEGER AS frame, k::INTEGER AS bin, sum(x*cos(2*pi()*k*n/16)) AS re, -sum(x*sin(2*pi()*k*n/16)) AS im
      FROM fr, range(0,9) b(k) GROUP BY ALL)"""
NORM = STFT + """, lv AS (SELECT sig_id, avg(sqrt(re*re+im*im)) + 1e-6 AS lv FROM st WHERE ch = 0 GROUP BY 1),
  nm AS (SELECT sig_id, ch, frame, bin, re/lv AS re, im/lv AS im FROM st JOIN lv USING (sig_id))"""


def spectrum(spark, sf):
    return X.with_spectrum(clips(spark, sf), "xs", WIN, HOP)


def bin_rows(spark, sf, normalise=False, first=0, count=None):
    rows = X.spectra(spectrum(spark, sf), ["sig_id"], normalise, first_bin=first, n_bins=count)
    return X.bins(rows, ["sig_id", "ch", "frame"])


def shown(df, *cols, digits=6):
    return df.withColumns({c: rnd(F.col(c), digits) for c in cols})


@query("stft", with_views("signal", STFT + f" SELECT sig_id, ch, frame, bin, {r('re')} AS re, {r('im')} AS im FROM st"))
def stft(spark, sf):
    return shown(bin_rows(spark, sf), "re", "im")


@query("stft_norm", with_views("signal", NORM + f" SELECT sig_id, ch, frame, (bin - 1)::INTEGER AS bin, {r('re')} AS re, {r('im')} AS im FROM nm WHERE bin >= 1"))
def stft_norm(spark, sf):
    """Divided by the mean magnitude of channel 0; the DC bin is dropped afterwards."""
    first, count = X.used_bins(WIN)
    return shown(bin_rows(spark, sf, True, first, count), "re", "im")


@query("istft", with_views("signal", f"SELECT sig_id, ch, n, {r('x')} AS x FROM signal WHERE n >= 1 AND n < 32"))
def istft(spark, sf):
    """Forward and inverse transform return the signal (the first sample has window weight zero)."""
    back = spectrum(spark, sf).select("sig_id", K.istft(WIN, HOP)(F.col("re"), F.col("im")).alias("xs"))
    return long_rows(back, "sig_id").filter("n >= 1")


@query("mel", with_views("signal", STFT + f""",
    ed AS (SELECT i, 700*(pow(10, 2595*log10(1 + 8000/700.0::DOUBLE)*i/5/2595) - 1) AS f FROM range(0,6) t(i)),
    fb AS (SELECT a.i AS band, k, greatest(0, least((k*1000.0 - a.f)/(b.f-a.f), (c.f - k*1000.0)/(c.f-b.f))) AS w
           FROM ed a JOIN ed b ON b.i = a.i+1 JOIN ed c ON c.i = a.i+2, range(0,9) q(k))
    SELECT sig_id, ch, frame, band::INTEGER AS band, {r('sum(w*re)')} AS re, {r('sum(w*im)')} AS im FROM st JOIN fb ON fb.k = st.bin GROUP BY ALL"""))
def mel(spark, sf):
    """Four mel bands of the real and imaginary parts."""
    rows = X.spectra(spectrum(spark, sf), ["sig_id"])
    proj = rows.select("sig_id", "ch", "frame", *[X.mel_project(F.col(c), 4, 16000, NF).alias(c) for c in ("re", "im")])
    out = proj.select("sig_id", "ch", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("band", "_b"))
    return shown(out.select("sig_id", "ch", "frame", "band", "_b.re", "_b.im"), "re", "im")


CROSS = STFT + """, cs AS (SELECT sig_id, a.bin, avg(a.re*b.re + a.im*b.im) AS re, avg(a.im*b.re - a.re*b.im) AS im,
      avg(a.re*a.re + a.im*a.im) AS p0, avg(b.re*b.re + b.im*b.im) AS p1
    FROM st a JOIN st b USING (sig_id, frame) WHERE a.ch = 0 AND b.ch = 1 AND a.bin = b.bin GROUP BY ALL)"""


def cross_rows(spark, sf):
    return X.cross_spectrum(X.pair_channels(spectrum(spark, sf), ["sig_id"], "M"), ["sig_id"])


@query("cross_spectrum", with_views("signal", CROSS + f" SELECT sig_id, bin, {r('re')} AS re, {r('im')} AS im, {r('p0')} AS p0, {r('p1')} AS p1 FROM cs"))
def cross_spectrum(spark, sf):
    return shown(cross_rows(spark, sf), "re", "im", "p0", "p1")


@query("spatial_coherence", with_views("signal", CROSS + f" SELECT sig_id, bin, {r('re/sqrt(p0*p1)')} AS coherence FROM cs"))
def spatial_coherence(spark, sf):
    return shown(X.coherence(cross_rows(spark, sf)).select("sig_id", "bin", "coherence"), "coherence")


def four_channels(spark, sf):
    """Four 16-sample channels per record."""
    v = F.col("embedding").cast("array<double>")
    xs = F.array(*[F.slice(v, 16 * c + 1, 16) for c in range(4)])
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("sig_id"), xs.alias("xs"))


FOUR = """q4 AS (SELECT sig_id, n // 16 AS ch, sum(x * (0.5 - 0.5*cos(2*pi()*(n % 16)/16)) * cos(2*pi()*2*(n % 16)/16)) AS re FROM mono GROUP BY ALL)"""


def _pairs(spark, sf, mode):
    spec = X.with_spectrum(four_channels(spark, sf), "xs", 16, 16)
    rows = X.pair_channels(spec, ["sig_id"], mode)
    at = lambda c: F.get(F.get(F.get("re", F.lit(c)), F.lit(0)), F.lit(2))
    return rows.select("sig_id", "pair", "c0", "c1", rnd(at(0)).alias("re0"), rnd(at(1)).alias("re1"))


def _pairs_sql(cond, order):
    return with_views("mono", FOUR + f""" SELECT a.sig_id, (row_number() OVER (PARTITION BY a.sig_id ORDER BY {order}) - 1)::INTEGER AS pair,
      a.ch::INTEGER AS c0, b.ch::INTEGER AS c1, {r('a.re')} AS re0, {r('b.re')} AS re1 FROM q4 a JOIN q4 b ON a.sig_id = b.sig_id AND {cond}""")


@query("channel_pairs_ref", _pairs_sql("a.ch = 0 AND b.ch > 0", "b.ch"))
def channel_pairs_ref(spark, sf):
    return _pairs(spark, sf, "M")


@query("channel_pairs_every", _pairs_sql("a.ch < b.ch", "a.ch, b.ch"))
def channel_pairs_every(spark, sf):
    return _pairs(spark, sf, "MM")


@query("channel_unpair", with_views("mono", FOUR + f""" SELECT sig_id, (ch - 1)::INTEGER AS pos, {r('re')} AS re FROM q4 WHERE ch > 0"""))
def channel_unpair(spark, sf):
    """Pair rows back to one row per record."""
    rows = _pairs(spark, sf, "M")
    return X.unpair(rows, ["sig_id"], "re1").select("sig_id", F.posexplode("re1").alias("pos", "re"))


@query("patches", with_views("signal", STFT + f""" SELECT sig_id, ch, ((bin // 3)*3 + frame)::INTEGER AS patch, (bin % 3)::INTEGER AS pos, {r('re')} AS re FROM st"""))
def patches(spark, sf):
    """Patches of three bins by one frame."""
    return shown(X.patch_split(bin_rows(spark, sf).drop("im"), NF, NT, 3, 1), "re")


@query("patch_recover", with_views("signal", STFT + f" SELECT sig_id, ch, frame, bin, {r('re')} AS re FROM st WHERE bin < 8 AND frame < 2"))
def patch_recover(spark, sf):
    """Split into patches of four bins by two frames, time first, and put back."""
    cut = X.patch_split(bin_rows(spark, sf).drop("im"), NF, NT, 4, 2, f_first=True)
    return shown(X.patch_recover(cut, NF, NT, 4, 2, f_first=True), "re")


# ---- masks: 16 patches (4 x 4), 8 of them masked ----------------------------------------

ORDER = """rk AS (SELECT vec_id AS sig_id, p, row_number() OVER (PARTITION BY vec_id ORDER BY md5('mask:' || vec_id || ':' || p), p) AS k FROM embeddings, range(0,16) t(p))"""


def _grown(offsets):
    return ORDER + f""",
  cv AS (SELECT sig_id, p + o AS p, min(k) AS k FROM rk, (SELECT unnest({offsets}) AS o) WHERE p + o < 16 GROUP BY ALL),
  cn AS (SELECT *, count(*) OVER (PARTITION BY sig_id ORDER BY k RANGE UNBOUNDED PRECEDING) AS c FROM cv),
  kk AS (SELECT sig_id, coalesce(min(k) FILTER (c > 8), 99) AS kmax FROM cn GROUP BY 1),
  mk AS (SELECT sig_id, p FROM (SELECT cn.sig_id, p, row_number() OVER (PARTITION BY cn.sig_id ORDER BY p) AS i
         FROM cn JOIN kk USING (sig_id) WHERE k <= kmax) WHERE i <= 8)"""


MASK_SQL = {
    "T": "WITH " + ORDER + " SELECT sig_id, p::INTEGER AS patch FROM rk WHERE k <= 8",
    "T_cluster": "WITH " + _grown("[0,1,2,3,4]") + " SELECT sig_id, p::INTEGER AS patch FROM mk",
    "TF": "WITH " + _grown("[0,1,2,4,5,6,8,9,10]") + " SELECT sig_id, p::INTEGER AS patch FROM mk",
    "T_cluster_inverse": "WITH " + _grown("[0,1,2,3,4]") + """ SELECT sig_id, p::INTEGER AS patch FROM rk
        WHERE NOT EXISTS (SELECT 1 FROM mk WHERE mk.sig_id = rk.sig_id AND mk.p = rk.p)""",
    "T_cluster2": """WITH rk AS (SELECT vec_id AS sig_id, p, row_number() OVER (PARTITION BY vec_id ORDER BY md5('mask:' || vec_id || ':' || p), p) AS k FROM embeddings, range(0,16,5) t(p))
      SELECT sig_id, p::INTEGER AS patch FROM (SELECT sig_id, p + o AS p, row_number() OVER (PARTITION BY sig_id ORDER BY p + o) AS i
        FROM rk, range(0,5) q(o) WHERE k <= 3 AND p + o < 16) WHERE i <= 8""",
}


def _mask_query(mode):
    def run(spark, sf):
        df = load(spark, sf, "embeddings").select(F.col("vec_id").alias("sig_id"))
        return df.select("sig_id", F.explode(X.masked_patches("sig_id", mode, 8, (4, 4))).alias("patch"))
    return run


for _mode, _sql in MASK_SQL.items():
    query("mask_" + _mode.lower(), _sql)(_mask_query(_mode))


@query("visible_patches", "WITH " + ORDER + " SELECT sig_id, p::INTEGER AS patch FROM rk WHERE k > 8")
def visible_patches(spark, sf):
    df = load(spark, sf, "embeddings").select(F.col("vec_id").alias("sig_id"))
    return df.select("sig_id", F.explode(X.visible_patches(X.masked_patches("sig_id", "T", 8, (4, 4)), 16)).alias("patch"))


VIEWS = f"""rk AS (SELECT vec_id AS sig_id, p, row_number() OVER (PARTITION BY vec_id ORDER BY md5('mask:' || vec_id || ':' || p), p) AS k,
      floor(2*{u('mask:ch', 'vec_id')})::INTEGER AS mch FROM embeddings, range(0,4) t(p)),
  vw AS (SELECT s.sig_id, s.ch, s.n // 8 AS patch, s.n % 8 AS pos, x AS v, k <= 2 AS hid, ch = mch AS own FROM signal s JOIN rk ON rk.sig_id = s.sig_id AND rk.p = s.n // 8)"""


def view_rows(spark, sf):
    """Four patches of eight samples per channel, two of them masked on one channel."""
    # the mask is drawn once per channel row, before samples become rows
    drawn = T.signals(spark, sf).select("sig_id", "ch", "x", X.masked_patches("sig_id", "T", 2, (4, 1)).alias("mask"),
                                        X.masked_channel("sig_id", 2).alias("mask_ch"))
    rows = drawn.select("sig_id", "ch", "mask", "mask_ch", F.posexplode("x").alias("n", "v"))
    rows = rows.withColumns({"patch": F.floor(F.col("n") / 8).cast("int"), "pos": F.col("n") % 8})
    return X.masked_views(rows, "v", F.col("mask"), F.col("mask_ch")).drop("mask", "mask_ch", "n")


@query("masked_views", with_views("signal", VIEWS + f""" SELECT sig_id, ch, patch::INTEGER AS patch, pos::INTEGER AS pos, hid AND own AS hidden,
    {r('CASE WHEN hid AND own THEN 0 ELSE v END', 9)} AS masked, {r('CASE WHEN hid <> own THEN v ELSE 0 END', 9)} AS spectral,
    {r('CASE WHEN hid THEN 0 ELSE v END', 9)} AS spatial, {r('CASE WHEN own THEN v ELSE 0 END', 9)} AS target FROM vw"""))
def masked_views(spark, sf):
    return shown(view_rows(spark, sf).drop("v"), "masked", "spectral", "spatial", "target", digits=9)


@query("masked_mse", with_views("signal", VIEWS + f""" SELECT sig_id % 7 AS batch,
    {r('sum(CASE WHEN hid AND own THEN d*d ELSE 0 END)/count(*) FILTER (hid AND own)', 9)} AS mse_masked,
    {r('sum(CASE WHEN hid AND own THEN d*d ELSE 0 END)*2/count(*)', 9)} AS mse_masked_channel, {r('avg(d*d)', 9)} AS mse
    FROM (SELECT *, v*v*0.5 AS d FROM vw) GROUP BY 1"""))
def masked_mse(spark, sf):
    rows = view_rows(spark, sf).select((F.col("sig_id") % 7).alias("batch"), "hidden", F.col("v").alias("gt"),
                                       (F.col("v") + F.col("v") * F.col("v") * 0.5).alias("pred"))
    return shown(X.masked_mse(rows, ["batch"], 2), "mse_masked", "mse_masked_channel", "mse", digits=9)


@query("masked_channel", f"SELECT vec_id AS sig_id, floor(2*{u('mask:ch', 'vec_id')})::INTEGER AS ch FROM embeddings")
def masked_channel(spark, sf):
    """The masked channel found back from the mask itself."""
    return X.detect_masked_channel(view_rows(spark, sf), "sig_id").select("sig_id", F.col("ch").cast("int").alias("ch"))
