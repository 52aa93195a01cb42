"""Timeline queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from reverbtable.functions.arrays import energy, rnd
from reverbtable.operators import timeline as L
from reverbtable.plans.book import Book
from reverbtable.sources import tables as T
from reverbtable.sources.tables import r, with_views

query = Book()
QUERIES, ORACLE = query.queries, query.oracle

MIN_GAP, AUDIO = 4_000_000, 29 * 86_400_000_000


@query("speech_gaps", with_views("utterance", f"""
    SELECT session, utt_id, e0 AS st, s1 AS en, s1 - e0 AS len FROM (
      SELECT *, coalesce(max(en) OVER (PARTITION BY session ORDER BY st, utt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e0,
        lead(st) OVER (PARTITION BY session ORDER BY st, utt_id) AS s1 FROM utterance)
    WHERE s1 - e0 >= {MIN_GAP} AND s1 < {AUDIO}"""))
def speech_gaps(spark, sf):
    return L.speech_gaps(T.utterances(spark, sf), MIN_GAP, F.lit(AUDIO))


def kinds(spark, sf, kind):
    return T.timeline(spark, sf).filter(F.col("kind") == kind)


@query("interpolate", with_views("timeline", f"""
    kn AS (SELECT key, t, v FROM timeline WHERE kind = 'view'), pb AS (SELECT key, event_id, t FROM timeline WHERE kind = 'click'),
    b AS (SELECT pb.*, kn.t AS t0, kn.v AS v0 FROM pb ASOF LEFT JOIN kn ON pb.key = kn.key AND pb.t >= kn.t),
    f AS (SELECT b.*, kn.t AS t1, kn.v AS v1 FROM b ASOF LEFT JOIN kn ON b.key = kn.key AND b.t < kn.t)
    SELECT key, event_id, {r('CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1-v0)*(t-t0)/(t1-t0) END')} AS v
    FROM f"""))
def interpolate(spark, sf):
    knots = kinds(spark, sf, "view").select("key", "t", "v")
    probes = kinds(spark, sf, "click").select("key", "event_id", "t")
    return L.interpolate(probes, knots, ["key"]).select("key", "event_id", rnd(F.col("v")).alias("v"))


@query("asof_state", with_views("timeline", """
    SELECT p.key, p.event_id, s.active FROM (SELECT * FROM timeline WHERE kind = 'click') p
    ASOF LEFT JOIN (SELECT key, t, kind = 'purchase' AS active FROM timeline WHERE kind <> 'click') s
    ON p.key = s.key AND p.t > s.t"""))
def asof_state(spark, sf):
    t = T.timeline(spark, sf)
    states = t.filter("kind <> 'click'").select("key", "t", (F.col("kind") == "purchase").alias("active"))
    probes = t.filter("kind = 'click'").select("key", "event_id", "t")
    return L.last_before(probes, states, ["key"], "active").select("key", "event_id", "active")


@query("relative_time", with_views("timeline", f"""SELECT key, event_id,
    {r('(t - min(t) OVER (PARTITION BY key))/1e6')} AS t_rel FROM timeline"""))
def relative_time(spark, sf):
    return L.relative_time(T.timeline(spark, sf), "key").select("key", "event_id", rnd(F.col("t_rel")).alias("t_rel"))


SEG_SQL = """sg AS (SELECT s.*, w FROM series s, LATERAL (SELECT unnest(range(0, s.n // 4 + 1)) AS w) WHERE s.n < w*4 + 8)"""


@query("segments", with_views("series", SEG_SQL + f""" SELECT key, w, {r('avg(x)')} AS x, {r('w*4/16000.0')} AS tw
    FROM sg GROUP BY key, w HAVING count(*) = 8"""))
def segments(spark, sf):
    """Label means over windows of 8 samples every 4, with window times."""
    out = L.segment_means(T.series(spark, sf), ["key"], "n", ["x"], 8, 4)
    return out.select("key", "w", rnd(F.col("x")).alias("x"), rnd(F.col("w") * 4 / 16000.0).alias("tw"))


@query("record_target", with_views("series", SEG_SQL + f""", m AS (SELECT key, w, avg(x) AS x FROM sg GROUP BY key, w HAVING count(*) = 8)
    SELECT key, {r('avg(x)', 11)} AS target, {r('avg(x*16000)', 7)} AS target_samples, {r('avg(log10(x))')} AS target_log FROM m GROUP BY key"""))
def record_target(spark, sf):
    from reverbtable.operators.evaluate import record_targets
    seg = L.segment_means(T.series(spark, sf), ["key"], "n", ["x"], 8, 4)
    out = record_targets(seg, "key", {"target": F.col("x"), "target_samples": F.col("x") * 16000, "target_log": F.log10("x")})
    return out.select("key", rnd(F.col("target"), 11).alias("target"), rnd(F.col("target_samples"), 7).alias("target_samples"),
                      rnd(F.col("target_log")).alias("target_log"))


@query("doa_unwrap", with_views("series", f"""
    az AS (SELECT key, n, x % (2*pi()) - pi() AS a FROM series),
    pv AS (SELECT *, lag(a) OVER (PARTITION BY key ORDER BY n) AS p FROM az),
    sg AS (SELECT s.*, w FROM pv s, LATERAL (SELECT unnest(range(0, s.n // 4 + 1)) AS w) WHERE s.n < w*4 + 8),
    m AS (SELECT key, w, max(CASE WHEN n > w*4 THEN abs(a-p) END) AS j, sum(a) AS s, count(*) FILTER (a < 0) AS neg FROM sg GROUP BY key, w HAVING count(*) = 8),
    q AS (SELECT key, w, (s + CASE WHEN j > pi() THEN 2*pi()*neg ELSE 0 END)/8 AS a FROM m)
    SELECT key, w, {r('CASE WHEN a > pi() THEN a - 2*pi() ELSE a END')} AS azi FROM q"""))
def doa_unwrap(spark, sf):
    az = T.series(spark, sf).select("key", "n", (F.col("x") % F.lit(2 * math.pi) - F.lit(math.pi)).alias("azi"))
    return L.segment_azimuth(az, "key", "n", "azi", 8, 4).withColumn("azi", rnd(F.col("azi")))


@query("frames", with_views("signal", f"""
    SELECT sig_id, ch, f::INTEGER AS frame, {r('sum(x*x)', 9)} AS energy
    FROM signal s, LATERAL (SELECT unnest(range(0, 3)) AS f) WHERE n >= f*8 AND n < f*8 + 16 GROUP BY ALL"""))
def frames(spark, sf):
    fr = L.frames(T.signals(spark, sf), ["sig_id", "ch"], "x", 16, 8)
    return fr.select("sig_id", "ch", "frame", rnd(energy(F.col("x")), 9).alias("energy"))


def dp_and_mix(spark, sf):
    from reverbtable.functions.arrays import scaled
    s = T.signals(spark, sf)
    a = s.filter("ch = 0").select("sig_id", F.col("x").alias("dp"))
    b = s.filter("ch = 1").select("sig_id", F.col("x").alias("o"))
    return a.join(b, "sig_id").select("sig_id", "dp", F.zip_with("dp", "o", lambda p, q: p + q).alias("mix"))


VAD = """pr AS (SELECT sig_id, n, max(CASE WHEN ch = 0 THEN x END) AS dp, sum(x) AS mix FROM signal GROUP BY ALL),
  vb AS (SELECT sig_id, n // 8 AS blk, sum(dp*dp)/(sum(mix*mix) + 1e-8) AS ratio FROM pr GROUP BY ALL)"""


@query("block_vad", with_views("signal", VAD + f" SELECT sig_id, blk::INTEGER AS blk, {r('ratio')} AS ratio FROM vb"))
def block_vad(spark, sf):
    """Share of direct-path energy per tumbling block."""
    v = L.block_activity(F.col("dp"), F.col("mix"), 8)
    return (dp_and_mix(spark, sf).select("sig_id", F.posexplode(v).alias("blk", "ratio"))
            .withColumn("ratio", rnd(F.col("ratio"))))


@query("vad_segments", with_views("signal", VAD + """ SELECT sig_id, w::INTEGER AS frame, count(*) FILTER (ratio > 0.5) AS n_active
    FROM (SELECT sig_id, blk*8 + k AS n, ratio FROM vb, range(0,8) t(k)) s, LATERAL (SELECT unnest(range(0, 6)) AS w)
    WHERE n >= w*4 AND n < w*4 + 12 GROUP BY ALL"""))
def vad_segments(spark, sf):
    """Block activity repeated to samples and cut into windows."""
    v = L.to_samples(L.block_activity(F.col("dp"), F.col("mix"), 8), 8)
    win = L.frames(dp_and_mix(spark, sf).select("sig_id", v.alias("vad")), ["sig_id"], "vad", 12, 4)
    return win.select("sig_id", "frame", F.size(F.filter("vad", lambda a: a > 0.5)).cast("long").alias("n_active"))


@query("leading_silence", with_views("signal", f"""
    SELECT sig_id, {r('min(n) FILTER (x > 0.15*mx)/5.0')} AS silence_s FROM (
      SELECT *, max(x) OVER (PARTITION BY sig_id) AS mx FROM signal WHERE ch = 0 AND n < 20) GROUP BY sig_id"""))
def leading_silence(spark, sf):
    return T.signals(spark, sf).filter("ch = 0").select(
        "sig_id", rnd(L.leading_silence(F.col("x"), 5)).alias("silence_s"))


ENERGY = """sq AS (SELECT sig_id, n, avg(x*x) AS v FROM signal GROUP BY ALL UNION ALL SELECT DISTINCT sig_id, 32, 0.0 FROM signal),
  en AS (SELECT sig_id, n, (v + coalesce(lag(v) OVER (PARTITION BY sig_id ORDER BY n), 0))/2 AS e FROM sq)"""


def clips(spark, sf):
    xs = F.array(T.channel(0), T.channel(1))
    return T.load(spark, sf, "embeddings").select(F.col("vec_id").alias("sig_id"), xs.alias("xs"))


@query("moving_energy", with_views("signal", ENERGY + f" SELECT sig_id, n, {r('e', 9)} AS e FROM en"))
def moving_energy(spark, sf):
    out = L.moving_energy(clips(spark, sf), "sig_id", "xs", 2)
    return out.select("sig_id", "n", rnd(F.col("e"), 9).alias("e"))


@query("noise_span", with_views("signal", ENERGY + f""",
    th AS (SELECT sig_id, (avg(e) FILTER (n >= 2 AND n < 7) + avg(e) FILTER (n >= 15 AND n < 18))/4
             + (max(e) FILTER (n >= 2 AND n < 7) + min(e) FILTER (n >= 15 AND n < 18))/4 AS th FROM en GROUP BY 1),
    sp AS (SELECT sig_id, th, coalesce(min(n) FILTER (e > th AND n < 15), 0) AS st,
             coalesce(min(n) FILTER (NOT e > th AND n >= 15), 15) - 2 AS en FROM en JOIN th USING (sig_id) GROUP BY ALL)
    SELECT sig_id, {r('th', 9)} AS th, st::INTEGER AS st, en::INTEGER AS en, en > st AND (en - st)/5.0 > 3 AS usable FROM sp"""))
def noise_span(spark, sf):
    out = L.noise_span(clips(spark, sf), "sig_id", "xs", 5).select("sig_id", "th", F.col("st").cast("int").alias("st"), F.col("en").cast("int").alias("en"), "usable")
    return out.withColumn("th", rnd(F.col("th"), 9))


@query("noise_clip", with_views("signal", ENERGY + f""",
    th AS (SELECT sig_id, (avg(e) FILTER (n >= 2 AND n < 7) + avg(e) FILTER (n >= 15 AND n < 18))/4
             + (max(e) FILTER (n >= 2 AND n < 7) + min(e) FILTER (n >= 15 AND n < 18))/4 AS th FROM en GROUP BY 1),
    sp AS (SELECT sig_id, coalesce(min(n) FILTER (e > th AND n < 15), 0) AS st,
             coalesce(min(n) FILTER (NOT e > th AND n >= 15), 15) - 2 AS en FROM en JOIN th USING (sig_id) GROUP BY sig_id)
    SELECT sig_id, ch, (n - st)::INTEGER AS n, {r('x', 9)} AS x FROM signal JOIN sp USING (sig_id) WHERE en > st AND (en - st)/5.0 > 3 AND n >= st AND n < en"""))
def noise_clip(spark, sf):
    """Usable noise clips without their silence, as samples."""
    out = L.noise_clip(clips(spark, sf), "sig_id", "xs", 5).select("sig_id", F.posexplode("xs").alias("ch", "_x"))
    return out.select("sig_id", "ch", F.posexplode("_x").alias("n", "_v")).select("sig_id", "ch", "n", rnd(F.col("_v"), 9).alias("x"))
