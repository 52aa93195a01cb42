"""Geometry and room-acoustics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reverbtable.functions import acoustics as ac
from reverbtable.functions.arrays import rnd
from reverbtable.functions.draws import uniform
from reverbtable.operators import geometry as G
from reverbtable.plans.book import Book
from reverbtable.sources import tables as T
from reverbtable.sources.tables import r, u, with_views

query = Book()
QUERIES, ORACLE = query.queries, query.oracle

LO, HI = 0.03, 0.20  # fixed values: accepted pair distance in metres
D = "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"
PAIRS = f"""prs AS (SELECT a.array_id, a.mic_id AS m1, b.mic_id AS m2, {D} AS d
    FROM mics a JOIN mics b ON a.array_id = b.array_id AND a.mic_id <> b.mic_id
    WHERE {D} BETWEEN {LO} AND {HI})"""


@query("mic_pairs", with_views("mics", PAIRS + f" SELECT array_id, m1, m2, {r('d')} AS d FROM prs WHERE m1 < m2"))
def mic_pairs(spark, sf):
    return G.mic_pairs(T.mics(spark, sf), LO, HI).withColumn("d", rnd(F.col("d")))


@query("mic_pairs_ordered", with_views("mics", PAIRS + f" SELECT array_id, m1, m2, {r('d')} AS d FROM prs"))
def mic_pairs_ordered(spark, sf):
    return G.mic_pairs(T.mics(spark, sf), LO, HI, ordered=True).withColumn("d", rnd(F.col("d")))


@query("pair_count", with_views("mics", PAIRS + """ SELECT array_id, count(m1) AS n_pairs
    FROM (SELECT DISTINCT array_id FROM mics) LEFT JOIN (SELECT * FROM prs WHERE m1 < m2) USING (array_id) GROUP BY 1"""))
def pair_count(spark, sf):
    return G.pair_count(T.mics(spark, sf), LO, HI)


@query("arrays_without_pairs", with_views("small_arrays", f"""
    SELECT DISTINCT array_id FROM small_arrays WHERE array_id NOT IN (
      SELECT a.array_id FROM small_arrays a JOIN small_arrays b ON a.array_id = b.array_id AND a.mic < b.mic
      WHERE {D} BETWEEN {LO} AND 0.1)"""))
def arrays_without_pairs(spark, sf):
    m = T.small_arrays(spark, sf)
    return G.arrays_without_pairs(m, G.mic_pairs(m, LO, 0.1, mic="mic"))


@query("channel_pairs_all", with_views("recordings", """
    SELECT rec_id, m1::INTEGER AS m1, m2::INTEGER AS m2 FROM (
      SELECT rec_id, array_id, unnest(range(0, 2 + array_id % 7)) AS m1 FROM recordings), LATERAL (
      SELECT unnest(range(0, 2 + array_id % 7)) AS m2) WHERE m1 <> m2"""))
def channel_pairs_all(spark, sf):
    rec = T.recordings(spark, sf).select("rec_id", "array_id")
    return G.channel_pairs(rec, 2 + F.col("array_id") % 7).select("rec_id", "m1", "m2")


def scene_sources(spark, sf):
    return T.src_pos(spark, sf).withColumn("array_id", F.floor(F.col("src_id") / 8).cast("long"))


DIST = lambda p, q: "sqrt(" + "+".join(f"({p}.{c}-{q}.{c})*({p}.{c}-{q}.{c})" for c in "xyz") + ")"
TDOA = f"""td AS (SELECT m.array_id, s.src_id, m.mic, ({DIST('s', 'm')} - {DIST('s', 'z')})/343.0::DOUBLE AS tdoa
    FROM small_arrays m JOIN small_arrays z ON z.array_id = m.array_id AND z.mic = 0
    JOIN src_pos s ON s.src_id // 8 = m.array_id)"""


@query("tdoa", with_views("small_arrays src_pos", TDOA + f"""
    SELECT array_id, src_id, mic, {r('tdoa', 9)} AS tdoa, {r('tdoa*16000')} AS tdoa_samples FROM td"""))
def tdoa(spark, sf):
    out = G.tdoa(T.small_arrays(spark, sf), scene_sources(spark, sf))
    return out.select("array_id", "src_id", "mic", rnd(F.col("tdoa"), 9).alias("tdoa"),
                      rnd(F.col("tdoa") * 16000).alias("tdoa_samples"))


@query("channel_swap", with_views("small_arrays src_pos", TDOA + f"""
    SELECT array_id, src_id, CASE WHEN f THEN mic ELSE 0 END AS m1, CASE WHEN f THEN 0 ELSE mic END AS m2,
      {r('CASE WHEN f THEN -tdoa ELSE tdoa END', 9)} AS tdoa
    FROM (SELECT *, {u('7:swap', 'src_id', 'mic')} < 0.5 AS f FROM td) WHERE mic > 0"""))
def channel_swap(spark, sf):
    td = (G.tdoa(T.small_arrays(spark, sf), scene_sources(spark, sf)).filter("mic > 0")
          .select("array_id", "src_id", F.lit(0).alias("m1"), F.col("mic").alias("m2"), "tdoa"))
    out = G.maybe_swap(td, uniform("7:swap", "src_id", "m2") < 0.5)
    return out.withColumn("tdoa", rnd(F.col("tdoa"), 9))


@query("doa", with_views("small_arrays src_pos", f"""
    cen AS (SELECT array_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM small_arrays GROUP BY 1)
    SELECT array_id, src_id, {r('atan2(dy, dx)')} AS azi, {r('atan2(sqrt(dx*dx+dy*dy), dz)')} AS ele,
      {r('sqrt(dx*dx+dy*dy+dz*dz)')} AS r
    FROM (SELECT array_id, src_id, s.x-c.x AS dx, s.y-c.y AS dy, s.z-c.z AS dz
          FROM src_pos s JOIN cen c ON s.src_id // 8 = c.array_id)"""))
def doa(spark, sf):
    centre = T.small_arrays(spark, sf).groupBy("array_id").agg(*[F.avg(c).alias(c) for c in "xyz"])
    out = G.doa(centre, scene_sources(spark, sf))
    return out.select("array_id", "src_id", *[rnd(F.col(c)).alias(c) for c in ("azi", "ele", "r")])


@query("sph_roundtrip", with_views("src_pos", f"""SELECT src_id, {r('x')} AS x, {r('y')} AS y, {r('z')} AS z,
    {r('x/n')} AS ux, {r('y/n')} AS uy, {r('z/n')} AS uz FROM (SELECT *, sqrt(x*x+y*y+z*z) AS n FROM src_pos)"""))
def sph_roundtrip(spark, sf):
    """cart -> sph -> cart returns the point; with no radius it returns the unit vector."""
    s = T.src_pos(spark, sf)
    sph = s.select("src_id", *[v.alias(k) for k, v in ac.cart2sph(*ac.xyz()).items()])
    full = ac.sph2cart(F.col("azi"), F.col("ele"), F.col("r"))
    flat = ac.sph2cart(F.col("azi"), F.col("ele"), F.lit(None).cast("double"))
    return sph.select("src_id", *[rnd(v).alias(k) for k, v in full.items()],
                      *[rnd(v).alias(f"u{k}") for k, v in flat.items()])


@query("unit_vectors", with_views("src_pos", f"""SELECT src_id, {r('x/sqrt(x*x+y*y+z*z)')} AS x,
    {r('y/sqrt(x*x+y*y+z*z)')} AS y, {r('z/sqrt(x*x+y*y+z*z)')} AS z FROM src_pos"""))
def unit_vectors(spark, sf):
    return T.src_pos(spark, sf).select("src_id", *[rnd(v).alias(k) for k, v in ac.unit(*ac.xyz()).items()])


@query("rotate_array", with_views("small_arrays", f"""
    SELECT array_id, mic, {r('3.0 + (x*cos(radians(deg)) - y*sin(radians(deg)))*sc')} AS x,
      {r('2.5 + (x*sin(radians(deg)) + y*cos(radians(deg)))*sc')} AS y, {r('1.5 + z*sc')} AS z
    FROM (SELECT *, -90.0::DOUBLE + 180.0::DOUBLE*{u('7:rot', 'array_id')} AS deg,
                 0.5::DOUBLE + 1.0::DOUBLE*{u('7:scale', 'array_id')} AS sc FROM small_arrays)"""))
def rotate_array(spark, sf):
    deg = -90.0 + 180.0 * uniform("7:rot", "array_id")
    sc = 0.5 + 1.0 * uniform("7:scale", "array_id")
    out = ac.rotate_z(*ac.xyz(), deg, sc, (F.lit(3.0), F.lit(2.5), F.lit(1.5)))
    return T.small_arrays(spark, sf).select("array_id", "mic", *[rnd(v).alias(k) for k, v in out.items()])


@query("array_pose", with_views("small_arrays timeline", f"""
    pose AS (SELECT key AS array_id, row_number() OVER (PARTITION BY key ORDER BY t, event_id) - 1 AS frame, v*0.01 AS px
             FROM timeline)
    SELECT array_id, frame, mic, {r('x*cos(px) - y*sin(px) + px')} AS x, {r('x*sin(px) + y*cos(px) + 1.0')} AS y, {r('z + 1.5')} AS z
    FROM small_arrays JOIN pose USING (array_id) WHERE frame = 0 OR array_id % 3 = 0"""))
def array_pose(spark, sf):
    """Microphones carried by a moving array; two of three arrays stand still (frame 0)."""
    px = F.col("x") * 0.01
    rot = F.array(F.array(F.cos(px), -F.sin(px), F.lit(0.0)), F.array(F.sin(px), F.cos(px), F.lit(0.0)),
                  F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    pose = T.series(spark, sf).select(F.col("key").alias("array_id"), F.col("n").alias("frame"), rot.alias("rot"),
                                      px.alias("px"), F.lit(1.0).alias("py"), F.lit(1.5).alias("pz"))
    out = G.posed_mics(T.small_arrays(spark, sf), pose, F.col("array_id") % 3 != 0, "array_id")
    return out.select("array_id", "frame", "mic", *[rnd(F.col(c)).alias(c) for c in "xyz"])


@query("circular_array", with_views("recordings", f"""
    SELECT rec_id, mic::INTEGER AS mic, {r('CASE WHEN mic < n THEN rad*cos(2*pi()*mic/n) ELSE 0 END')} AS x,
      {r('CASE WHEN mic < n THEN rad*sin(2*pi()*mic/n) ELSE 0 END')} AS y
    FROM (SELECT *, unnest(range(0, n+1)) AS mic FROM
      (SELECT rec_id, 4 + array_id % 5 AS n, 0.03 + 0.0001*array_id AS rad FROM recordings))"""))
def circular_array(spark, sf):
    """Ring of 4 to 8 microphones plus one in the centre for every recording device."""
    rec = T.recordings(spark, sf).select("rec_id", "array_id")
    out = G.circular_array(rec, 4 + F.col("array_id") % 5, 0.03 + 0.0001 * F.col("array_id"), centre=True)
    return out.select("rec_id", "mic", rnd(F.col("x")).alias("x"), rnd(F.col("y")).alias("y"))


@query("linear_array", with_views("small_arrays", f"""
    SELECT array_id, mic, {r('p - (max(p) OVER (PARTITION BY array_id) + min(p) OVER (PARTITION BY array_id))/2')} AS x
    FROM (SELECT array_id, mic, sum(abs(x)) OVER (PARTITION BY array_id ORDER BY mic) AS p FROM small_arrays)"""))
def linear_array(spark, sf):
    gaps = T.small_arrays(spark, sf).select("array_id", "mic", F.abs("x").alias("gap"))
    return G.linear_array(gaps).withColumn("x", rnd(F.col("x")))


WALLS = [0.1, 0.2, 0.15, 0.05, 0.3, 0.25]
AREA = ("((w[1]+w[2])*ly*lz + (w[3]+w[4])*lx*lz + (w[5]+w[6])*lx*ly)")
ROOMS = f"""rm AS (SELECT rec_id, 3.0 + array_id AS lx, 3.0 + array_id*0.5 AS ly, 2.5::DOUBLE AS lz, duration_s,
    {WALLS}::DOUBLE[] AS w FROM recordings)"""


def rooms(spark, sf):
    k = F.col("array_id").cast("double")
    return T.recordings(spark, sf).select(
        "rec_id", "duration_s", (3.0 + k).alias("lx"), (3.0 + k * 0.5).alias("ly"), F.lit(2.5).alias("lz"))


@query("sabine_t60", with_views("recordings", ROOMS + f"""
    SELECT rec_id, {r(f'0.161*lx*ly*lz/{AREA}')} AS t60, {r('2*(lx*ly+lx*lz+ly*lz)')} AS surface,
      {r('lx*ly*lz')} AS volume FROM rm"""))
def sabine_t60(spark, sf):
    dims = {k: F.col(k) for k in ("lx", "ly", "lz")}
    return rooms(spark, sf).select(
        "rec_id", rnd(ac.sabine_t60(**dims, walls=[F.lit(w) for w in WALLS])).alias("t60"),
        rnd(ac.surface(**dims)).alias("surface"), rnd(ac.volume(**dims)).alias("volume"))


@query("wall_weight", with_views("recordings", ROOMS + f""",
    wx AS (SELECT *, 0.1 + duration_s/250 AS t, list_transform(w, lambda e: e/0.3) AS wn FROM rm),
    sol AS (SELECT *, least(1.0, 0.161*lx*ly*lz/(t*{AREA.replace('w[', 'wn[')})) AS x FROM wx),
    ab AS (SELECT *, list_transform(wn, lambda e: x*e) AS al, 0.161*lx*ly*lz/(x*{AREA.replace('w[', 'wn[')} + 1e-4) AS sab FROM sol)
    SELECT rec_id, {r('x')} AS x, {r('sqrt(1 - x*wn[1])')} AS beta_x0, {r('sqrt(1 - x*wn[5])')} AS beta_z0,
      abs(t - sab) < 0.005 AND (1-al[1])*(1-al[2])*(1-al[3])*(1-al[4])*(1-al[5])*(1-al[6]) <> 0
      AND 0.2*sab >= 3.0*sqrt(lx*lx+ly*ly+lz*lz)/343.0 AS feasible FROM ab"""))
def wall_weight(spark, sf):
    """Wall absorption that gives a wanted T60, in closed form, with the feasibility test."""
    dims = {k: F.col(k) for k in ("lx", "ly", "lz")}
    t = 0.1 + F.col("duration_s") / 250
    x, beta, alpha = ac.wall_weight_for_t60(**dims, t60=t, weights=[F.lit(w) for w in WALLS])
    return rooms(spark, sf).select(
        "rec_id", rnd(x).alias("x"), rnd(beta[0]).alias("beta_x0"), rnd(beta[4]).alias("beta_z0"),
        ac.t60_feasible(**dims, t60=t, walls=alpha).alias("feasible"))


REF_PAIRS = f"""rp AS (SELECT b.array_id, b.mic, {D} AS d, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz
    FROM small_arrays a JOIN small_arrays b ON a.array_id = b.array_id AND a.mic = 0 AND b.mic > 0)"""


def ref_pairs(spark, sf):
    m = T.small_arrays(spark, sf)
    ref = m.filter("mic = 0").select("array_id", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    return m.filter("mic > 0").join(ref, "array_id")


@query("coherence_target", with_views("small_arrays", REF_PAIRS + f"""
    SELECT array_id, mic, bin::INTEGER AS bin, {r('CASE WHEN bin = 0 THEN 1 ELSE sin(x)/nullif(x, 0) END')} AS gamma
    FROM (SELECT *, 2*pi()*(bin*500.0::DOUBLE)*d/343.0::DOUBLE AS x FROM (SELECT *, unnest(range(0, 17)) AS bin FROM rp))"""))
def coherence_target(spark, sf):
    d = ac.dist(ac.xyz(), tuple(F.col(f"r{c}") for c in "xyz"))
    out = ref_pairs(spark, sf).select("array_id", "mic", d.alias("d"), F.explode(F.sequence(F.lit(0), F.lit(16))).alias("bin"))
    return out.select("array_id", "mic", "bin", rnd(ac.diffuse_coherence(F.col("bin") * 500.0, F.col("d"))).alias("gamma"))


@query("dpipd_template", with_views("small_arrays", REF_PAIRS + f"""
    SELECT array_id, mic, ie::INTEGER AS ie, ia::INTEGER AS ia, bin::INTEGER AS bin, {r('cos(ph)')} AS re, {r('sin(ph)')} AS im FROM (
      SELECT *, -2*pi()*(bin*2000.0::DOUBLE)*(sin(e)*cos(a)*dx + sin(e)*sin(a)*dy + cos(e)*dz)/343.0::DOUBLE AS ph FROM (
        SELECT *, pi()*ie/2 AS e, -pi() + 2*pi()*ia/4 AS a FROM (
          SELECT *, unnest(range(0,5)) AS bin FROM (
            SELECT *, unnest(range(0,5)) AS ia FROM (SELECT *, unnest(range(0,3)) AS ie FROM rp)))))"""))
def dpipd_template(spark, sf):
    """Direct-path phase template on an (elevation x azimuth) grid; both grid ends are included."""
    grid = ref_pairs(spark, sf)
    for name, n in (("ie", 3), ("ia", 5), ("bin", 5)):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    ele = F.lit(ac.math.pi) * F.col("ie") / 2
    azi = F.lit(-ac.math.pi) + F.lit(2 * ac.math.pi) * F.col("ia") / 4
    ph = ac.dp_phase(ele, azi, tuple(F.col(f"r{c}") for c in "xyz"), ac.xyz(), F.col("bin") * 2000.0)
    return grid.select("array_id", "mic", "ie", "ia", "bin", rnd(ph["re"]).alias("re"), rnd(ph["im"]).alias("im"))
