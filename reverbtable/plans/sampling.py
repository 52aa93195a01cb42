"""Sampling, splitting and scenario queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reverbtable.functions.arrays import rnd
from reverbtable.functions.draws import pick_index, uniform
from reverbtable.operators import sampling as S
from reverbtable.plans.book import Book
from reverbtable.plans.catalog import ITEMS, item_rows
from reverbtable.session import durable
from reverbtable.sources import tables as T
from reverbtable.sources.tables import load, r, u, with_views

query = Book()
QUERIES, ORACLE = query.queries, query.oracle

# fixed values: stage -> seed, source folder
STAGES = [("pretrain", 1000, "tr"), ("preval", 100000000, "dt"), ("test", 200000000, "et")]
STAGE_SQL = "(VALUES ('pretrain', 1000, 'tr'), ('preval', 100000000, 'dt'), ('test', 200000000, 'et')) s(stage, seed, folder)"
# fixed values: probabilities of the thirteen corpora in a mix
MIX = [1, 5, 5, 8, 8, 8, 15, 5, 5, 5, 5, 5, 5]

CDF = """tot AS (SELECT corpus, sum(weight) AS tot, count(*) AS cnt FROM it GROUP BY 1),
  cd AS (SELECT it.*, CASE WHEN row_number() OVER w = cnt THEN 1.0 ELSE sum(weight) OVER w / tot END AS cdf
         FROM it JOIN tot USING (corpus) WINDOW w AS (PARTITION BY corpus ORDER BY md5('cdf:' || item), item
              ROWS UNBOUNDED PRECEDING))"""
ITEM_CTE = ITEMS + ", it2 AS (SELECT *, path || ':' || m1 || '-' || m2 AS item FROM it)"
CDF = CDF.replace("it.*", "it2.*").replace("FROM it JOIN", "FROM it2 JOIN")


def named_items(spark, sf):
    return item_rows(spark, sf).withColumn("item", F.concat(
        "path", F.lit(":"), F.col("m1").cast("string"), F.lit("-"), F.col("m2").cast("string")))


@query("item_cdf", with_views("recordings small_arrays", ITEM_CTE + "," + CDF + f" SELECT corpus, item, {r('cdf')} AS cdf FROM cd"))
def item_cdf(spark, sf):
    return S.cdf(named_items(spark, sf), ["corpus"], "weight", "item").select("corpus", "item", rnd(F.col("cdf")).alias("cdf"))


CORPUS_CDF = """cw AS (SELECT corpus, sum(weight) AS w FROM it GROUP BY 1),
  cc AS (SELECT corpus, CASE WHEN row_number() OVER k = count(*) OVER () THEN 1.0
           ELSE sum(w) OVER k / sum(w) OVER () END AS ccdf
         FROM cw WINDOW k AS (ORDER BY md5('cdf:' || corpus), corpus ROWS UNBOUNDED PRECEDING))"""


@query("weighted_draw", with_views("recordings small_arrays", ITEM_CTE + "," + CDF + "," + CORPUS_CDF + f""",
    d AS (SELECT o_orderkey AS idx, {u('9:corpus', 'o_orderkey')} AS u1, {u('9:item', 'o_orderkey')} AS u2 FROM orders),
    c1 AS (SELECT corpus, ccdf, lag(ccdf, 1, -1.0) OVER (ORDER BY ccdf) AS prev FROM cc),
    c2 AS (SELECT corpus, item, cdf, lag(cdf, 1, -1.0) OVER (PARTITION BY corpus ORDER BY cdf) AS prev FROM cd)
    SELECT d.idx, c1.corpus, c2.item FROM d JOIN c1 ON u1 > c1.prev AND u1 <= ccdf
    JOIN c2 ON c2.corpus = c1.corpus AND u2 > c2.prev AND u2 <= cdf"""))
def weighted_draw(spark, sf):
    """Two-level draw with replacement, one per order: corpus by weight, then item by weight."""
    # the expanded catalogue feeds four branches below: build it once, keep it in reliable storage
    it = durable(named_items(spark, sf).select("corpus", "item", "weight"))
    corpora = S.cdf(it.groupBy("corpus").agg(F.sum("weight").alias("w")), [], "w", "corpus")
    draws = load(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"),
                                             uniform("9:corpus", "o_orderkey").alias("u1"),
                                             uniform("9:item", "o_orderkey").alias("u2"))
    first = S.draw(draws, corpora, [], "u1", ["corpus"])
    return S.draw(first, S.cdf(it, ["corpus"], "weight", "item"), ["corpus"], "u2", ["item"]).select("idx", "corpus", "item")


@query("corpus_mix", f"""WITH m AS (SELECT i-1 AS k, p[i]::DOUBLE AS w FROM (SELECT {MIX} AS p), range(1,14) t(i)),
    c AS (SELECT k, CASE WHEN k = 12 THEN 1.0 ELSE sum(w) OVER (ORDER BY k) / sum(w) OVER () END AS hi FROM m),
    b AS (SELECT k, hi, lag(hi, 1, -1.0) OVER (ORDER BY k) AS lo FROM c)
    SELECT k, count(*) AS n FROM orders JOIN b ON {u('11:mix', 'o_orderkey')} > lo AND {u('11:mix', 'o_orderkey')} <= hi GROUP BY 1""")
def corpus_mix(spark, sf):
    """Corpora mixed with fixed probabilities: thirteen known bounds, so the draw is one expression."""
    total, acc, case = sum(MIX), 0, F.lit(len(MIX) - 1)
    uu = uniform("11:mix", "o_orderkey")
    bounds = []
    for k, w in enumerate(MIX[:-1]):
        acc += w
        bounds.append((k, acc / total))
    for k, hi in reversed(bounds):
        case = F.when(uu <= hi, F.lit(k)).otherwise(case)
    return load(spark, sf, "orders").groupBy(case.cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("crop", f"""SELECT rec_id, n_samples, start FROM (
      SELECT doc_id AS rec_id, n_chars*160 AS n_samples,
        CASE WHEN n_chars*160 > 65792 THEN floor({u('3:crop', 'doc_id')} * (n_chars*160 - 65792 + 1))::BIGINT ELSE 0 END AS start
      FROM documents)""")
def crop(spark, sf):
    """Random 4.112 s window at 16 kHz of every recording."""
    n = F.col("n_chars") * 160
    return load(spark, sf, "documents").select(
        F.col("doc_id").alias("rec_id"), n.alias("n_samples"),
        S.crop_start(n, F.lit(65792), uniform("3:crop", "doc_id")).alias("start"))


@query("crop_range", f"""SELECT rec_id, {r('a')} AS a, {r('b')} AS b,
      CASE WHEN n*(b-a) > 16640 THEN floor({u('3:range', 'rec_id')} * (floor(n*(b-a)) - 16640 + 1))::BIGINT ELSE 0 END + floor(n*a)::BIGINT AS start
    FROM (SELECT *, CASE WHEN dur < 10 THEN (CASE WHEN (r0+r1)/2 < 0.5 THEN 0.0 ELSE 0.5 END) ELSE r0 END AS a,
                    CASE WHEN dur < 10 THEN (CASE WHEN (r0+r1)/2 < 0.5 THEN 0.5 ELSE 1.0 END) ELSE r1 END AS b FROM (
      SELECT doc_id AS rec_id, n_chars*160 AS n, n_chars/100.0::DOUBLE AS dur,
        CASE WHEN doc_id % 3 = 0 THEN 0.0 WHEN doc_id % 3 = 1 THEN 0.7 ELSE 0.85 END::DOUBLE AS r0,
        CASE WHEN doc_id % 3 = 0 THEN 0.7 WHEN doc_id % 3 = 1 THEN 0.85 ELSE 1.0 END::DOUBLE AS r1 FROM documents))""")
def crop_range(spark, sf):
    """Window inside a sub-range of the session; short sessions use one half."""
    part = F.col("doc_id") % 3
    d = load(spark, sf, "documents").select(
        F.col("doc_id").alias("rec_id"), (F.col("n_chars") * 160).alias("n"), (F.col("n_chars") / 100.0).alias("dur"),
        F.when(part == 0, 0.0).when(part == 1, 0.7).otherwise(0.85).alias("r0"),
        F.when(part == 0, 0.7).when(part == 1, 0.85).otherwise(1.0).alias("r1"))
    a, b = S.half_for_short(F.col("dur"), F.col("r0"), F.col("r1"))
    d = d.withColumns({"a": a, "b": b})
    inside = F.floor(F.col("n") * (F.col("b") - F.col("a")))
    # the span test keeps the unrounded length, as the window length does not depend on it
    start = F.when(F.col("n") * (F.col("b") - F.col("a")) > 16640,
                   F.floor(uniform("3:range", "rec_id") * (inside - 16640 + 1))).otherwise(0) + F.floor(F.col("n") * F.col("a"))
    return d.select("rec_id", rnd(F.col("a")).alias("a"), rnd(F.col("b")).alias("b"), start.cast("long").alias("start"))


@query("record_seeds", f"""SELECT doc_id AS rec_id, stage, folder, seed + doc_id AS record_seed, {r(u('draw', 'seed + doc_id'), 9)} AS u
    FROM documents JOIN {STAGE_SQL} ON s.stage = CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'preval' ELSE 'pretrain' END""")
def record_seeds(spark, sf):
    """Stage gives folder and base seed; a record draws from base seed plus its index."""
    stages = T.literal_table(spark, ["stage", "seed", "folder"], STAGES)
    k = F.col("rec_id") % 10
    rec = T.recordings(spark, sf).select("rec_id", F.when(k == 0, "test").when(k == 1, "preval").otherwise("pretrain").alias("stage"))
    out = rec.join(stages, "stage").withColumn("record_seed", F.col("seed") + F.col("rec_id"))
    return out.select("rec_id", "stage", "folder", "record_seed", rnd(uniform("draw", "record_seed"), 9).alias("u"))


@query("shuffled_order", """SELECT source AS corpus, doc_id AS rec_id,
      row_number() OVER (PARTITION BY source ORDER BY md5('2024:' || doc_id), doc_id) - 1 AS n FROM documents""")
def shuffled_order(spark, sf):
    return S.shuffled_index(T.recordings(spark, sf), ["corpus"], "2024", "rec_id").select("corpus", "rec_id", "n")


@query("prefix_split", """SELECT source AS corpus, doc_id AS rec_id, pos FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('2024:' || doc_id), doc_id) - 1 AS pos,
        count(*) OVER (PARTITION BY source) AS c FROM documents) WHERE pos >= floor(c*0.8) AND pos < floor(c*0.9)""")
def prefix_split(spark, sf):
    return S.prefix_split(T.recordings(spark, sf), ["corpus"], "2024", "rec_id", 0.8, 0.9).select("corpus", "rec_id", "pos")


@query("quota", """SELECT corpus, rec_id FROM (
      SELECT source AS corpus, doc_id AS rec_id, row_number() OVER (PARTITION BY source ORDER BY md5('6:' || doc_id), doc_id) - 1 AS pos,
        0.01::DOUBLE * (1 + length(source)) AS ratio FROM documents) WHERE pos < ceil(500*ratio)""")
def quota(spark, sf):
    """Proportional quota ceil(N * ratio) per corpus."""
    out = S.quota(T.recordings(spark, sf), ["corpus"], "6", "rec_id", 0.01 * (1 + F.length("corpus")), 500)
    return out.select("corpus", "rec_id")


@query("room_folds", f"""WITH rk AS (SELECT room, row_number() OVER (ORDER BY md5('4:' || room), room) - 1 AS k, count(*) OVER () AS n
      FROM (SELECT DISTINCT c_custkey AS room FROM customer))
    SELECT a.k AS fold, a.room AS test_room, b.room AS val_room, a.n - 2 AS n_train_rooms FROM rk a
    JOIN rk b ON b.k = (a.k + 1 + floor({u('4:val', 'a.room')} * (a.n - 1))::BIGINT) % a.n""")
def room_folds(spark, sf):
    rooms = load(spark, sf, "customer").select(F.col("c_custkey").alias("room"))
    return S.room_folds(rooms, "room", "4")


@query("fold_records", f"""WITH rk AS (SELECT room, row_number() OVER (ORDER BY md5('4:' || room), room) - 1 AS k, count(*) OVER () AS n
      FROM (SELECT DISTINCT user_id AS room FROM events)),
    c AS (SELECT user_id AS room, count(*) AS c FROM events GROUP BY 1)
    SELECT a.k AS fold, ca.c AS n_test, cb.c AS n_val, (SELECT count(*) FROM events) - ca.c - cb.c AS n_train FROM rk a
    JOIN rk b ON b.k = (a.k + 1 + floor({u('4:val', 'a.room')} * (a.n - 1))::BIGINT) % a.n
    JOIN c ca ON ca.room = a.room JOIN c cb ON cb.room = b.room""")
def fold_records(spark, sf):
    """Records per role of every fold, by subtraction: the train side is never enumerated."""
    ev = load(spark, sf, "events").select(F.col("user_id").alias("room"))
    folds = S.room_folds(ev, "room", "4")
    per = ev.groupBy("room").agg(F.count(F.lit(1)).alias("c"))
    total = ev.select(F.count(F.lit(1))).scalar()
    return (folds.join(per.select(F.col("room").alias("test_room"), F.col("c").alias("n_test")), "test_room")
            .join(per.select(F.col("room").alias("val_room"), F.col("c").alias("n_val")), "val_room")
            .select("fold", "n_test", "n_val", (total - F.col("n_test") - F.col("n_val")).alias("n_train")))


@query("range_split", """SELECT split, count(*) AS n FROM (SELECT CASE WHEN c_custkey >= 0 AND c_custkey < 100 THEN 'train'
      WHEN c_custkey >= 100 AND c_custkey < 120 THEN 'val' WHEN c_custkey >= 120 THEN 'test' END AS split FROM customer) GROUP BY 1""")
def range_split(spark, sf):
    role = S.range_split(F.col("c_custkey"), {"train": (0, 100), "val": (100, 120), "test": (120, 1 << 62)})
    return load(spark, sf, "customer").groupBy(role.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("trials", """SELECT room, (room - 1) // nroom AS trial, greatest(1, round_even(32/(nroom + 1e-3), 0)::INTEGER) AS n_trials, nroom*100 AS n_records
    FROM (SELECT s_suppkey + 1 AS room, 2::BIGINT << (s_nationkey % 8)::BIGINT AS nroom FROM supplier)""")
def trials(spark, sf):
    nroom = F.expr("shiftleft(CAST(2 AS BIGINT), CAST(s_nationkey % 8 AS INT))")
    s = load(spark, sf, "supplier").select((F.col("s_suppkey") + 1).alias("room"), nroom.alias("nroom"))
    plan = S.trial_plan(F.col("nroom"))
    return s.select("room", S.trial_of(F.col("room"), F.col("nroom")).alias("trial"), *[v.alias(k) for k, v in plan.items()])


@query("other_speaker", f"""WITH ut AS (SELECT source AS speaker, doc_id AS utt_id FROM documents),
    rk AS (SELECT speaker, row_number() OVER (ORDER BY md5('8:' || speaker), speaker) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT speaker FROM ut)),
    ls AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY md5('8:list:' || utt_id), utt_id) - 1 AS pos, count(*) OVER (PARTITION BY speaker) AS c FROM ut),
    w AS (SELECT ut.*, k, floor({u('8:spk', 'utt_id')}*(n-1))::BIGINT AS j FROM ut JOIN rk USING (speaker)),
    x AS (SELECT w.*, rk.speaker AS sb FROM w JOIN rk ON rk.k = j + CASE WHEN j >= w.k THEN 1 ELSE 0 END)
    SELECT x.speaker, x.utt_id, sb AS speaker_b, ls.utt_id AS utt_id_b FROM x JOIN ls ON ls.speaker = sb
      AND ls.pos = floor({u('8:utt', 'x.utt_id')}*c)::BIGINT""")
def other_speaker(spark, sf):
    utts = T.recordings(spark, sf).select(F.col("corpus").alias("speaker"), F.col("rec_id").alias("utt_id"))
    return S.other_speaker(utts, "8")


@query("speakers_mix", f"""WITH ut AS (SELECT source AS speaker, doc_id AS utt_id FROM documents),
    rk AS (SELECT speaker, row_number() OVER (ORDER BY md5('9:' || speaker), speaker) - 1 AS k, count(*) OVER () - 1 AS n FROM (SELECT DISTINCT speaker FROM ut)),
    ls AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY md5('9:list:' || utt_id), utt_id) - 1 AS pos, count(*) OVER (PARTITION BY speaker) AS c FROM ut),
    d AS (SELECT ut.*, k, n, floor({u('9:spk', 'utt_id', '0')}*(n - 1))::BIGINT AS a, floor({u('9:spk', 'utt_id', '1')}*n)::BIGINT AS b FROM ut JOIN rk USING (speaker)),
    e AS (SELECT *, 1 AS slot, a AS j FROM d UNION ALL SELECT *, 2, CASE WHEN b = a THEN n - 1 ELSE b END FROM d),
    x AS (SELECT e.speaker, utt_id, slot, rk.speaker AS sb FROM e JOIN rk ON rk.k = j + CASE WHEN j >= e.k THEN 1 ELSE 0 END)
    SELECT speaker, utt_id, 0 AS slot, speaker AS speaker_b, utt_id AS utt_id_b FROM ut UNION ALL
    SELECT x.speaker, x.utt_id, slot, sb, ls.utt_id FROM x JOIN ls ON ls.speaker = sb AND ls.pos = floor({u('9:utt', 'x.utt_id', 'slot')}*c)::BIGINT""")
def speakers_mix(spark, sf):
    """Every utterance with one of each of two other speakers."""
    utts = T.recordings(spark, sf).select(F.col("corpus").alias("speaker"), F.col("rec_id").alias("utt_id"))
    return S.speakers_mix(utts, 3, "9")


@query("noise_match", with_views("recordings", f"""rir AS (SELECT vec_id AS rir_id, vec_id // 8 AS array_id, vec_id % 3 AS pair FROM embeddings),
    ns AS (SELECT rec_id AS noise_id, array_id, rec_id % 4 AS pair, n_chars FROM recordings JOIN documents ON doc_id = rec_id),
    ls AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY array_id, pair) AS c FROM ns
           WINDOW w AS (PARTITION BY array_id, pair ORDER BY md5('5:noise:list:' || noise_id), noise_id))
    SELECT rir_id, ls.noise_id, coalesce(n_chars, 0) AS noise_len FROM rir LEFT JOIN ls
      ON ls.array_id = rir.array_id AND ls.pair = rir.pair AND pos = floor({u('5:noise', 'rir_id')}*c)::BIGINT"""))
def noise_match(spark, sf):
    """One noise clip per response from the same array and pair; zero noise where there is none."""
    rir = load(spark, sf, "embeddings").select(F.col("vec_id").alias("rir_id"), F.floor(F.col("vec_id") / 8).cast("long").alias("array_id"),
                                               (F.col("vec_id") % 3).alias("pair"))
    noise = T.recordings(spark, sf).select(F.col("rec_id").alias("noise_id"), "array_id", (F.col("rec_id") % 4).alias("pair"),
                                           F.round(F.col("duration_s") * 100).cast("long").alias("n_chars"))
    hit = S.match_one(rir, noise, ["array_id", "pair"], "rir_id", "noise_id", "5:noise")
    return (hit.join(noise.select("noise_id", "n_chars"), "noise_id", "left")
            .select("rir_id", "noise_id", F.coalesce("n_chars", F.lit(0)).alias("noise_len")))


@query("draw_join", f"""WITH src AS (SELECT doc_id AS src_id, row_number() OVER (ORDER BY md5('1:src:' || doc_id), doc_id) - 1 AS k, count(*) OVER () AS n FROM documents),
    rr AS (SELECT vec_id AS rir_id, row_number() OVER (ORDER BY md5('1:rir:' || vec_id), vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings)
    SELECT o_orderkey AS idx, src_id, rir_id FROM orders
      JOIN src ON src.k = floor({u('1:ksrc', 'o_orderkey')} * (SELECT count(*) FROM documents))::BIGINT
      JOIN rr ON rr.k = floor({u('1:krir', 'o_orderkey')} * (SELECT count(*) FROM embeddings))::BIGINT""")
def draw_join(spark, sf):
    """Draws joined to sources and responses on drawn row numbers."""
    docs, emb = load(spark, sf, "documents").select("doc_id"), load(spark, sf, "embeddings").select("vec_id")
    src = S.shuffled_index(docs.select(F.col("doc_id").alias("src_id")), [], "1:src", "src_id", "k_src")
    rir = S.shuffled_index(emb.select(F.col("vec_id").alias("rir_id")), [], "1:rir", "rir_id", "k_rir")
    n_src, n_rir = docs.select(F.count(F.lit(1))).scalar(), emb.select(F.count(F.lit(1))).scalar()
    d = load(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"),
                                         pick_index(n_src, "1:ksrc", "o_orderkey").alias("k_src"),
                                         pick_index(n_rir, "1:krir", "o_orderkey").alias("k_rir"))
    return d.join(src, "k_src").join(rir, "k_rir").select("idx", "src_id", "rir_id")


@query("cyclic_rir", """SELECT doc_id AS rec_id, vec_id AS rir_id FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)""")
def cyclic_rir(spark, sf):
    emb = load(spark, sf, "embeddings").select(F.col("vec_id").alias("rir_id"))
    n = emb.select(F.count(F.lit(1))).scalar()
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("rec_id"))
    return d.withColumn("rir_id", F.pmod(F.col("rec_id"), n)).join(emb, "rir_id").select("rec_id", "rir_id")


@query("concat_speaker", """WITH ut AS (SELECT source AS speaker, doc_id AS utt_id, n_chars AS n FROM documents),
    run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY speaker ORDER BY utt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at,
              (sum(n) OVER (PARTITION BY speaker))::BIGINT AS total FROM ut),
    laps AS (SELECT run.*, unnest(range(0, 5000 // total + 3)) AS lap FROM run)
    SELECT a.speaker, a.utt_id AS start, b.utt_id AS used, b.at + b.lap*b.total - a.at AS "offset"
    FROM run a JOIN laps b ON a.speaker = b.speaker AND b.at + b.lap*b.total >= a.at AND b.at + b.lap*b.total < a.at + 5000""")
def concat_speaker(spark, sf):
    utts = T.recordings(spark, sf).select(F.col("corpus").alias("speaker"), F.col("rec_id").alias("utt_id"),
                                          F.round(F.col("duration_s") * 100).cast("long").alias("n"))
    return S.concat_plan(utts, 5000)


@query("concat_signal", with_views("mono", f"""
    ut AS (SELECT DISTINCT speaker, sig_id FROM mono),
    ls AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY sig_id) - 1 AS k, count(*) OVER (PARTITION BY speaker) AS c FROM ut),
    nx AS (SELECT a.sig_id AS start, j, b.sig_id AS used FROM (SELECT *, unnest(range(0,3)) AS j FROM ls) a JOIN ls b
           ON a.speaker = b.speaker AND b.k = (a.k + j) % a.c)
    SELECT start, count(*) AS n, {r('sum(x*(j*64+n+1))', 5)} AS moment FROM nx JOIN mono ON mono.sig_id = used GROUP BY 1"""))
def concat_signal(spark, sf):
    """Signals of one speaker joined end to end until 150 samples are reached."""
    m = T.mono(spark, sf)
    plan = S.concat_plan(m.select("speaker", F.col("sig_id").alias("utt_id"), F.size("x").cast("long").alias("n")), 150)
    out = S.concat_signals(plan, m, 150)
    moment = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return out.select("start", F.size("x").cast("long").alias("n"), rnd(moment, 5).alias("moment"))


@query("source_mix", f"""SELECT origin, count(*) AS n, {r('sum(w)')} AS weight FROM (
      SELECT 'real' AS origin, 0.5::DOUBLE/(SELECT count(*) FROM documents) AS w FROM documents UNION ALL
      SELECT 'simulated', 0.5::DOUBLE/(SELECT count(*) FROM embeddings) FROM embeddings) GROUP BY 1""")
def source_mix(spark, sf):
    """Real and simulated sets in one item list, each carrying half of the total weight."""
    real, simulated = T.recordings(spark, sf).select("rec_id"), load(spark, sf, "embeddings").select(F.col("vec_id").alias("rec_id"))
    return (S.mixed_origins(real, simulated, (True, True), "w").groupBy("origin")
            .agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("w")).alias("weight")))
