"""Source-parsing and streaming-form queries over text and arrays derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reverbtable.functions import arrays as A
from reverbtable.functions.arrays import rnd
from reverbtable.functions.kernels import hann
from reverbtable.operators import catalog as C, timeline as L
from reverbtable.plans.book import Book
from reverbtable.sources import files as S, tables as T
from reverbtable.sources.tables import load, r, with_views
from reverbtable.streaming import live

query = Book()
QUERIES, ORACLE = query.queries, query.oracle


@query("session_json", """SELECT event_id, (props->>'$.k')::INTEGER AS samplerate FROM events""")
def session_json(spark, sf):
    """Session info objects: one typed field, no schema inference."""
    e = load(spark, sf, "events")
    return e.select("event_id", F.from_json("props", "k INT").getField("k").alias("samplerate"))


@query("textgrid", f"""SELECT event_id, 'spk' || user_id AS speaker, {r('value')} AS st_s, {r('value + 1.5')} AS en_s, event_type || ' "' || event_id || '"' AS text FROM events
    UNION ALL SELECT event_id, 'spk' || user_id, {r('value + 1.5')}, {r('value + 4')}, '' FROM events""")
def textgrid(spark, sf):
    """Interval files of two entries per event, parsed back; empty marks stay visible."""
    grid = F.format_string(
        'File type = "ooTextFile"\nObject class = "TextGrid"\nxmin = 0\nxmax = 9\ntiers? <exists>\nsize = 1\nitem []:\n'
        '    item [1]:\n        class = "IntervalTier"\n        name = "spk%d"\n        xmin = 0\n        xmax = 9\n'
        '        intervals: size = 2\n        intervals [1]:\n            xmin = %s\n            xmax = %s\n'
        '            text = "%s ""%d"""\n        intervals [2]:\n            xmin = %s\n            xmax = %s\n            text = ""\n',
        "user_id", *[(F.col("value") + d).cast("string") for d in (0.0, 1.5)], "event_type", "event_id",
        *[(F.col("value") + d).cast("string") for d in (1.5, 4.0)])
    df = load(spark, sf, "events").select("event_id", grid.alias("grid"))
    out = S.textgrid_intervals(df, ["event_id"], "grid")
    return out.withColumns({"st_s": rnd(F.col("st_s")), "en_s": rnd(F.col("en_s"))})


@query("key_value_text", f"""SELECT doc_id // 9 AS device, count(*) AS n_mics, {r('avg(n_chars/1000.0)')} AS t60,
    {r('avg(n_chars/2000.0)')} AS t30, {r('avg(doc_id/8.0)')} AS t20 FROM documents GROUP BY 1""")
def key_value_text(spark, sf):
    """Metadata text of every microphone to typed columns; each of three reverberation times averaged over a device's
    microphones."""
    number = lambda c: c.cast("string")
    text = F.format_string("$EnvMicID %d\n$EnvDepth 1 2\n$EnvMicRelRT60 %s\n$EnvMicRelRT30 %s\n\n$EnvMicRelRT20 %s\nremark\n",
                           F.col("doc_id"), number(F.col("n_chars") / 1000.0), number(F.col("n_chars") / 2000.0), number(F.col("doc_id") / 8.0))
    m = load(spark, sf, "documents").select(S.key_value_map(text).alias("m"))
    device = F.floor(F.col("m")["EnvMicID"].cast("long") / 9).cast("long").alias("device")
    return m.groupBy(device).agg(F.count(F.lit(1)).alias("n_mics"), *[
        rnd(F.avg(F.col("m")[f"EnvMicRelRT{k}"].cast("double"))).alias(f"t{k}") for k in (60, 30, 20)])


@query("nested_walk", f"""SELECT vec_id, (i-1)//32 AS traj, ((i-1)//8) % 4 AS height, (i-1) % 8 AS point, {r('embedding[i]::DOUBLE', 9)} AS h
    FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)""")
def nested_walk(spark, sf):
    """Nested measurement matrices to rows keyed by trajectory, height and point."""
    v = F.col("embedding").cast("array<double>")
    nest = F.array(*[F.array(*[F.slice(v, 32 * a + 8 * b + 1, 8) for b in range(4)]) for a in range(2)])
    df = load(spark, sf, "embeddings").select("vec_id", nest.alias("nest"))
    out = S.nested_walk(df, ["vec_id"], "nest", ["traj", "height", "point"])
    return out.select("vec_id", *[F.col(c).cast("long").alias(c) for c in ("traj", "height", "point")], rnd(F.col("h"), 9).alias("h"))


@query("rir_set_checks", """SELECT vec_id // 8 AS array_id, count(*) AS n_ch, count(DISTINCT len(embedding)) AS n_lengths,
    max(len(embedding))::INTEGER AS length, count(*) = 8 AND count(DISTINCT len(embedding)) = 1 AS complete FROM embeddings GROUP BY 1""")
def rir_set_checks(spark, sf):
    h = T.rirs(spark, sf).select(F.floor(F.col("rir_id") / 8).cast("long").alias("array_id"), "h")
    return S.rir_set_checks(h, ["array_id"], 8)


@query("sidecar_join", """SELECT doc_id AS stem, source AS corpus, quality, toxic FROM documents JOIN labels USING (doc_id)""")
def sidecar_join(spark, sf):
    """Signals with their annotation file by stem."""
    sig = load(spark, sf, "documents").select(F.col("doc_id").alias("stem"), F.col("source").alias("corpus"))
    ann = load(spark, sf, "labels").withColumnRenamed("doc_id", "stem")
    return S.with_annotation(sig, ann).select("stem", "corpus", "quality", "toxic")


@query("requested_labels", with_views("rir", f"""SELECT rir_id, {r('sum(h*h)', 9)} AS energy, {r('max(abs(h))', 9)} AS peak FROM rir GROUP BY 1"""))
def requested_labels(spark, sf):
    """Only the named labels are computed: the others are pruned from the plan."""
    h = F.col("h")
    df = T.rirs(spark, sf).select("rir_id", rnd(A.energy(h), 9).alias("energy"), rnd(A.peak(h), 9).alias("peak"),
                                  rnd(A.mean(h), 9).alias("mean"))
    return S.requested(df, "energy-peak", ["rir_id"])


@query("transform_chain", """SELECT doc_id AS rec_id, source AS corpus FROM documents WHERE n_chars/100.0 >= 4.112 AND lang IN ('en', 'de') AND source <> 'src3'""")
def transform_chain(spark, sf):
    """A list of DataFrame functions; Catalyst folds their filters into one scan."""
    steps = [lambda d: C.long_enough(d, 4.112), lambda d: d.filter(C.of_types("room", ["en", "de"])),
             lambda d: d.filter(C.not_named(["src3"], "corpus"))]
    return S.apply_chain(T.recordings(spark, sf), steps).select("rec_id", "corpus")


@query("corpus_rules", """SELECT doc_id AS rec_id, CASE WHEN lang IN ('en', 'fr') THEN source ELSE lang END AS layout_room,
      CASE WHEN lang IN ('en', 'fr') THEN n_chars/100.0 ELSE 1.0 END::DOUBLE AS weight FROM documents""")
def corpus_rules(spark, sf):
    """Corpora described by rows (layout pattern, weight mode) instead of classes."""
    rules = T.literal_table(spark, ["room", "layout", "mode"], [
        ("en", "^([^/]+)/", "duration"), ("fr", "^([^/]+)/", "duration"),
        ("de", "^[^/]+/([^/]+)/", "item"), ("es", "^[^/]+/([^/]+)/", "item")])
    out = T.recordings(spark, sf).join(rules, "room")
    return out.select("rec_id", F.expr("regexp_extract(path, layout, 1)").alias("layout_room"),
                      F.when(F.col("mode") == "duration", F.col("duration_s")).otherwise(1.0).alias("weight"))


@query("windowed_frames", with_views("signal", f"""SELECT sig_id, ch, t::INTEGER AS frame, {r('sum(x*(0.5-0.5*cos(2*pi()*(n-t*8)/16)))', 9)} AS total
    FROM signal, range(0,3) q(t) WHERE n >= t*8 AND n < t*8+16 GROUP BY ALL"""))
def windowed_frames(spark, sf):
    """Frames weighted with a given window vector."""
    w = F.array(*[F.lit(float(v)) for v in hann(16)])
    fr = L.frames(T.signals(spark, sf), ["sig_id", "ch"], "x", 16, 8)
    return fr.select("sig_id", "ch", "frame", rnd(A.total(F.zip_with("x", w, lambda a, b: a * b)), 9).alias("total"))


def stamped(spark, sf):
    return load(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")


@query("block_energy", f"""SELECT user_id, epoch_us(time_bucket(INTERVAL 10 MINUTE, ts)) AS start_us, {r('sum(value*value)', 4)} AS energy, count(*) AS n
    FROM events GROUP BY ALL""")
def block_energy(spark, sf):
    """Batch form of the streaming block energy."""
    out = live.block_energy(stamped(spark, sf), "user_id", "ts", "value")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), rnd(F.col("energy"), 4).alias("energy"), "n")


@query("activity_sessions", """WITH o AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def activity_sessions(spark, sf):
    """Batch form of the streaming sessions split by six hours of silence."""
    out = live.activity_sessions(stamped(spark, sf), "user_id", "ts")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
