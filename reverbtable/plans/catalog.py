"""Catalogue queries: selection rules, expansion over pairs, totals, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from reverbtable.functions.arrays import rnd
from reverbtable.operators import catalog as C, geometry as G
from reverbtable.plans.book import Book
from reverbtable.plans.geometry import D, HI, LO
from reverbtable.sources import tables as T
from reverbtable.sources.tables import load, r, with_views

query = Book()
QUERIES, ORACLE = query.queries, query.oracle

SPLIT_ROWS = [(lang, stage) for lang, stage in
              [("en", "train"), ("de", "train"), ("fr", "val"), ("es", "test")]]
SMALL_PAIRS = f"""sp AS (SELECT a.array_id, a.mic AS m1, b.mic AS m2 FROM small_arrays a JOIN small_arrays b
    ON a.array_id = b.array_id AND a.mic < b.mic WHERE {D} BETWEEN {LO} AND {HI})"""
ITEMS = SMALL_PAIRS + """,
  np AS (SELECT array_id, count(*) AS np FROM sp GROUP BY 1),
  it AS (SELECT recordings.*, m1, m2, duration_s/np AS weight
         FROM recordings JOIN np USING (array_id) JOIN sp USING (array_id))"""


def small_pairs(spark, sf):
    return G.mic_pairs(T.small_arrays(spark, sf), LO, HI, mic="mic")


def item_rows(spark, sf, mode=frozenset({"duration"})):
    return C.items(T.recordings(spark, sf), small_pairs(spark, sf), set(mode))


@query("path_attributes", """SELECT doc_id AS rec_id, source AS corpus_dir, lang AS room_dir, doc_id::VARCHAR AS stem FROM documents""")
def path_attributes(spark, sf):
    rec = T.recordings(spark, sf).select("rec_id", "path")
    return C.path_attributes(rec, ["corpus_dir", "room_dir", "stem"]).drop("path")


@query("pair_name_attributes", """SELECT vec_id, label || '-' || (vec_id % 7) || '-2' AS sp, label AS array_pos,
    (vec_id % 8)::INTEGER AS m1, (vec_id % 5 + 8)::INTEGER AS m2 FROM embeddings""")
def pair_name_attributes(spark, sf):
    """Attributes encoded in file names are parsed once into columns."""
    e = load(spark, sf, "embeddings")
    name = F.format_string("SP%d-%d-2_MP%d-%d-%d.npy", "label", F.col("vec_id") % 7, "label",
                           F.col("vec_id") % 8, F.col("vec_id") % 5 + 8)
    return e.select("vec_id", name.alias("name")).select(
        "vec_id", *[v.alias(k) for k, v in C.pair_name_attributes(F.col("name")).items()])


@query("min_duration", f"""SELECT doc_id AS rec_id, {r('n_chars/100.0')} AS duration_s FROM documents WHERE n_chars/100.0 >= 4.112""")
def min_duration(spark, sf):
    return C.long_enough(T.recordings(spark, sf), 4.112).select("rec_id", rnd(F.col("duration_s")).alias("duration_s"))


@query("stage_rooms", """SELECT doc_id AS rec_id, source AS corpus, lang AS room FROM documents WHERE lang IN ('en', 'de')""")
def stage_rooms(spark, sf):
    split = T.literal_table(spark, ["room", "stage"], SPLIT_ROWS)
    return C.in_stage(T.recordings(spark, sf), split, "train", ["room"]).select("rec_id", "corpus", "room")


@query("selection_rules", """SELECT source AS corpus, count(*) AS n,
      count(*) FILTER (source NOT IN ('src3', 'src7')) AS n_not_blacklisted,
      count(*) FILTER (doc_id BETWEEN 100 AND 700) AS n_reader_range,
      count(*) FILTER (lang IN ('en', 'fr')) AS n_typed,
      count(*) FILTER (NOT (doc_id % 2 = 1)) AS n_not_dp,
      count(*) FILTER (doc_id % 10 = n_chars % 10) AS n_right_array
    FROM documents GROUP BY 1""")
def selection_rules(spark, sf):
    """The small row filters of the catalogue, each as its predicate; survivors counted per corpus in one scan."""
    d = load(spark, sf, "documents").select(
        "doc_id", "lang", F.col("source").alias("corpus"),
        F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 1, "_dp.wav").otherwise(".wav")).alias("path"),
        (F.col("doc_id") % 10).alias("mic_id"), F.concat(F.lit("01-"), (F.col("n_chars") % 10).cast("string")).alias("type_id"))
    rules = {"n_not_blacklisted": C.not_named(["src3", "src7"], "corpus"), "n_reader_range": C.in_id_range("doc_id", 100, 700),
             "n_typed": C.of_types("lang", ["en", "fr"]), "n_not_dp": C.not_direct_path(),
             "n_right_array": C.right_array_type("mic_id", "type_id")}
    return d.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])


@query("spoken_turns", """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 0 ELSE length(text) END AS n
    FROM conversations WHERE role = 'user' OR (turn % 3 <> 2 AND text <> '')""")
def spoken_turns(spark, sf):
    """Empty transcripts are dropped except for corpora that keep them."""
    text = F.when(F.col("turn") % 3 == 2, "").otherwise(F.col("text"))  # every third turn is silent
    turns = load(spark, sf, "conversations").withColumn("text", text)
    return C.spoken(turns, F.col("role") == "user").select("conv_id", "turn", F.length("text").cast("long").alias("n"))


@query("items_weighted", with_views("recordings small_arrays", ITEMS + f"""
    SELECT rec_id, m1, m2, {r('weight', 9)} AS weight FROM it"""))
def items_weighted(spark, sf):
    return item_rows(spark, sf).select("rec_id", "m1", "m2", rnd(F.col("weight"), 9).alias("weight"))


@query("items_room_weight", with_views("recordings small_arrays", ITEMS + f"""
    SELECT rec_id, m1, m2, {r('1.0::DOUBLE / sum(1.0::DOUBLE) OVER (PARTITION BY corpus, room)', 9)} AS weight FROM it"""))
def items_room_weight(spark, sf):
    """Every pair counts in full and every room of a corpus gets the same total."""
    return item_rows(spark, sf, {"micpair", "room"}).select("rec_id", "m1", "m2", rnd(F.col("weight"), 9).alias("weight"))


@query("corpus_hours", with_views("recordings small_arrays", ITEMS + f"""
    SELECT corpus, room, count(*) AS n_files, {r('sum(duration_s)/3600.0')} AS hours
    FROM (SELECT path, any_value(corpus) AS corpus, any_value(room) AS room, any_value(duration_s) AS duration_s FROM it GROUP BY path)
    GROUP BY ROLLUP (corpus, room)"""))
def corpus_hours(spark, sf):
    return C.corpus_hours(T.recordings(spark, sf), small_pairs(spark, sf), ["corpus", "room"]).withColumn(
        "hours", rnd(F.col("hours")))


SHEET_ROWS = 1048575  # rows of one sheet of the spreadsheet format


@query("duration_sheet", f"""SELECT doc_id AS rec_id, {r('n_chars/100.0')} AS duration_s,
    (row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) // {SHEET_ROWS} AS sheet_no FROM documents""")
def duration_sheet(spark, sf):
    """The whole report, longest first; rows beyond one sheet go to the next."""
    rec = T.recordings(spark, sf).select("rec_id", "duration_s")
    return C.sheets(rec, "duration_s", "rec_id", SHEET_ROWS).withColumn("duration_s", rnd(F.col("duration_s")))


FIRST_N = 400  # size of the drawn data set, the feature of the operator


@query("first_n", f"""SELECT doc_id AS rec_id FROM documents ORDER BY md5('5:' || doc_id), doc_id LIMIT {FIRST_N}""")
def first_n(spark, sf):
    """Dataset size capped at the files available: the first n of the seeded order."""
    from reverbtable.functions.draws import digest
    return T.recordings(spark, sf).orderBy(digest("5", "rec_id"), "rec_id").limit(FIRST_N).select("rec_id")


@query("corpus_union", """SELECT corpus, count(*) AS n, count(room) AS n_room, count(speaker) AS n_speaker, count(snr) AS n_snr FROM (
      SELECT source AS corpus, lang AS room, NULL AS speaker, NULL::DOUBLE AS snr FROM documents
      UNION ALL SELECT 'dialogue', NULL, role, NULL FROM conversations
      UNION ALL SELECT 'stream', NULL, NULL, value FROM events) GROUP BY 1""")
def corpus_union(spark, sf):
    """Corpora with different columns in one table; what a corpus lacks is null."""
    a = T.recordings(spark, sf).select("corpus", "room")
    b = load(spark, sf, "conversations").select(F.lit("dialogue").alias("corpus"), F.col("role").alias("speaker"))
    c = load(spark, sf, "events").select(F.lit("stream").alias("corpus"), F.col("value").alias("snr"))
    out = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    return out.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.count("room").alias("n_room"),
                                     F.count("speaker").alias("n_speaker"), F.count("snr").alias("n_snr"))


@query("wide_record", with_views("small_arrays", f"""
    SELECT array_id, c.ch::INTEGER AS ch, {r('c.x', 9)} AS x FROM (SELECT array_id, unnest(list({{'ch': mic, 'x': x}} ORDER BY mic)) AS c
    FROM small_arrays GROUP BY 1)"""))
def wide_record(spark, sf):
    """Single-microphone files regrouped into one record per array, channels in order."""
    wide = C.files_to_rows(T.small_arrays(spark, sf), ["array_id"], "x", "mic")
    return (wide.select("array_id", F.posexplode("x").alias("ch", "x"))
            .select("array_id", "ch", rnd(F.col("x"), 9).alias("x")))


@query("control_channel", with_views("small_arrays", """SELECT array_id, count(*) AS n_ch, max(mic) AS last_ch
    FROM small_arrays WHERE mic < 7 GROUP BY 1"""))
def control_channel(spark, sf):
    kept = C.drop_channels_from(T.small_arrays(spark, sf), 7, "mic")
    return kept.groupBy("array_id").agg(F.count(F.lit(1)).alias("n_ch"), F.max("mic").alias("last_ch"))


@query("distinct_rooms_arrays", with_views("recordings", """SELECT corpus, count(DISTINCT room) AS n_rooms, count(DISTINCT array_id) AS n_arrays FROM recordings GROUP BY 1"""))
def distinct_rooms_arrays(spark, sf):
    """Distinct lists per corpus; partial aggregation removes duplicates before the shuffle."""
    rec = T.recordings(spark, sf)
    return rec.groupBy("corpus").agg(F.countDistinct("room").alias("n_rooms"), F.countDistinct("array_id").alias("n_arrays"))


@query("ace_label_join", with_views("small_arrays", f"""
    lab AS (SELECT vec_id // 8 AS array_id, (vec_id % 4)::INTEGER AS mic, {r('avg(embedding[1]::DOUBLE)')} AS t60, count(*) AS n
            FROM embeddings GROUP BY 1, 2)
    SELECT array_id, mic, t60, n FROM small_arrays JOIN lab USING (array_id, mic)"""))
def ace_label_join(spark, sf):
    """Published labels looked up by (array, channel); channels 4 to 7 of an array have none."""
    e = load(spark, sf, "embeddings")
    labels = e.groupBy(F.floor(F.col("vec_id") / 8).cast("long").alias("array_id"), (F.col("vec_id") % 4).cast("int").alias("mic")).agg(
        rnd(F.avg(F.get("embedding", F.lit(0)).cast("double"))).alias("t60"), F.count(F.lit(1)).alias("n"))
    return T.small_arrays(spark, sf).select("array_id", "mic").join(labels, ["array_id", "mic"])
