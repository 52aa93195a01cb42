"""Queries that write files or streams from the given tables and read them back.

Files go to a new place in the shared folder on every run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reverbtable import schema
from reverbtable.functions.arrays import rnd
from reverbtable.operators import evaluate as E
from reverbtable.plans.book import Book
from reverbtable.plans.chunks import TRACK, tracks
from reverbtable.plans.evaluate import SMOOTH
from reverbtable.session import shared_dir
from reverbtable.sources import files, sinks, tables as T, wav
from reverbtable.sources.tables import load, r, with_views
from reverbtable.streaming import live

query = Book()
QUERIES, ORACLE = query.queries, query.oracle


def place(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


STAGED = "CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'preval' ELSE 'pretrain' END"


@query("published_signals", f"""SELECT stage, corpus, count(*) AS n, {r('sum(CASE WHEN stage = $$test$$ THEN 2 ELSE 1 END * n_chars)', 2)} AS total
    FROM (SELECT {STAGED} AS stage, source AS corpus, n_chars FROM documents) GROUP BY ALL""".replace("$$", "'"))
def published_signals(spark, sf):
    """Signals by stage and corpus; the test stage is published again with other values and replaces the first ones."""
    d = load(spark, sf, "documents")
    stage = F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "preval").otherwise("pretrain")
    sig = d.select(F.col("doc_id").alias("idx"), stage.alias("stage"), F.col("source").alias("corpus"), F.col("n_chars").cast("double").alias("x"))
    path = place(spark, "signals")
    sinks.publish(sig, path, ["stage", "corpus"])
    sinks.publish(sig.where("stage = 'test'").withColumn("x", F.col("x") * 2), path, ["stage", "corpus"], overwrite=True)
    back = sinks.published(spark, path)
    return back.groupBy("stage", "corpus").agg(F.count("*").alias("n"), rnd(F.sum("x"), 2).alias("total"))


@query("published_rirs", f"""SELECT label AS corpus, vec_id % 3 AS room, vec_id % 2 AS array, count(*) AS n_rows, min(vec_id) AS first_id,
    {r('sum(embedding[1]::DOUBLE)')} AS total FROM embeddings GROUP BY ALL""")
def published_rirs(spark, sf):
    """Responses in folders by corpus, room and array, with the rows that the manifest states."""
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("rir_id"), F.col("label").alias("corpus"), (F.col("vec_id") % 3).alias("room"),
                                             (F.col("vec_id") % 2).alias("array"), "embedding")
    path, by = place(spark, "rirs"), ["corpus", "room", "array"]
    said = sinks.publish(e, path, by)
    back = sinks.published(spark, path, check=False).groupBy(*by).agg(
        F.min("rir_id").alias("first_id"), rnd(F.sum(F.get("embedding", F.lit(0)).cast("double"))).alias("total"))
    same = [F.col(c).cast("long").alias(c) for c in by]
    return said.select(*same, "n_rows").join(back.select(*same, "first_id", "total"), by)


@query("scenario_store", """SELECT c_custkey AS idx, c_nationkey AS room, '2024' AS seed, '0.5' AS snr FROM customer""")
def scenario_store(spark, sf):
    """Configurations with the arguments they were drawn with."""
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_nationkey").alias("room"))
    path = place(spark, "scenarios")
    sinks.write_scenarios(c, {"seed": "2024", "snr": "0.5"}, path)
    back = sinks.read_back(spark, path)
    return back.select("idx", "room", F.col("args")["seed"].alias("seed"), F.col("args")["snr"].alias("snr"))


@query("room_config", f"""SELECT s_suppkey AS room, {r('3 + s_nationkey * 0.25', 4)} AS lx, {r('2.5 + s_nationkey * 0.125', 4)} AS ly, {r('s_acctbal', 2)} AS t60 FROM supplier""")
def room_config(spark, sf):
    """Room configurations as CSV with a header, read back typed."""
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("room"), (3 + F.col("s_nationkey") * 0.25).alias("lx"),
                                           (2.5 + F.col("s_nationkey") * 0.125).alias("ly"), F.col("s_acctbal").cast("double").alias("t60"))
    path = place(spark, "rooms")
    sinks.write_report(s, path)
    back = spark.read.csv(path, header=True, schema="room long, lx double, ly double, t60 double")
    return back.select("room", rnd(F.col("lx"), 4).alias("lx"), rnd(F.col("ly"), 4).alias("ly"), rnd(F.col("t60"), 2).alias("t60"))


def runs(spark, sf):
    """Training runs named like result files: simulated data by number of rooms, real data by records per epoch."""
    res = T.results(spark, sf)
    name = F.when(F.col("task") == "A", "simR16").when(F.col("task") == "N", "simT2R8").otherwise("real_ACE")
    return res.withColumns({"ft": F.lit("ft"), "embed": F.lit("all"), "num": F.lit(400), "model_data": name})


RUNS = """runs AS (SELECT *, 'ft' AS ft, 'all' AS embed, CASE WHEN task = 'A' THEN 'simR16' WHEN task = 'N' THEN 'simT2R8' ELSE 'real_ACE' END AS name FROM result),
    best AS (SELECT task, trial, lr, bs, val_mae, test_mae, CASE WHEN task = 'A' THEN 'sim' WHEN task = 'N' THEN 'simT2' ELSE 'real_ACE' END AS model,
      CASE WHEN task = 'A' THEN '16' WHEN task = 'N' THEN '8' ELSE 'invalid' END AS rooms, CASE WHEN name LIKE 'real%' THEN '400' ELSE 'invalid' END AS num
      FROM runs QUALIFY row_number() OVER (PARTITION BY task, trial ORDER BY val_loss, lr, bs) = 1)"""


def reports(spark, sf, name: str, heads: list[str]):
    path = place(spark, "reports")
    sinks.write_reports(*E.reports(runs(spark, sf)), path)
    return spark.read.csv(f"{path}/{name}", header=True, enforceSchema=False, schema=", ".join(f"`{h}` string" for h in heads))


def number(name: str, digits: int = 6):
    return rnd(F.col(f"`{name}`").cast("double"), digits)


@query("report_raw", with_views("result", RUNS + f""" SELECT task, name AS model_data, trial::VARCHAR AS trial, bs::VARCHAR AS bs, lr::VARCHAR AS lr,
    {r('val_loss')} AS val_loss, {r('test_mae')} AS test_mae FROM runs"""))
def report_raw(spark, sf):
    """The report of every run, read back from CSV."""
    raw = reports(spark, sf, "raw", sinks.RAW)
    return raw.select(F.col("Task").alias("task"), F.col("ModelData").alias("model_data"), F.col("`Trial(or Cross-Val)`").alias("trial"),
                      F.col("BS").alias("bs"), F.col("LR").alias("lr"), number("Val loss").alias("val_loss"), number("Test MAE").alias("test_mae"))


@query("report_best", with_views("result", RUNS + f""" SELECT task, model AS model_data, rooms, num, trial::VARCHAR AS trial, bs::VARCHAR AS bs, lr::VARCHAR AS lr,
    {r('val_mae')} AS val_mae, {r('test_mae')} AS test_mae FROM best"""))
def report_best(spark, sf):
    """The best run of every trial by validation loss."""
    best = reports(spark, sf, "best", sinks.BEST)
    return best.select(F.col("TASK").alias("task"), F.col("ModelData").alias("model_data"), F.col("`RoomNum(sim)`").alias("rooms"),
                       F.col("`DataNum(/epoch-real)`").alias("num"), F.col("`Trial(or Cross-Val)`").alias("trial"), F.col("BS").alias("bs"),
                       F.col("LR").alias("lr"), number("Val MAE").alias("val_mae"), number("Test MAE").alias("test_mae"))


@query("report_best_avgtri", with_views("result", RUNS + f""" SELECT task, model AS model_data, rooms, num, {r('avg(val_mae)')} AS val_mae, {r('avg(test_mae)')} AS test_mae
    FROM best GROUP BY ALL"""))
def report_best_avgtri(spark, sf):
    """The best runs averaged over trials."""
    best = reports(spark, sf, "best_avgtri", sinks.AVERAGED)
    return best.select(F.col("TASK").alias("task"), F.col("ModelData").alias("model_data"), F.col("`RoomNum(sim)`").alias("rooms"),
                       F.col("`DataNum(/epoch-real)`").alias("num"), number("Val MAE").alias("val_mae"), number("Test MAE").alias("test_mae"))


@query("tsv_tables", f"""SELECT 'rec' || user_id % 5 AS rec, event_id % 24 * 3600.0 + user_id % 60 * 60 + value AS t, {r('value * 2')} AS x, {r('value * 3')} AS z FROM events"""
       .replace("event_id % 24 * 3600.0 + user_id % 60 * 60 + value AS t", r("event_id % 24 * 3600.0::DOUBLE + user_id % 60 * 60 + value") + " AS t"))
def tsv_tables(spark, sf):
    """Pose tables written as tab-separated files, one folder a record, and read with the time of day in seconds."""
    e = load(spark, sf, "events")
    given = {"hour": F.col("event_id") % 24, "minute": F.col("user_id") % 60, "second": F.col("value"), "x": F.col("value") * 2, "z": F.col("value") * 3}
    cols = [given.get(f.name, F.lit(0)).cast(f.dataType).alias(f.name) for f in schema.POSE_TSV.fields]
    path = place(spark, "poses")
    e.select(F.concat(F.lit("rec"), F.col("user_id") % 5).alias("rec"), *cols).write.partitionBy("rec").option("header", True).option("sep", "\t").csv(path)
    back = files.read_tsv(spark, f"{path}/*/*.csv", schema.POSE_TSV)
    return back.select(F.regexp_extract("file", r"rec=([^/]+)/", 1).alias("rec"), rnd(files.day_seconds()).alias("t"),
                       rnd(F.col("x")).alias("x"), rnd(F.col("z")).alias("z"))


@query("ace_labels", f"""SELECT 'Array_' || s_nationkey AS array, 'Office_' || s_suppkey % 7 AS room, (s_suppkey % 3)::VARCHAR AS position, (s_suppkey % 8)::INTEGER AS ch,
    {r('s_acctbal / 1000')} AS t60, {r('s_acctbal / 100')} AS drr FROM supplier""")
def ace_labels(spark, sf):
    """Label CSV with its own headings and comma-space separators."""
    s = load(spark, sf, "supplier")
    heads = "Mic config:, Room decode:, Room config:, Chan:, FB T60:, FB DRR:"
    bal = F.col("s_acctbal").cast("double")
    line = F.concat_ws(", ", F.concat(F.lit("Array_"), "s_nationkey"), F.concat(F.lit("Office_"), F.col("s_suppkey") % 7), (F.col("s_suppkey") % 3).cast("string"),
                       (F.col("s_suppkey") % 8).cast("string"), (bal / 1000).cast("string"), (bal / 100).cast("string"))
    path = place(spark, "ace")
    # every file of the folder starts with the headings
    rows = s.select(F.lit(heads).alias("h"), line.alias("v")).withColumn("p", F.spark_partition_id())
    text = rows.select("v").union(rows.select("h").limit(1)).coalesce(1).sortWithinPartitions(F.col("v") != heads)
    text.write.text(path)
    back = files.read_ace_labels(spark, path)
    return back.withColumns({"t60": rnd(F.col("t60")), "drr": rnd(F.col("drr"))})


@query("running_smoother", with_views("series", SMOOTH + f" SELECT key, n, {r('s')} AS smooth FROM sm"))
def running_smoother(spark, sf):
    """The stateful smoother over every key's values in their order."""
    rows = T.series(spark, sf).select("key", F.timestamp_seconds("n").alias("ts"), "x")
    out = live.running_smoother(rows, "key", "ts", "x", 0.8)
    return out.select("key", F.unix_seconds("t").alias("n"), rnd(F.col("smooth")).alias("smooth"))


@query("ingest_catalogue", f"""WITH {TRACK} SELECT file_id, CASE WHEN file_id % 3 = 0 THEN n // 2 ELSE n END AS n_samples, false AS bad FROM len""")
def ingest_catalogue(spark, sf):
    """Files taken by a stream; a third of them is then replaced by shorter ones, which a refresh finds."""
    rec = tracks(spark, sf)
    root, out, ck = place(spark, "incoming"), place(spark, "catalogue"), place(spark, "offsets")
    name = F.col("file_id").cast("string")
    wav.write_wav(rec, root, name, F.col("xs"), F.lit(16000))
    for _ in range(2):  # the second time there is nothing new
        live.ingest(spark, root, out, ck).awaitTermination()
    half = F.transform("xs", lambda x: F.slice(x, F.lit(1), F.floor(F.col("n") / 2).cast("int")))
    wav.write_wav(rec.where("file_id % 3 = 0"), root, name, half, F.lit(16000))
    for _ in range(2):
        live.refresh(spark, root, out)
    return live.catalogue(spark, out).select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("file_id"), "n_samples",
                                             F.col("error").isNotNull().alias("bad"))
