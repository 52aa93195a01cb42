"""Acoustic views over the generic input tables, in Spark and as SQL text.

Every view is a projection or one narrow join of a whole table, so its size grows with
the input. ``SQL`` holds the same views as CTE bodies for the DuckDB twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reverbtable.functions.scan import row_index, time_block

FS_RIR = 400  # sampling rate of the impulse-response view


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A fixed definition table inside the plan: no Python rows are shipped to tasks."""
    values = ", ".join("(" + ", ".join(f"CAST({v} AS BIGINT)" if isinstance(v, int) else f"'{v}'" for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def mics(spark, sf_dir) -> DataFrame:
    """Arrays of sixteen microphones."""
    e = load(spark, sf_dir, "embeddings")
    xyz = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")]
    return e.select(F.floor(F.col("vec_id") / 16).cast("long").alias("array_id"), F.col("vec_id").alias("mic_id"), *xyz)


def small_arrays(spark, sf_dir) -> DataFrame:
    """Eight-microphone arrays."""
    m = mics(spark, sf_dir)
    return m.select(F.floor(F.col("mic_id") / 8).cast("long").alias("array_id"),
                    (F.col("mic_id") % 8).cast("int").alias("mic"), "x", "y", "z")


def src_pos(spark, sf_dir) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    xyz = [(F.get("embedding", F.lit(i + 3)).cast("double") * 10.0).alias(c) for i, c in enumerate("xyz")]
    return e.select(F.col("vec_id").alias("src_id"), *xyz)


def rirs(spark, sf_dir) -> DataFrame:
    """One impulse response per row: rir_id, pair_id, ch, room, h."""
    e = load(spark, sf_dir, "embeddings")
    h = F.transform(F.col("embedding").cast("array<double>"),
                    lambda v, i: v * F.exp(-i.cast("double") / 12.0))
    return e.select(F.col("vec_id").alias("rir_id"),
                    F.floor(F.col("vec_id") / 2).cast("long").alias("pair_id"),
                    (F.col("vec_id") % 2).cast("int").alias("ch"),
                    F.col("label").alias("room"), h.alias("h"))


def rooms_of(col: str = "room") -> dict:
    """Room dimensions as expressions of the room number."""
    r = F.col(col).cast("double")
    return {"lx": 3.0 + r, "ly": 3.0 + r * 0.5, "lz": F.lit(2.5)}


def channel(c: int):
    """Samples of channel ``c`` of the interleaved two-channel array."""
    v = F.col("embedding").cast("array<double>")
    return F.transform(F.sequence(F.lit(0), (F.size(v) / 2).cast("int") - 1), lambda i: F.get(v, i * 2 + c))


def signals(spark, sf_dir) -> DataFrame:
    """Two-channel clips, de-interleaved: sig_id, ch, x."""
    e = load(spark, sf_dir, "embeddings")
    clip = [F.struct(F.lit(c).alias("ch"), channel(c).alias("x")) for c in (0, 1)]
    return (e.select(F.col("vec_id").alias("sig_id"), F.explode(F.array(*clip)).alias("c"))
            .select("sig_id", "c.ch", "c.x"))


def mono(spark, sf_dir) -> DataFrame:
    """One-channel clips of all samples: sig_id, speaker, x."""
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sig_id"), F.col("label").alias("speaker"),
        F.col("embedding").cast("array<double>").alias("x"))


def recordings(spark, sf_dir) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    # recordings are dealt over all eight-microphone arrays
    arrays = load(spark, sf_dir, "embeddings").select((F.floor(F.max("vec_id") / 8) + 1).cast("long")).scalar()
    return d.select(
        F.col("doc_id").alias("rec_id"), F.col("source").alias("corpus"), F.col("lang").alias("room"),
        (F.col("doc_id") % arrays).alias("array_id"),
        F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"),
        (F.col("n_chars") / 100.0).alias("duration_s"))


def timeline(spark, sf_dir) -> DataFrame:
    """Events with integer microseconds since 2024-01-01: key, event_id, t, kind, v."""
    e = load(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), "event_id",
                    (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)).alias("t"),
                    F.col("event_type").alias("kind"), F.col("value").alias("v"))


def utterances(spark, sf_dir) -> DataFrame:
    t = timeline(spark, sf_dir)
    return t.select(F.col("key").alias("session"), F.col("event_id").alias("utt_id"),
                    F.col("t").alias("st"), (F.col("t") + F.round(F.col("v") * 6e7).cast("long")).alias("en"))


def series(spark, sf_dir) -> DataFrame:
    """Per-key sample sequence: key, t, event_id, x, n (0-based)."""
    t = timeline(spark, sf_dir).select("key", "t", "event_id", F.col("v").alias("x"))
    return row_index(t, ["key"], ["t", "event_id"], time_block("t"), "n")


def predictions(spark, sf_dir) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("task"),
                     F.when(F.col("l_linestatus") == "O", "train").otherwise("test").alias("split"),
                     F.col("l_quantity").alias("gt"),
                     (F.col("l_quantity") * (1 + F.col("l_discount"))).alias("pred"))


def results(spark, sf_dir) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_returnflag").alias("task"), F.col("l_linenumber").alias("lr"),
                       F.col("l_linestatus").alias("bs"), (F.col("l_suppkey") % 4).alias("trial"))
            .agg(F.round(F.avg("l_discount"), 9).alias("val_loss"), F.round(F.avg("l_tax"), 9).alias("val_mae"),
                 F.round(F.avg("l_quantity"), 9).alias("test_loss"),
                 F.round(F.avg("l_extendedprice"), 6).alias("test_mae")))


SQL = {
    "mics": """SELECT vec_id // 16 AS array_id, vec_id AS mic_id, embedding[1]::DOUBLE AS x,
        embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings""",
    "small_arrays": """SELECT vec_id // 8 AS array_id, (vec_id % 8)::INTEGER AS mic, embedding[1]::DOUBLE AS x,
        embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings""",
    "src_pos": """SELECT vec_id AS src_id, embedding[4]::DOUBLE*10 AS x, embedding[5]::DOUBLE*10 AS y,
        embedding[6]::DOUBLE*10 AS z FROM embeddings""",
    "rir": """SELECT vec_id AS rir_id, vec_id // 2 AS pair_id, (vec_id % 2)::INTEGER AS ch, label AS room,
        (i-1)::INTEGER AS n, embedding[i]::DOUBLE * exp(-(i-1)::DOUBLE/12.0) AS h
        FROM (SELECT *, unnest(range(1, len(embedding)+1)) AS i FROM embeddings)""",
    "rir_peak": "SELECT rir_id, min(n) AS nd FROM (SELECT *, max(h) OVER (PARTITION BY rir_id) AS mx FROM rir) WHERE h = mx GROUP BY rir_id",
    "signal": """SELECT vec_id AS sig_id, ((i-1) % 2)::INTEGER AS ch, ((i-1) // 2)::INTEGER AS n,
        embedding[i]::DOUBLE AS x
        FROM (SELECT *, unnest(range(1, len(embedding)+1)) AS i FROM embeddings)""",
    "mono": """SELECT vec_id AS sig_id, label AS speaker, (i-1)::INTEGER AS n, embedding[i]::DOUBLE AS x
        FROM (SELECT *, unnest(range(1, len(embedding)+1)) AS i FROM embeddings)""",
    "recordings": """SELECT doc_id AS rec_id, source AS corpus, lang AS room, doc_id % (SELECT max(vec_id) // 8 + 1 FROM embeddings) AS array_id,
        concat_ws('/', source, lang, doc_id) AS path, n_chars/100.0::DOUBLE AS duration_s FROM documents""",
    "timeline": """SELECT user_id AS key, event_id, epoch_us(ts) - 1704067200000000 AS t,
        event_type AS kind, value AS v FROM events""",
    "utterance": """SELECT key AS session, event_id AS utt_id, t AS st,
        t + round(v*6e7)::BIGINT AS en FROM timeline""",
    "series": """SELECT key, t, event_id, v AS x,
        row_number() OVER (PARTITION BY key ORDER BY t, event_id) - 1 AS n FROM timeline""",
    "prediction": """SELECT l_returnflag AS task, CASE WHEN l_linestatus='O' THEN 'train' ELSE 'test' END AS split,
        l_quantity AS gt, l_quantity*(1+l_discount) AS pred FROM lineitem""",
    "result": """SELECT l_returnflag AS task, l_linenumber AS lr, l_linestatus AS bs, l_suppkey % 4 AS trial,
        round(avg(l_discount),9) AS val_loss, round(avg(l_tax),9) AS val_mae,
        round(avg(l_quantity),9) AS test_loss, round(avg(l_extendedprice),6) AS test_mae
        FROM lineitem GROUP BY ALL""",
}
NEEDS = {"rir_peak": ["rir"], "utterance": ["timeline"], "series": ["timeline"]}


def with_views(names: str, body: str) -> str:
    """Prefix ``body`` with the named views (and what they need). ``body`` starts at SELECT or at extra CTEs."""
    seen: list[str] = []

    def add(name):
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in seen:
            seen.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in seen)
    body = body.strip()
    glue = ",\n" if not body.upper().startswith("SELECT") else "\n"
    return f"WITH {ctes}{glue}{body}"


def r(expr: str, digits: int = 6) -> str:
    """Rounded SQL value without a negative zero."""
    return f"(round({expr}, {digits}) + 0.0::DOUBLE)"


def u(seed: str, *ids: str) -> str:
    """SQL text of the hash-uniform draw."""
    parts = " || ':' || ".join([f"'{seed}'"] + [f"({i})::VARCHAR" for i in ids])
    return f"(('0x' || substr(md5({parts}),1,8))::BIGINT / 4294967296.0::DOUBLE)"
